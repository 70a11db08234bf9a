"""Where rows go: landing snapshots and layer tables."""
