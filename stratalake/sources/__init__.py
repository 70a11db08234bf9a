"""Where rows come from: landing files, relational databases, HTTP APIs."""
