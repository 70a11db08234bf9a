"""The incremental bronze load as a Structured Streaming query."""
