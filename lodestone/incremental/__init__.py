"""incremental of the engine."""
