"""Column expressions: geometry, tags, speeds, formatting."""
