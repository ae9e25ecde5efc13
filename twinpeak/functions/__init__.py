"""Column-level building blocks (no DataFrame, no I/O)."""
