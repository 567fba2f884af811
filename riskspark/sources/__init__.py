"""Reading input tables and writing append-only outputs."""
