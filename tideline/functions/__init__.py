"""Column expressions: no DataFrame in, no action, no shuffle."""
