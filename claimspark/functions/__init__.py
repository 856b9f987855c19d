"""Column functions: Columns in, one Column out, no shuffle."""
