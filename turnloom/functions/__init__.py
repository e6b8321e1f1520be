"""Column functions: text measures and media geometry, all in built-in SQL functions."""
