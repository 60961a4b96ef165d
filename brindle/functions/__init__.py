"""Column expressions and frame helpers."""
