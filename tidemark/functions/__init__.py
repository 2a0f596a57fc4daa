"""Column and frame helpers that several jobs share."""
