"""Column functions. All of them are row-local: they add no shuffle to a plan."""
