"""Column functions over paths, names, sizes, media facts and time."""
