"""Sources of entries: a declared raw form each, and its parse into entries."""
