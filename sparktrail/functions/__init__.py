"""Column functions, and the few that need vectorised Python."""
