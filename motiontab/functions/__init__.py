"""Column functions: geometry and row windows of tracks."""
