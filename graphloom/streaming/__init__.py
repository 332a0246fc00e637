"""Graph tables that are kept up to date from streams."""
