"""weft.sources."""
