"""weft.streaming."""
