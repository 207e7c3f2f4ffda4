"""weft.functions."""
