"""weft.operators."""
