"""Functions on text columns."""
