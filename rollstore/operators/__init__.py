"""Operators on rows: merging under the key, limits on distinct values."""
