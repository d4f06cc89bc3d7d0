"""A pre-aggregating analytics engine on PySpark DataFrames."""

from .engine import Engine

__all__ = ["Engine"]
