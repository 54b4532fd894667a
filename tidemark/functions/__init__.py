"""Column functions of the library."""

from tidemark.functions import text, times

__all__ = ["text", "times"]
