"""panelspark: analytics for panels of time-ordered cross-sections on Spark."""

__version__ = "0.1.0"
