"""panelspark: point-in-time analytics over long-format price panels, on Spark."""

__version__ = "0.1.0"
