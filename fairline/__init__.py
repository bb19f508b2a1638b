"""Point-in-time event features, scoring and market pricing as Spark DataFrame operators."""

__version__ = "0.1.0"
