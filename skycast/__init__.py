"""skycast: air-quality forecasting analytics expressed as Spark jobs."""

__version__ = "0.1.0"
