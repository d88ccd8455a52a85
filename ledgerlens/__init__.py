"""Point-in-time company fundamentals and report audits as Spark jobs."""

__version__ = "0.1.0"
