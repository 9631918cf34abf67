"""faultscope: log diagnosis for ML deployment artifacts as Spark DataFrame jobs."""

__version__ = "0.1.0"
