"""quillon: named, lazily evaluated analytics queries on PySpark."""

__version__ = "0.1.0"
