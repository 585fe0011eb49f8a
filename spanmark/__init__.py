"""spanmark: rule-driven span annotation and text-corpus processing on PySpark."""

__version__ = "0.1.0"
