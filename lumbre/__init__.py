"""Lumbre: an analytics engine expressed as lazy PySpark DataFrame plans."""

__version__ = "0.1.0"
