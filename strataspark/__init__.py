"""A PySpark-native engine for three-dimensional implicit geological modelling."""

__version__ = "0.1.0"
