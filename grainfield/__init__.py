"""Grainfield: a PySpark-native measurement engine for quantitative imaging data."""

__version__ = "0.1.0"
