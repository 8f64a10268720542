"""Spark-native range folds over time series, with the compositions around them."""

__version__ = "0.1.0"
