"""Spark-native post-correction and data-processing engine for noisy scanned text."""

__version__ = "0.1.0"
