"""Tabular AutoML operators for Spark: profile, prepare, engineer, train, evaluate, score."""

__version__ = "0.1.0"
