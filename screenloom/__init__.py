"""Spark-first candidate screening: skill extraction, ranking, scheduling, hiring stages, features and models."""

__version__ = "0.1.0"
