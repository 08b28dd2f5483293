"""Quoin: point-in-time panel analytics and training-data preparation on PySpark."""
