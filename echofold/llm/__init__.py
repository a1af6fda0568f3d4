"""Operators for training-data pipelines. Nothing else in echofold imports this package."""
