"""Operators for training-data pipelines. Nothing else in perfcap imports this package."""
