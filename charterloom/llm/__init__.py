"""Operators for training-data pipelines.  The core never imports this package."""
