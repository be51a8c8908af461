"""Operators for training-data pipelines.  Nothing else in ``emberlog`` imports this subpackage."""
