"""Operators for training-data pipelines.  Nothing else in the library imports
this package; ``queries`` registers one query per operator."""
