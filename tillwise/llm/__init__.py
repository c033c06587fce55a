"""Operators of a training-data pipeline: archives, filters, near copies, tokens."""
