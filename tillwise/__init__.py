"""Recommender analytics on purchase and interaction tables, as Spark jobs."""
