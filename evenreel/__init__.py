"""Popularity-fair rating analytics, written as Spark jobs."""
