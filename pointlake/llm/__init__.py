"""Operators for preparing training text and vectors at scale, as Spark jobs."""
