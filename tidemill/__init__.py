"""Tidemill: hybrid retrieval and corpus processing as plain Spark jobs."""
