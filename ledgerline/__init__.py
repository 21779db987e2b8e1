"""Observation fusion, movement analytics and place catalogues as Spark jobs."""
