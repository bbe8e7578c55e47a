"""Spark-first analytics over content-addressed storage catalogs."""
