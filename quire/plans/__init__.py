"""Pipelines and the catalogue of queries."""
