"""Pipelines and the registered query catalogue."""
