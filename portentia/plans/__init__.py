"""Staged pipelines and the registered query catalogue."""
