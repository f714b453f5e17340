"""Readers, cleaning, sinks and the fitted-parameter store."""
