"""Keyed time-series operators: states, sequences, scores, risk, evaluation."""
