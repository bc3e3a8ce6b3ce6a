"""Streaming of the temporal-graph engine."""
