"""Operators of the temporal-graph engine."""
