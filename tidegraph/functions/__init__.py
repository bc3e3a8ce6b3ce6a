"""Functions of the temporal-graph engine."""
