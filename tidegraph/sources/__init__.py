"""Sources of the temporal-graph engine."""
