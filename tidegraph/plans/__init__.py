"""Plans of the temporal-graph engine."""
