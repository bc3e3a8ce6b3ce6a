"""Exceptions of the engine."""


class TideGraphError(Exception):
    """Base of all errors of the engine."""


class BadOperatorProtocolError(TideGraphError):
    """An object given as operator does not follow the operator protocol."""


class BadEncoderProtocolError(TideGraphError):
    """An object given as encoder does not follow the encoder protocol."""


class BadAggregatorProtocolError(TideGraphError):
    """An object given as aggregator does not follow the aggregator protocol."""


class UnresolvableOperatorDependenciesError(TideGraphError):
    """Operators need columns that nothing produces, or need each other in a circle."""


class InvalidNodeIDError(TideGraphError):
    """A node id is negative or outside the graph."""


class EmptyGraphError(TideGraphError):
    """A graph without an edge."""


class EventOrderedConversionError(TideGraphError):
    """A unit of time was asked of a graph that only orders its events."""


class InvalidDiscretizationError(TideGraphError):
    """A finer granularity was asked for than the data have."""


class EmptyBatchError(TideGraphError):
    """A batch without an event, where that is not allowed."""


class UndefinedRecipeError(TideGraphError):
    """No recipe has the name."""
