"""Operators as objects: what they need, what they produce, and how they change a frame of batches."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from ..workspace import keep, release

#: Always there: columns of the log.
CORE = frozenset({"edge_src", "edge_dst", "edge_time", "edge_x", "edge_type", "node_x", "node_x_nids", "node_x_time", "node_y", "node_y_nids", "node_y_time"})


@dataclass(frozen=True)
class BatchFrame:
    """The events of an iteration (with ``batch_id``) and the tables that operators have added, by name."""

    events: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def with_table(self, name: str, table: DataFrame) -> BatchFrame:
        return replace(self, tables=self.tables | {name: table})

    def with_columns_of(self, table: DataFrame, *names: str) -> BatchFrame:
        """One table under each name that one of its columns goes by."""
        return replace(self, tables=self.tables | dict.fromkeys(names, table))

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


@runtime_checkable
class Operator(Protocol):
    """Anything with these is an operator; ``apply`` only builds a plan."""

    requires: set[str]
    produces: set[str]
    has_state: bool

    def apply(self, frame: BatchFrame) -> BatchFrame: ...

    def reset_state(self) -> None: ...


class BaseOperator:
    """Names of what is produced get the suffix ``_id``, so one operator can be used twice; ``apply`` adds a table for each."""

    requires: set[str] = set()
    produces: set[str] = set()
    has_state = False

    def __init__(self, id: str | None = None):
        self.id = id
        self.produces = {self.name(p) for p in type(self).produces}
        self.requires = set(type(self).requires)

    def name(self, produced: str) -> str:
        return produced if self.id is None else f"{produced}_{self.id}"

    def reset_state(self) -> None:
        """Nothing to forget: what came before is part of the plan."""


class StatefulOperator(BaseOperator):
    """An operator that sees earlier iterations, from training to validation to test, until it is reset.

    What it needs of them are tables whose size follows from what they hold - entries of buffers, distinct nodes, pairs,
    times - not from how many iterations there were.  An iteration leaves plans of these tables (``leave``); the next one
    writes them before it begins (``state``), so its own plan reads two tables, that of the state and its events.
    Frames can be read until their operator is applied twice more or reset: then the tables they read are deleted.
    """

    has_state = True

    def __init__(self, id: str | None = None):
        super().__init__(id)
        self._left: dict[str, DataFrame] = {}
        self._held: list[dict[str, DataFrame]] = []

    def state(self) -> dict[str, DataFrame]:
        """The tables after the iteration before; none in the first."""
        if self._left:
            self._held.append({name: keep(table, f"state-{name}") for name, table in self._left.items()})
            self._left = {}
            for old in self._held[:-2]:
                release(*old.values())
            self._held = self._held[-2:]
        return self._held[-1] if self._held else {}

    def leave(self, **tables: DataFrame) -> None:
        self._left = tables

    def reset_state(self) -> None:
        for old in self._held:
            release(*old.values())
        self._left, self._held = {}, []


class SeededOperator(StatefulOperator):
    """An operator over seeds of given keys, which are then among what it requires."""

    has_state = False

    def __init__(self, seeds: list[str], id: str | None = None):
        super().__init__(id)
        self.seeds = list(seeds)
        self.requires |= set(seeds)


@runtime_checkable
class Encoder(Protocol):
    requires: set[str]

    def __call__(self, frame: BatchFrame) -> DataFrame: ...


@runtime_checkable
class Aggregator(Protocol):
    def __call__(self, messages: DataFrame) -> DataFrame: ...
