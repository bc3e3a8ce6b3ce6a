"""Composition of operators: order by what they need, variants by key, errors that help."""

from __future__ import annotations

import difflib
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

from ..errors import BadOperatorProtocolError, UnresolvableOperatorDependenciesError
from . import registry
from .protocol import CORE, BatchFrame, Operator


def ordered(operators: list[Operator]) -> list[Operator]:
    """Operators so that each comes after those that produce what it needs (Kahn's algorithm; ties in the order given).

    Negatives, where someone produces the table ``neg``, also come before the neighbours ``nbr_nids``.
    """
    producers: dict[str, list[int]] = {}
    for i, op in enumerate(operators):
        for name in op.produces:
            producers.setdefault(name, []).append(i)
    after: dict[int, set[int]] = {i: set() for i in range(len(operators))}
    for i, op in enumerate(operators):
        for name in op.requires - CORE:
            if name not in producers:
                raise UnresolvableOperatorDependenciesError(_explain(op, name, operators))
            for p in producers[name]:
                if p != i:
                    after[p].add(i)
        if "nbr_nids" in op.produces:
            for p in producers.get("neg", []):
                if p != i:
                    after[p].add(i)
    waiting = [sum(i in follow for follow in after.values()) for i in range(len(operators))]
    ready, out = deque(i for i, n in enumerate(waiting) if not n), []
    while ready:
        i = ready.popleft()
        out.append(operators[i])
        for j in sorted(after[i]):
            waiting[j] -= 1
            if not waiting[j]:
                ready.append(j)
    if len(out) < len(operators):
        stuck = [type(operators[i]).__name__ for i, n in enumerate(waiting) if n]
        raise UnresolvableOperatorDependenciesError(f"these operators need each other: {', '.join(stuck)}")
    return out


def _explain(op: Operator, name: str, operators: list[Operator]) -> str:
    text = f"{type(op).__name__} needs {name!r}, which no operator produces."
    known = registry.list_operators()
    makers = [c.__name__ for c in known if name in getattr(c, "produces", ())]
    if makers:
        return f"{text} Registered operators that do: {', '.join(makers)}."
    names = sorted({p for o in [*operators, *known] for p in getattr(o, "produces", ())})
    if close := difflib.get_close_matches(name, names, n=2, cutoff=0.6):
        return f"{text} Did you mean {' or '.join(close)}?"
    told = [c.__name__ for c in known if name.lower() in (c.__doc__ or "").lower()]
    return f"{text} Its name is in the description of: {', '.join(told)}." if told else text


class Pipeline:
    """Operators shared by all keys, and operators of each key; one key at a time is active."""

    def __init__(self, keys: list[str]):
        if not keys:
            raise ValueError("a pipeline needs a key")
        self.keys = list(keys)
        self._shared: list[Operator] = []
        self._of: dict[str, list[Operator]] = {k: [] for k in keys}
        self._plan: dict[str, list[Operator] | None] = dict.fromkeys(keys)
        self._active: str | None = None

    def _checked(self, op: Operator) -> Operator:
        if not isinstance(op, Operator):
            raise BadOperatorProtocolError(f"{type(op).__name__} lacks one of requires, produces, has_state, apply, reset_state")
        if self._active is not None:
            raise RuntimeError("operators cannot be registered while a key is active")
        return op

    def _known(self, key: str) -> str:
        if key not in self._of:
            raise KeyError(f"unknown key {key!r}; one of {self.keys}")
        return key

    def register_shared(self, op: Operator) -> None:
        self._shared.append(self._checked(op))
        self._plan = dict.fromkeys(self.keys)

    def register(self, key: str, op: Operator) -> None:
        self._of[self._known(key)].append(self._checked(op))
        self._plan[key] = None

    def resolve(self, key: str | None = None) -> None:
        """Order the operators of a key, or of all whose operators have changed."""
        for k in self.keys if key is None else [self._known(key)]:
            if self._plan[k] is None:
                self._plan[k] = ordered([*self._shared, *self._of[k]])

    def validate_requirement(self, key: str, requires: set[str]) -> None:
        """Whether a consumer's needs are met by the log or the key's operators."""
        have = CORE | {p for op in [*self._shared, *self._of[self._known(key)]] for p in op.produces}
        if lacking := sorted(set(requires) - have):
            raise UnresolvableOperatorDependenciesError(f"nothing produces {', '.join(lacking)} for {key!r}")

    def set_active(self, key: str) -> None:
        self._active = self._known(key)

    @contextmanager
    def activate(self, key: str) -> Iterator[Pipeline]:
        """Make a key active, and the one before afterwards."""
        before = self._active
        self.set_active(key)
        try:
            yield self
        finally:
            self._active = before

    def execute(self, frame: BatchFrame) -> BatchFrame:
        """The plan of the active key's operators over a frame."""
        if self._active is None:
            raise RuntimeError("no key is active")
        self.resolve(self._active)
        for op in self._plan[self._active]:
            frame = op.apply(frame)
        return frame

    def reset_state(self, key: str | None = None) -> None:
        for k in self.keys if key is None else [self._known(key)]:
            for op in [*self._shared, *self._of[k]]:
                op.reset_state()

    def __str__(self) -> str:
        show = lambda ops: ", ".join(type(o).__name__ for o in ops) or "-"
        return "\n".join([f"shared: {show(self._shared)}", *(f"{k}{' (active)' if k == self._active else ''}: {show(v)}" for k, v in self._of.items())])
