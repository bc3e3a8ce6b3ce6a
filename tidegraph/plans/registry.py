"""Known operators, in the order of their registration."""

from __future__ import annotations

_OPERATORS: list[type] = []


def operator(cls: type) -> type:
    """Class decorator: make an operator known."""
    _OPERATORS.append(cls)
    return cls


def list_operators() -> list[type]:
    return list(_OPERATORS)
