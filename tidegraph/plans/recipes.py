"""Named pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import UndefinedRecipeError
from ..frame import EventLog
from .library import ListedNegatives, RandomNegatives
from .pipeline import Pipeline

LINK_PREDICTION = "link_prediction"
_RECIPES: dict[str, Callable[..., Pipeline]] = {}


def recipe(name: str) -> Callable:
    """Decorator: make a function that builds a pipeline known by a name."""

    def add(build: Callable[..., Pipeline]) -> Callable[..., Pipeline]:
        _RECIPES[name] = build
        return build

    return add


def build(name: str, **arguments) -> Pipeline:
    if name not in _RECIPES:
        raise UndefinedRecipeError(f"no recipe {name!r}; one of {sorted(_RECIPES)}")
    return _RECIPES[name](**arguments)


@recipe(LINK_PREDICTION)
def link_prediction(train: EventLog, negatives: DataFrame, typed: bool = False) -> Pipeline:
    """Random negatives in training, from the destinations' range (its end excluded); prepared ones in validation and test."""
    low, high = train.edges("dst").agg(F.min("dst"), F.max("dst")).first()
    pipeline = Pipeline(["train", "val", "test"])
    pipeline.register("train", RandomNegatives(low, high))
    for key in ("val", "test"):
        pipeline.register(key, ListedNegatives(negatives, typed))
    return pipeline
