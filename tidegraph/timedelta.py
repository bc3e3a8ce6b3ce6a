"""Granularity of time: a unit and how many of it make a tick."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from .errors import EventOrderedConversionError

EVENT_ORDERED = "r"
_SECOND = 1_000_000_000
#: Nanoseconds of each unit; months and years have a fixed length.
NANOSECONDS = {
    "Y": 365 * 86_400 * _SECOND,
    "M": 30 * 86_400 * _SECOND,
    "W": 7 * 86_400 * _SECOND,
    "D": 86_400 * _SECOND,
    "h": 3_600 * _SECOND,
    "m": 60 * _SECOND,
    "s": _SECOND,
    "ms": 1_000_000,
    "us": 1_000,
    "ns": 1,
}


@dataclass(frozen=True, slots=True)
class TimeDelta:
    """``value`` units of time; the unit ``r`` only orders events and has the value 1."""

    unit: str
    value: int = 1

    def __post_init__(self) -> None:
        if isinstance(self.value, bool) or not isinstance(self.value, int) or self.value <= 0:
            raise ValueError(f"a granularity needs a positive whole number of units, not {self.value!r}")
        if self.unit == EVENT_ORDERED:
            if self.value != 1:
                raise ValueError("the event-ordered granularity has no value but 1")
        elif self.unit not in NANOSECONDS:
            raise ValueError(f"unknown unit {self.unit!r}; one of {[EVENT_ORDERED, *NANOSECONDS]}")

    @classmethod
    def of(cls, given: TimeDelta | str) -> TimeDelta:
        return given if isinstance(given, cls) else cls(given)

    @property
    def is_event_ordered(self) -> bool:
        return self.unit == EVENT_ORDERED

    @property
    def is_time_ordered(self) -> bool:
        return not self.is_event_ordered

    def ratio(self, other: TimeDelta | str) -> Fraction:
        """How many ticks of ``other`` one tick of this lasts, exactly."""
        other = TimeDelta.of(other)
        if self.is_event_ordered or other.is_event_ordered:
            raise EventOrderedConversionError(f"no conversion between {self} and {other}: one of them only orders events")
        return Fraction(NANOSECONDS[self.unit] * self.value, NANOSECONDS[other.unit] * other.value)

    def convert(self, other: TimeDelta | str) -> float:
        """``ratio`` as a double: the unit ratio (or one over its inverse) times the ratio of the values."""
        other = TimeDelta.of(other)
        self.ratio(other)
        mine, theirs = NANOSECONDS[self.unit], NANOSECONDS[other.unit]
        units = float(mine // theirs) if mine >= theirs else 1.0 / (theirs // mine)
        return units * self.value / other.value

    def is_coarser_than(self, other: TimeDelta | str) -> bool:
        return self.ratio(other) > 1


#: The granularities of public benchmarks, by name.
DATASETS = {
    "tgbl-enron": "s", "tgbl-uci": "s", "tgbl-wiki": "s", "tgbl-subreddit": "s", "tgbl-lastfm": "s", "tgbl-review": "s", "tgbl-coin": "s", "tgbl-mooc": "s",
    "tgbl-flight": "s", "tgbl-comment": "s", "tgbn-trade": "Y", "tgbn-genre": "s", "tgbn-reddit": "s", "tgbn-token": "s", "thgl-software": "s", "thgl-forum": "s",
    "thgl-github": "s", "thgl-myket": "s", "tkgl-smallpedia": "Y", "tkgl-polecat": "D", "tkgl-icews": "D", "tkgl-wikidata": "Y",
}
SEQUENCE_DATASETS = {"ML-20M": "s", "Taobao": "s", "Yelp": "s", "GoogleLocal": "s", "Flickr": "s", "Youtube": "s", "Patent": "s", "WikiLink": "s"}


def delta_of(dataset: str) -> TimeDelta:
    """The granularity of a public benchmark."""
    known = DATASETS | SEQUENCE_DATASETS
    if dataset not in known:
        raise ValueError(f"no granularity is known of {dataset!r}; one of {', '.join(known)}")
    return TimeDelta(known[dataset])
