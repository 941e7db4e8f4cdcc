"""Interval extractors as an expression tree: leaves read events, ``&``, ``|`` and ``-`` combine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import intervals as iv

Leaf = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Extractor:
    """A plan from events to intervals; composing builds the plan, nothing runs."""

    plan: Leaf
    text: str = field(default="", compare=True)

    def __call__(self, events: DataFrame) -> DataFrame:
        return iv.normalize(self.plan(events))

    def __and__(self, other: Extractor) -> Extractor:
        return Extractor(lambda e: iv.intersect(self(e), other(e)), f"({self.text} & {other.text})")

    def __or__(self, other: Extractor) -> Extractor:
        return Extractor(lambda e: iv.union(self(e), other(e)), f"({self.text} | {other.text})")

    def __sub__(self, other: Extractor) -> Extractor:
        return Extractor(lambda e: iv.subtract(self(e), other(e)), f"({self.text} - {other.text})")


def everything() -> Extractor:
    return Extractor(iv.all_time, "all")


def nothing() -> Extractor:
    return Extractor(iv.empty, "empty")


def active(topics: list[str], gap_ns: int) -> Extractor:
    return Extractor(lambda e: iv.activity(e, topics, gap_ns), f"active({topics}, {gap_ns})")


def spanned(topics: list[str]) -> Extractor:
    return Extractor(lambda e: iv.topic_span(e, topics), f"spanned({topics})")


def toggled(topic: str, pause: str | None = None) -> Extractor:
    return Extractor(lambda e: iv.toggles(e, F.col("topic") == topic, None if pause is None else F.col("topic") == pause), f"toggled({topic})")


def inactivity(screen: list[str], inputs: list[str], screen_gap_ns: int, input_gap_ns: int) -> Extractor:
    return active(screen, screen_gap_ns) & active(inputs, input_gap_ns) & spanned(screen)


KINDS: dict[str, Callable[..., Extractor]] = {f.__name__: f for f in (everything, nothing, active, spanned, toggled, inactivity)}


def from_config(kind: str, **settings: object) -> Extractor:
    if kind not in KINDS:
        raise ValueError(f"unknown extractor {kind!r}; there are {sorted(KINDS)}")
    return KINDS[kind](**settings)
