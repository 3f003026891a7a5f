"""Extension points: protocols of the replaceable parts, a registry of scorers, and shadow runs."""

from __future__ import annotations

import os
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from feedweave.config import Alignment
from feedweave.operators import linkage, upsert


@runtime_checkable
class Source(Protocol):
    def __call__(self, spark, path: str, show: str = "", source_ord: int = 0): ...


@runtime_checkable
class Scorer(Protocol):
    """Scores above zero (show, ref_idx, dl_idx, score) of two sets of rows."""

    def __call__(self, refs: DataFrame, dls: DataFrame, alignment: Alignment, rules: dict | None) -> DataFrame: ...


@runtime_checkable
class Assigner(Protocol):
    def __call__(self, scores: DataFrame, alignment: Alignment, method: str) -> DataFrame: ...


@runtime_checkable
class Fuser(Protocol):
    def __call__(self, pairs: DataFrame, refs: DataFrame, dls: DataFrame) -> DataFrame: ...


@runtime_checkable
class Tracer(Protocol):
    def __call__(self, refs: DataFrame, scores: DataFrame, pairs: DataFrame) -> DataFrame: ...


@runtime_checkable
class Listing(Protocol):
    def __call__(self, spark, path: str) -> DataFrame: ...


_SCORERS: dict[str, Scorer] = {}


def register(name: str, scorer: Scorer) -> None:
    _SCORERS[name] = scorer


for _name in linkage.SEMANTICS:
    register(_name, lambda refs, dls, alignment=Alignment(), rules=None, s=_name: linkage.align_scores(refs, dls, alignment, rules, s))


def scorer(name: str | None = None, variable: str = "FEEDWEAVE_SCORER") -> Scorer:
    """The scorer of a name: the argument, else the environment variable, else legacy."""
    name = name or os.environ.get(variable) or "legacy"
    if name not in _SCORERS:
        raise ValueError(f"unknown scorer {name!r}; one of {', '.join(sorted(_SCORERS))}")
    return _SCORERS[name]


def shadow(refs: DataFrame, dls: DataFrame, primary: str, candidate: str, alignment: Alignment = Alignment()) -> tuple[DataFrame, DataFrame]:
    """(the primary's scores, rows on which the candidate differs): the result never depends on the candidate."""
    a, b = scorer(primary)(refs, dls, alignment, None), scorer(candidate)(refs, dls, alignment, None)
    return a, upsert.difference(a, b)
