"""Show configuration: dataclasses, TOML loader, validation, JSON Schema, show selection."""

from __future__ import annotations

import dataclasses
import glob
import json
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from feedweave.functions.text import Replacement, TitleRules, slug_of

# Scoring defaults and the vocabulary of titles.
STOPWORDS = tuple("the a an and of with from for to in on at by episode part listener tales podcast mini special guest guests bonus volume vol".split())
MONTHS = tuple("january february march april may june july august september october november december".split())
CERTAINTY, RESCUE, WEAK_ANCHOR = 0.97, 0.78, 0.75
CONTAINMENT_BONUS, OVERLAP_BONUS = 0.08, 0.03


@dataclass(frozen=True)
class Weights:
    id: float = 0.10
    date: float = 0.30
    title: float = 0.50
    description: float = 0.10


@dataclass(frozen=True)
class Alignment:
    weights: Weights = Weights()
    date_score_tiers: tuple[tuple[int, float], ...] = ((2, 1.0), (10, 0.7), (35, 0.15))
    sparse_title_min: float = 0.85
    match_tolerance: float = 0.75
    extra_stopwords: tuple[str, ...] = ()

    @property
    def stopwords(self) -> tuple[str, ...]:
        return STOPWORDS + tuple(x.strip().lower() for x in self.extra_stopwords if x.strip())


@dataclass(frozen=True)
class SourceFilter:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    r_rules: tuple[str, ...] = ()


@dataclass(frozen=True)
class FeedSource:
    url: str
    filters: SourceFilter = SourceFilter()


@dataclass(frozen=True)
class Cleanup:
    title_normalization: TitleRules = TitleRules()


@dataclass(frozen=True)
class Show:
    name: str
    path: str = ""
    references: tuple[FeedSource, ...] = ()
    downloads: tuple[FeedSource, ...] = ()
    schedule: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    alignment: Alignment = Alignment()
    cleanup: Cleanup = Cleanup()
    slug: str = field(default="", init=False)

    def __post_init__(self):
        object.__setattr__(self, "slug", slug_of(self.name))
        if not self.path:
            object.__setattr__(self, "path", f"/media/podcasts/{self.slug}")
        for source in (*self.references, *self.downloads):
            for pattern in (*source.filters.include, *source.filters.exclude):
                re.compile(pattern)


def parse(kind, value):
    """A dataclass from plain data; unknown keys and missing required ones are errors."""
    if dataclasses.is_dataclass(kind):
        if not isinstance(value, dict):
            raise ValueError(f"{kind.__name__}: a table is needed, not {value!r}")
        fields = {f.name: f for f in dataclasses.fields(kind) if f.init}
        if unknown := set(value) - set(fields):
            raise ValueError(f"{kind.__name__}: unknown {', '.join(sorted(unknown))}")
        hints = _hints(kind)
        required = {n for n, f in fields.items() if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING}
        if missing := required - set(value):
            raise ValueError(f"{kind.__name__}: missing {', '.join(sorted(missing))}")
        return kind(**{k: parse(hints[k], v) for k, v in value.items()})
    origin = getattr(kind, "__origin__", None)
    if origin is tuple:
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"a list is needed, not {value!r}")
        inner = kind.__args__
        return tuple(parse(inner[0], v) for v in value) if inner[-1] is ... else tuple(parse(k, v) for k, v in zip(inner, value, strict=True))
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind):
        raise ValueError(f"{kind.__name__} is needed, not {value!r}")
    return value


def _hints(kind) -> dict:
    import typing

    return typing.get_type_hints(kind)


def load(name_or_path: str, folder: str = "config") -> list[Show]:
    """Shows of a TOML file; a bare name is <folder>/<name>.toml; anything but a list of podcasts is none."""
    path = Path(name_or_path)
    if not path.suffix and len(path.parts) == 1:
        path = Path(folder) / f"{name_or_path}.toml"
    with open(path, "rb") as f:
        shows = tomllib.load(f).get("podcasts")
    return [parse(Show, s) for s in shows] if isinstance(shows, list) else []


def expand(patterns: list[str]) -> list[str]:
    """Files of glob patterns (dot-files too), sorted within each, each file once, in order."""
    return list(dict.fromkeys(p for pattern in patterns for p in sorted(glob.glob(pattern, include_hidden=True))))


def tagged(shows: list[Show], tags: list[str]) -> list[Show]:
    """Shows whose name, slug or tag equals one of the tags, whatever their case; all shows without tags."""
    wanted = {t.strip().lower() for t in tags if t.strip()}
    return [s for s in shows if not wanted or wanted & {s.name.lower(), s.slug.lower(), *(t.strip().lower() for t in s.tags)}]


def shows_frame(spark: SparkSession, shows: list[Show]) -> DataFrame:
    """One row for each show, with what joins and filters need."""
    rows = [(s.name, s.slug, s.path, list(s.tags), list(s.schedule), s.alignment.match_tolerance) for s in shows]
    return spark.createDataFrame(rows, "name string, slug string, path string, tags array<string>, schedule array<string>, match_tolerance double")


def json_schema(kind=Show) -> str:
    """JSON Schema of a configuration class, sorted, with an indent of two."""

    def of(k) -> dict:
        if dataclasses.is_dataclass(k):
            hints = _hints(k)
            fields = [f for f in dataclasses.fields(k) if f.init]
            required = sorted(f.name for f in fields if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING)
            return {"type": "object", "additionalProperties": False, "properties": {f.name: of(hints[f.name]) for f in fields}, "required": required}
        if getattr(k, "__origin__", None) is tuple:
            return {"type": "array", "items": of(k.__args__[0])} if k.__args__[-1] is ... else {"type": "array", "prefixItems": [of(x) for x in k.__args__]}
        return {"type": {str: "string", int: "integer", float: "number", bool: "boolean"}[k]}

    return json.dumps({"title": kind.__name__, **of(kind)}, indent=2, sort_keys=True)


__all__ = ["Alignment", "Cleanup", "FeedSource", "Replacement", "Show", "SourceFilter", "TitleRules", "Weights", "expand", "json_schema", "load", "parse", "shows_frame", "tagged"]
