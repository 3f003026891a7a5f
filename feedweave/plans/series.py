"""From configuration to a merge: every show's sources are read, filtered and brought together as one plan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.config import FeedSource, Show, shows_frame
from feedweave.operators import rules
from feedweave.operators.events import Timings
from feedweave.operators.upsert import cut
from feedweave.plans.merge import Merge, merge
from feedweave.sources import readers, sinks


@dataclass
class Run:
    shows: list[Show]
    merged: Merge
    counts: DataFrame
    reports: DataFrame


def due_shows(spark: SparkSession, shows: list[Show], today: dt.date | None) -> list[Show]:
    """Shows that today's run takes: all without a day, else those without a schedule or with an occurrence."""
    if today is None or not shows:
        return shows
    names = {r["name"] for r in rules.due(shows_frame(spark, shows), today).collect()}
    return [s for s in shows if s.name in names]


def filtered(episodes: DataFrame, source: FeedSource) -> DataFrame:
    """Public rows that a source's title patterns and recurrence rules let through."""
    f = source.filters
    return rules.date_filter(rules.title_filter(episodes.where(rules.public(F.col("availability"))), f), list(f.r_rules))


def scanned(spark: SparkSession, show: Show, source: FeedSource, place: int, landed: Callable[[str], str], registry: readers.Registry | None = None) -> DataFrame:
    """The rows of one source that stay, from where its URL was landed."""
    reader = (registry or readers.standard_registry()).choose(source.url)
    path = landed(source.url)
    if reader is readers.video_episodes:
        rows = reader(readers.videos(spark, path), show.name, place)
    else:
        found = reader(spark, path, show.name, place)
        rows = found[0] if isinstance(found, tuple) else found
    return filtered(rows, source)


def albums(spark: SparkSession, shows: list[Show], role: str, landed: Callable[[str], str], registry: readers.Registry | None = None) -> list[DataFrame]:
    """The n-th sources of all shows as one DataFrame, for each n."""
    found: list[DataFrame] = []
    for n in range(max((len(getattr(s, role)) for s in shows), default=0)):
        parts = [scanned(spark, s, getattr(s, role)[n], n, landed, registry) for s in shows if len(getattr(s, role)) > n]
        whole = parts[0]
        for more in parts[1:]:
            whole = whole.unionByName(more)
        found.append(cut(whole))
    return found or [spark.createDataFrame([], readers.EPISODE)]


def run(spark: SparkSession, shows: list[Show], landed: Callable[[str], str], today: dt.date | None = None, semantics: str = "legacy", registry: readers.Registry | None = None, unreachable: DataFrame | None = None, timings: Timings | None = None) -> Run:
    """Merge the shows of a configuration.

    landed: where a source's URL was landed.  Weights, stop words, tolerance and title rules are each show's own.
    """
    timings = timings or Timings()
    with timings.stage("merge_config_total"):
        shows = due_shows(spark, shows, today)
        with timings.stage("process_sources"):
            refs, dls = (albums(spark, shows, role, landed, registry) for role in ("references", "downloads"))
        alignment = {s.name: s.alignment for s in shows}
        titles = {s.name: s.cleanup.title_normalization for s in shows}
        with timings.stage("align_episodes"):
            merged = merge(refs, dls, alignment, titles, semantics, unreachable=unreachable)
        rows = [df.select("show", "source_ord", F.lit(role).alias("role")) for role, found in (("reference", refs), ("download", dls)) for df in found]
        every = rows[0]
        for more in rows[1:]:
            every = every.unionByName(more)
        counts = sinks.source_counts(every)
        return Run(shows, merged, counts, sinks.report(merged.episodes, counts))
