"""Plans built on a merge: the download queue (dry run), the feed to publish, the clean-up report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedweave.functions import scalars, text
from feedweave.operators import trace, workplan
from feedweave.plans.merge import Merge, match_titles
from feedweave.sources import sinks


def looked_up(rows: DataFrame, info: DataFrame, failures: DataFrame, now, key: str = "video_id", days: int = 7) -> DataFrame:
    """Rows with their enrichment; `fetch` marks those that neither have one nor failed for good within the last days."""
    known = info.withColumn("__known", F.lit(True))
    recent = failures.where(F.col("failed_at").cast("timestamp") > now - F.expr(f"interval {days} days")).select(key, F.lit(True).alias("__failed")).distinct()
    out = rows.join(known, key, "left").join(recent, key, "left")
    return out.withColumn("fetch", F.col("__known").isNull() & F.col("__failed").isNull() & F.col(key).isNotNull()).drop("__known", "__failed")


def with_segments(rows: DataFrame, segments: DataFrame, content: str = "content") -> DataFrame:
    """video_id of each row's content, and its skip segments in order; none for content that is no video."""
    packed = segments.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end"))).alias("__s"))
    out = rows.withColumn("video_id", F.expr(scalars.video_id(f"`{content}`"))).join(packed, "video_id", "left")
    empty = "cast(array() as array<struct<start:double,end:double>>)"
    return out.withColumn("sponsor_segments", F.expr(f"coalesce(transform(__s, x -> named_struct('start', cast(x.start as double), 'end', cast(x.end as double))), {empty})")).drop("__s")


def queue(merged: Merge, segments: DataFrame, listing: DataFrame, most: int) -> DataFrame:
    """What would be downloaded, in order: fused episodes that the store lacks by slug, source or video id."""
    rows = merged.episodes.withColumns({"slug": F.expr(text.create_slug("title")), "content": F.element_at("source", -1), "pub_date": F.col("upload_date"), "idx": F.col("dl_idx")})
    rows = with_segments(rows, segments)
    found = workplan.exists_any(rows, listing, {"slug": "stem", "content": "source", "video_id": "video_id"})
    return workplan.capped(found, most)


def feed(channels: DataFrame, files: DataFrame, references: DataFrame) -> DataFrame:
    """RSS documents of the files that match a reference title, in order of match; shows without matches keep their feed."""
    pairs = match_titles(files, references)
    f = files.select("show", F.col("idx").alias("ref_idx"), F.col("url").alias("content"))
    r = references.select("show", F.col("idx").alias("dl_idx"), "id", "title", "description", "pub_date", "duration", "image")
    return sinks.rss_documents(channels, pairs.join(f, ["show", "ref_idx"]).join(r, ["show", "dl_idx"]))


def cleanup(merged: Merge, listing: DataFrame) -> DataFrame:
    """Objects of downloads that nothing matches: the best reference that was considered, and the action."""
    rows = workplan.resolve_keys(workplan.removable(workplan.slugs(merged.downloads), merged.pairs), listing)
    best = trace.best_candidate(trace.candidate_reasons(merged.scores, merged.pairs)).select("show", F.col("dl_idx").alias("idx"), F.col("ref_idx").alias("best_ref_idx"), F.col("score").alias("best_score"))
    return sinks.deletions(rows).join(rows.select("show", "object_name", "idx"), ["show", "object_name"]).join(best, ["show", "idx"], "left")
