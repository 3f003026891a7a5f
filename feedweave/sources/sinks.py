"""Sinks: JSON reports, series bundles, unmatched references, RSS documents, action tables."""

from __future__ import annotations

import dataclasses
import datetime as dt
import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedweave.config import Show
from feedweave.functions import text

EPISODE_FIELDS = ("id", "title", "description", "source", "thumbnail", "upload_date")


def report(episodes: DataFrame, counts: DataFrame | None = None, describe: bool = True) -> DataFrame:
    """show, merged_count, counts, episodes (JSON text) of fused rows; describe=False leaves descriptions out."""
    fields = [f for f in EPISODE_FIELDS if describe or f != "description"]
    rows = episodes.groupBy("show").agg(F.count("*").alias("merged_count"), F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("e"))
    rows = rows.select("show", "merged_count", F.to_json(F.transform("e", lambda x: F.struct(*[x[f].alias(f) for f in fields]))).alias("episodes"))
    return rows if counts is None else rows.join(counts, "show", "left")


def source_counts(rows: DataFrame) -> DataFrame:
    """show, counts: rows of each source after its filters and before de-duplication, references before downloads."""
    n = rows.groupBy("show", "role", "source_ord").count()
    key = F.struct((F.col("role") != "reference").alias("r"), "source_ord", "count")
    return n.groupBy("show").agg(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["count"]).alias("counts"))


def bundles(episodes: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each show; other shows' folders stay."""
    rows = episodes.withColumn("slug", F.expr(text.create_slug("show")))
    rows.repartition("slug").write.partitionBy("slug").mode("overwrite").option("partitionOverwriteMode", "dynamic").json(folder)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One file, through the file system that the path names."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def series(spark: SparkSession, shows: list[Show], reports: DataFrame, folder: str, generated_at: str | None = None) -> None:
    """The bundle of a run: <slug>/config.json, <slug>/feeds/combined.json, index.json and report.json.

    reports: rows of report(); one show at a time comes to the driver.  Shows without rows have an empty combined.json.
    """
    folder = folder.rstrip("/")
    known = {s.name: s for s in shows}
    entries, texts = [], []
    done = set()

    def put(show: Show, row: dict) -> None:
        write_text(spark, f"{folder}/{show.slug}/config.json", json.dumps(dataclasses.asdict(show), indent=2) + "\n")
        write_text(spark, f"{folder}/{show.slug}/feeds/combined.json", json.dumps(row, indent=2) + "\n")
        entries.append({"name": show.name, "slug": show.slug, "directory": show.slug, "config": f"{show.slug}/config.json", "feeds": {"combined": f"{show.slug}/feeds/combined.json"}})
        texts.append({k: v for k, v in row.items() if k != "episodes"})

    for row in reports.orderBy("show").toLocalIterator():
        if row["show"] in known:
            done.add(row["show"])
            put(known[row["show"]], {**row.asDict(recursive=True), "episodes": json.loads(row["episodes"] or "[]")})
    for show in shows:
        if show.name not in done:
            put(show, {"show": show.name, "merged_count": 0, "episodes": []})
    write_text(spark, f"{folder}/report.json", json.dumps(texts, indent=2, default=str) + "\n")
    at = generated_at or dt.datetime.now(dt.timezone.utc).isoformat()
    write_text(spark, f"{folder}/index.json", json.dumps({"generated_at": at, "series": entries}, indent=2) + "\n")


def put_cached(df: DataFrame, path: str, attempts: int = 3, delay: float = 0.05) -> None:
    """Write a cached table; a commit that collides with another writer is tried again."""
    for n in range(attempts):
        try:
            df.write.mode("overwrite").parquet(path)
            return
        except Exception:
            if n == attempts - 1:
                raise
            time.sleep(delay)


def unmatched_report(refs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Shows with references that no pair has, and these; other shows are left out."""
    rest = refs.join(pairs.select("show", F.col("ref_idx").alias("idx")), ["show", "idx"], "left_anti")
    return rest.groupBy("show").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "title"))).alias("unmatched"))


def xml(value: Column) -> Column:
    """Text fit for XML: control characters dropped, markup escaped."""
    value = F.regexp_replace(F.coalesce(value, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def mime(url: Column) -> Column:
    """Media types by extension; audio/mpeg for others."""
    kinds = {"m4a": "audio/mp4", "aac": "audio/aac", "wav": "audio/x-wav", "flac": "audio/flac", "ogg": "audio/ogg", "mp4": "video/mp4", "opus": "audio/ogg"}
    name = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    out = F.lit("audio/mpeg")
    for ext, kind in kinds.items():
        out = F.when(name == ext, kind).otherwise(out)
    return out


def _tag(name: str, value: Column) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"<{name}>"), xml(value), F.lit(f"</{name}>"))).otherwise("")


def rss_item(row: dict[str, Column]) -> Column:
    """An item: guid, title, description, enclosure, ISO date, whole seconds, image if it is a URL; empty fields are left out."""
    date = F.date_format(row["pub_date"], "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    image = F.when(row["image"].rlike("^https?://"), F.concat(F.lit('<itunes:image href="'), xml(row["image"]), F.lit('"/>'))).otherwise("")
    enclosure = F.when(row["content"] != "", F.concat(F.lit('<enclosure url="'), xml(row["content"]), F.lit('" type="'), mime(row["content"]), F.lit('"/>'))).otherwise("")
    parts = [
        F.lit("<item>"), _tag("guid", row["id"]), _tag("title", row["title"]), _tag("description", row["description"]), F.coalesce(enclosure, F.lit("")),
        _tag("pubDate", date), _tag("itunes:duration", row["duration"].cast("bigint").cast("string")), F.coalesce(image, F.lit("")), F.lit("</item>"),
    ]
    return F.concat(*parts)


def rss_documents(channels: DataFrame, items: DataFrame) -> DataFrame:
    """show, xml: one feed for each show that has items, in order of rank; shows without items keep what they have."""
    item = rss_item({c: F.col(c) for c in ("id", "title", "description", "content", "pub_date", "duration", "image")})
    body = items.select("show", F.struct("rank", item.alias("x")).alias("i")).groupBy("show").agg(F.array_join(F.transform(F.array_sort(F.collect_list("i")), lambda i: i["x"]), "").alias("body"))
    c = F.col
    head = F.concat(_tag("title", c("title")), _tag("link", c("url")), _tag("description", c("description")), _tag("itunes:author", c("author")), _tag("itunes:subtitle", c("subtitle")))
    open_, close = '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel>', "</channel></rss>"
    return channels.join(body, "show").select("show", F.concat(F.lit(open_), head, c("body"), F.lit(close)).alias("xml"))


def deletions(rows: DataFrame) -> DataFrame:
    """Objects that clean-up would delete, as a table of actions; nothing is deleted."""
    return rows.where("object_name IS NOT NULL").select("show", "object_name", F.lit("delete").alias("action"), F.lit(True).alias("dry_run"))


def uploads(rows: DataFrame) -> DataFrame:
    """Objects that would be uploaded (bucket, key, path, metadata), as a table of actions: type by name, public, in parts of 8 MiB by 4."""
    return rows.select(
        "bucket", "key", "path", mime(F.col("key")).alias("content_type"), F.lit("public-read").alias("acl"), F.transform_values("metadata", lambda k, v: F.coalesce(v.cast("string"), F.lit(""))).alias("metadata"),
        F.lit(8 << 20).alias("part_bytes"), F.lit(4).alias("threads"), F.lit("upload").alias("action"),
    )


def invalidated(cache: DataFrame, deletions: DataFrame) -> DataFrame:
    """Cached rows (bucket, key, ...) that stay when the objects of these are deleted."""
    return cache.join(deletions.select("bucket", "key").distinct(), ["bucket", "key"], "left_anti")


def object_url(base: Column, bucket: Column, prefix: Column, name: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(base, "/+$", ""), *[F.nullif(x, F.lit("")) for x in (bucket, prefix, name)])


__all__ = ["bundles", "deletions", "invalidated", "mime", "object_url", "put_cached", "report", "rss_documents", "rss_item", "series", "source_counts", "unmatched_report", "uploads", "write_text", "xml"]
