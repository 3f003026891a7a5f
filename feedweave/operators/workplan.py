"""Work planning and clean-up: existence checks, queue order, caps, unmatched objects, duplicate groups, segments, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from feedweave.functions import scalars, text


def exists_any(rows: DataFrame, listing: DataFrame, keys: dict[str, str], name: str = "exists_on_s3") -> DataFrame:
    """Flags rows for which any of the key columns has a counterpart in the listing: {row column: listing column}.

    One equi-join for each key, never a disjunctive one.
    """
    out, flags = rows, []
    for i, (mine, theirs) in enumerate(keys.items()):
        flag = f"__has{i}"
        out = out.join(listing.where(F.col(theirs).isNotNull()).select(F.col(theirs).alias(f"__k{i}"), F.lit(True).alias(flag)).distinct(), F.col(mine) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        flags.append(flag)
    found = F.lit(False)
    for flag in flags:
        found = found | F.coalesce(flag, F.lit(False))
    return out.withColumn(name, found).drop(*flags)


def queue_order() -> list:
    """Missing ones first, then newest first with unknown dates last, then by title."""
    return [F.asc("exists_on_s3"), F.desc_nulls_last("pub_date"), F.asc("title")]


def capped(queue: DataFrame, most: int, show_order: str = "show") -> DataFrame:
    """The first `most` missing rows over all shows, in order of show and queue; existing rows do not count and stay out.

    Ranks come from counts per show (of `most` shows at most) and a rank inside the show, so no task holds more than one show.
    """
    todo = queue.where(~F.col("exists_on_s3"))
    inside = F.row_number().over(Window.partitionBy(show_order).orderBy(*queue_order(), "idx"))
    sizes = todo.groupBy(show_order).count().orderBy(show_order).limit(most)  # every show has a row or more, so no others matter
    before = sizes.withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy(show_order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = todo.withColumn("place", inside).join(before, show_order).withColumn("place", F.col("place") + F.col("before")).drop("before")
    return ranked.where(F.col("place") <= most)


def unmatched(rows: DataFrame, pairs: DataFrame, side: str = "dl_idx") -> DataFrame:
    return rows.join(pairs.select("show", F.col(side).alias("idx")), ["show", "idx"], "left_anti")


def removable(downloads: DataFrame, pairs: DataFrame, slug: str = "slug") -> DataFrame:
    """Unmatched downloads whose slug no matched download of the show has."""
    matched = downloads.join(pairs.select("show", F.col("dl_idx").alias("idx")), ["show", "idx"], "left_semi").select("show", slug)
    return unmatched(downloads, pairs).join(matched, ["show", slug], "left_anti")


def resolve_keys(rows: DataFrame, listing: DataFrame, slug: str = "slug") -> DataFrame:
    """The object of each slug (the first by name with that stem); null where there is none."""
    names = listing.groupBy(F.expr(scalars.stem("name")).alias(slug)).agg(F.min("name").alias("object_name"))
    return rows.join(names, slug, "left")


def duplicate_groups(names: DataFrame, canonical: str, name: str = "name") -> DataFrame:
    """Names that share a canonical name which is itself among them, without it, in order."""
    keyed = names.select(F.col(name).alias("name"), F.expr(canonical).alias("canonical")).distinct()
    return keyed.join(keyed.where("name = canonical").select("canonical"), "canonical", "left_semi").where("name <> canonical").orderBy("canonical", "name")


def kept_segments(segments: DataFrame, totals: DataFrame, key: str = "video_id", least: float = scalars.MIN_SEGMENT) -> DataFrame:
    """The complement of skip segments (key, pos, start, end) in [0, total]: in input order, neither sorted nor clamped."""
    before = F.lag("end", 1, 0.0).over(Window.partitionBy(key).orderBy("pos"))
    gaps = segments.select(key, "pos", before.alias("start"), F.col("start").alias("end"))
    last = segments.groupBy(key).agg(F.max_by("end", "pos").alias("start"), F.max("pos").alias("pos"))
    tails = totals.join(last, key, "left").select(key, (F.coalesce("pos", F.lit(-1)) + 1).alias("pos"), F.coalesce("start", F.lit(0.0)).alias("start"), F.col("total").alias("end"))
    return gaps.unionByName(tails).where(F.col("end") - F.col("start") >= least)


def fingerprint(rows: DataFrame, keys: list[str], fields: list[str], size: int = 16) -> DataFrame:
    """An order-independent fingerprint of each group's rows."""
    line = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    return rows.groupBy(*keys).agg(F.substring(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary")), 1, size).alias("fingerprint"))


def profile(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Total, count, average, least and greatest of a value per label, to one decimal, the largest total first."""
    r = lambda c: F.round(c, 1)
    out = rows.groupBy(label).agg(r(F.sum(value)).alias("total"), F.count(value).alias("count"), r(F.avg(value)).alias("avg"), r(F.min(value)).alias("min"), r(F.max(value)).alias("max"))
    return out.orderBy(F.desc("total"), label)


def quality(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision (1 without positives) and false-positive rate (0 without negatives)."""
    p, y = F.col(predicted), F.col(label)
    tp, fp, neg = F.count_if(p & y), F.count_if(p & ~y), F.count_if(~y)
    return rows.agg(F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(1.0)).alias("precision"), F.coalesce(F.try_divide(fp.cast("double"), neg), F.lit(0.0)).alias("false_positive_rate"))


def median_p95(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Median, and the element max(0, int(0.95 n) - 1) of the sorted values; ranks come from counts of equal values, no list is gathered."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(label, value).agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy(label).orderBy(value)))
    sizes = counts.groupBy(label).agg(F.sum("n").alias("size"))
    want = upto.join(sizes, label)
    at = F.greatest(F.lit(0), F.floor(0.95 * F.col("size")).cast("bigint") - 1) + 1
    nth = lambda k: F.min(F.when(F.col("upto") >= k, F.col(value)))
    low, high = nth(F.floor((F.col("size") + 1) / 2)), nth(F.floor(F.col("size") / 2) + 1)
    return want.groupBy(label).agg(((low + high) / 2).alias("median"), nth(at).alias("p95"))


def header(sources: DataFrame, fields: list[str], order: str = "source_ord") -> DataFrame:
    """First filled value of each field over a show's sources in order; the title is the show's name."""
    pick = [F.min_by(F.when(F.col(f) != "", F.col(f)), F.when(F.col(f) != "", F.col(order))).alias(f) for f in fields if f != "title"]
    return sources.groupBy("show").agg(*pick).withColumn("title", F.col("show"))


def stage_ok(errors: DataFrame, shows: DataFrame) -> DataFrame:
    """show, ok: no error of the show (show, fatal) is fatal; shows without errors are fine."""
    found = errors.groupBy("show").agg(F.bool_or("fatal").alias("fatal"))
    return shows.select("show").distinct().join(found, "show", "left").select("show", (~F.coalesce("fatal", F.lit(False))).alias("ok"))


def slugs(df: DataFrame, title: str = "title") -> DataFrame:
    return df.withColumn("slug", F.expr(text.create_slug(title)))
