"""Sources: feeds as XML, video and sponsor data as JSON, object listings, CSV fixtures, and the choice among them.

Fetching over the network stays outside: readers take landed files.  Schemas are explicit; nothing is inferred.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedweave.functions import scalars
from feedweave.operators.rules import first_filled

EPISODE = "show string, source_ord int, idx bigint, id string, title string, author string, content string, description string, duration double, pub_date timestamp, image string, availability string"
_LINK = "struct<_href:string,_type:string,_url:string,_length:string>"
RSS_ITEM = (
    "guid struct<_VALUE:string,_isPermaLink:string>, title string, link string, author string, `itunes:author` string, description string, `itunes:summary` string, "
    f"pubDate string, `itunes:duration` string, `itunes:image` {_LINK}, enclosure array<{_LINK}>"
)
CHANNEL = f"title string, link string, description string, `itunes:author` string, `itunes:subtitle` string, `itunes:image` {_LINK}, image struct<url:string>"
VIDEO = (
    "id string, title string, channel string, uploader string, webpage_url string, url string, description string, duration double, timestamp bigint, release_timestamp bigint, "
    "upload_date string, thumbnail string, thumbnails array<struct<url:string,width:bigint,height:bigint>>, availability string"
)
SEGMENT = "segment array<double>, UUID string, category string, videoDuration double, actionType string, locked int, votes int, description string"
# Categories and actions of skip segments.
CATEGORIES = ("sponsor", "selfpromo", "interaction", "intro", "outro", "preview", "music_offtopic", "filler")
ACTIONS = ("skip", "mute", "full")


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "item").option("mode", "PERMISSIVE").schema(RSS_ITEM).load(path)


def rss_episodes(spark: SparkSession, path: str, show: str = "", source_ord: int = 0) -> tuple[DataFrame, DataFrame]:
    """(episodes, quarantined items without audio) of landed feeds; idx by publication, then id."""
    c = F.col
    rows = rss_items(spark, path).select(
        F.lit(show).alias("show"), F.lit(source_ord).alias("source_ord"),
        F.coalesce(F.nullif(c("guid._VALUE"), F.lit("")), c("link"), c("title")).alias("id"),
        F.coalesce("title", F.lit("")).alias("title"),
        first_filled("author", "itunes:author").alias("author"),
        F.get(F.filter(F.transform("enclosure", lambda e: F.coalesce(e["_url"], e["_href"])), lambda u: u.rlike(r"\.(" + "|".join(scalars.AUDIO) + ")")), F.lit(0)).alias("content"),
        first_filled("description", "itunes:summary").alias("description"),
        F.expr(scalars.parse_duration("`itunes:duration`")).alias("duration"),
        F.expr(scalars.feed_date("pubDate")).alias("pub_date"),
        F.coalesce(c("itunes:image._href"), c("itunes:image._url")).alias("image"),
        F.lit(None).cast("string").alias("availability"),
    )
    bad = rows.where("content IS NULL").withColumn("reason", F.lit("no audio enclosure"))
    return with_index(rows.where("content IS NOT NULL")), bad


def with_index(rows: DataFrame) -> DataFrame:
    """Numbers the rows of each show and source from 0, in order of date, id and title."""
    from pyspark.sql import Window

    order = Window.partitionBy("show", "source_ord").orderBy(F.asc_nulls_last("pub_date"), "id", "title")
    columns = [x.split()[0] for x in EPISODE.split(", ")]
    return rows.withColumn("idx", (F.row_number().over(order) - 1).cast("bigint")).select(*columns)


def rss_channels(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "channel").option("mode", "PERMISSIVE").schema(CHANNEL).load(path)
    c = F.col
    return rows.select(
        F.coalesce("title", F.lit("")).alias("title"), first_filled("itunes:author").alias("author"), first_filled("itunes:subtitle").alias("subtitle"),
        F.coalesce("link", F.lit("")).alias("url"), F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce(c("itunes:image._href"), c("image.url"), F.lit("")).alias("image"),
    )


def videos(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIDEO).json(path)


def video_episodes(rows: DataFrame, show: str = "", source_ord: int = 0) -> DataFrame:
    """Episodes of video records: default URL, public by default, date from timestamp, release or upload date."""
    c = F.col
    return with_index(rows.where(c("id").isNotNull()).select(
        F.lit(show).alias("show"), F.lit(source_ord).alias("source_ord"), "id", F.coalesce("title", F.lit("")).alias("title"),
        first_filled("channel", "uploader").alias("author"),
        F.coalesce(F.nullif(c("webpage_url"), F.lit("")), F.concat(F.lit("https://youtube.com/watch?v="), c("id"))).alias("content"),
        "description", "duration",
        F.coalesce(F.timestamp_seconds("timestamp"), F.timestamp_seconds("release_timestamp"), F.expr(scalars.compact_date("upload_date")).cast("timestamp")).alias("pub_date"),
        F.coalesce("thumbnail", F.element_at("thumbnails", -1)["url"]).alias("image"),
        F.coalesce(F.nullif(c("availability"), F.lit("")), F.lit("public")).alias("availability"),
    ))


def skip_segments(body: Column) -> Column:
    """Segments of a sponsor answer (JSON text): a list, or objects whose first has one; empty if any item is invalid."""
    direct = F.from_json(body, f"array<struct<{_fields(SEGMENT)}>>")
    nested = F.get(F.from_json(body, f"array<struct<segments:array<struct<{_fields(SEGMENT)}>>>>"), F.lit(0))["segments"]
    rows = F.coalesce(nested, direct)
    ok = F.forall(rows, lambda s: (F.size(s["segment"]) == 2) & s["UUID"].isNotNull() & s["category"].isin(list(CATEGORIES)) & s["actionType"].isin(list(ACTIONS)))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(rows, lambda s: F.struct(s["segment"][0].alias("start"), s["segment"][1].alias("end"), s["category"].alias("category"))))


def _fields(ddl: str) -> str:
    return ",".join(f"{name}:{kind}" for name, kind in (x.split(" ", 1) for x in ddl.split(", ")))


def sponsor_key(video_id: str) -> Column:
    return F.substring(F.sha2(F.col(video_id).cast("binary"), 256), 1, 24)


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """bucket, prefix, name, stem, etag of the files under a folder, without reading them; recursive=False: those directly in it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    if not recursive:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
        plain = lambda x: F.regexp_replace(x, "^([a-z0-9]+:)/+", "$1/")
        files = files.where(F.substring_index(plain(F.col("path")), "/", -1) == F.replace(plain(F.col("path")), F.concat(plain(F.lit(base)), F.lit("/")), F.lit("")))
    parts = F.split(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "/")
    return files.select(
        F.element_at(parts, 2).alias("bucket"), F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0))), "/").alias("prefix"), F.element_at(parts, -1).alias("name"),
        F.substring(F.md5(F.concat_ws(":", "path", "length", "modificationTime").cast("binary")), 1, 32).alias("etag"),
    ).withColumn("stem", F.expr(scalars.stem("name")))


def by_stem(objects: DataFrame, key: tuple[str, ...] = ("bucket", "prefix"), order: str = "name") -> DataFrame:
    """One object for each name without extension: of several the last in order of listing."""
    return objects.groupBy(*key, "stem").agg(F.max_by(F.struct("name", "etag"), F.col(order)).alias("o")).select(*key, "stem", "o.name", "o.etag")


def object_metadata(raw: DataFrame, column: str = "metadata") -> DataFrame:
    """Typed metadata of a map column; all null where any field is missing or malformed."""
    m = F.col(column)
    rows = raw.withColumns({
        "__d": m["duration"].try_cast("double"),
        "__s": m["source"], "__u": F.try_to_timestamp(m["upload_date"]), "__r": m["sponsors_removed"].try_cast("boolean"),
    })
    ok = F.col("__d").isNotNull() & F.col("__s").isNotNull() & F.col("__u").isNotNull() & F.col("__r").isNotNull()
    pick = lambda c: F.when(ok, F.col(c))
    return rows.select(*raw.columns, pick("__d").alias("duration"), pick("__s").alias("source"), pick("__u").alias("upload_date"), pick("__r").alias("sponsors_removed"))


def probe(body: Column) -> Column:
    """Duration, bit rate and audio streams of a captured media probe (JSON text)."""
    kind = "format struct<duration:string,bit_rate:string>, streams array<struct<index:int,codec_type:string,codec_name:string,bit_rate:string>>"
    p = F.from_json(body, kind)
    audio = F.filter(p["streams"], lambda s: s["codec_type"] == "audio")
    rate = F.coalesce(F.get(audio, F.lit(0))["bit_rate"].try_cast("bigint"), p["format"]["bit_rate"].try_cast("bigint"))
    return F.struct(p["format"]["duration"].try_cast("double").alias("duration"), rate.alias("bit_rate"), F.size(audio).alias("audio_streams"))


def fixture(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, doubled quotes; blank cells are null."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', schema=schema)
    return rows.select(*[F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes])


@dataclass
class Registry:
    """Readers by URL pattern: the first that fits reads, else the default."""

    default: Callable
    entries: list[tuple[str, Callable]] = field(default_factory=list)

    def add(self, pattern: str, reader: Callable) -> None:
        self.entries.append((pattern, reader))

    def choose(self, url: str) -> Callable:
        import re

        return next((reader for pattern, reader in self.entries if re.search(pattern, url)), self.default)

    def kind(self, url: Column, names: dict[Callable, str]) -> Column:
        """The reader's name for a column of URLs."""
        out = F.lit(names[self.default])
        for pattern, reader in reversed(self.entries):
            out = F.when(url.rlike(pattern), names[reader]).otherwise(out)
        return out


def standard_registry() -> Registry:
    r = Registry(rss_episodes)
    for pattern, *_ in scalars.CHANNEL_FORMS:
        r.add(pattern, video_episodes)
    return r


def unexpired(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Cached rows that still hold."""
    return df.where(F.col(expires).isNull() | (F.col(expires) > now))


def latest(versions: DataFrame, key: str = "url", at: str = "fetched_at", status: str = "status") -> DataFrame:
    """The body that holds of each landed response: the newest that came with one; an answer "not modified" (304) renews its date."""
    body = versions.where(F.col(status) != 304).groupBy(key).agg(F.max_by(F.struct(*versions.columns), F.col(at)).alias("v"), F.max(at).alias("body_at"))
    seen = versions.groupBy(key).agg(F.max(at).alias("checked_at"))
    return body.join(seen, key).select("v.*", "checked_at")


def new_ids(bundle: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a listing that the cached bundle lacks, in the order they came: what an incremental fetch asks for."""
    return bundle.join(known.select(key).distinct(), key, "left_anti")
