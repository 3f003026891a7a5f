"""Every query of the record-linkage library by name, and the SQL it is compared with.

The tables stand in for feeds: a document's first line is a title and the rest its description, its language and source a
show, an order's date the publication date; parts are object names and short episodes, events are scored pairs and timed
segments.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.config import Alignment, SourceFilter
from feedweave.functions import scalars, similarity, text
from feedweave.functions.text import DUCK, SPARK, Replacement, TitleRules
from feedweave.operators import assign, fuse, linkage, rules, trace, upsert, workplan
from feedweave.plans import download, linkage_sql
from feedweave.plans.merge import match_titles, merge
from feedweave.sources import readers, sinks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


def projection(name: str, source: str, key: str, build, where=None) -> None:
    """A query that computes expressions of a table's rows: build(dialect) -> {column: SQL}."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        if where:
            df = df.where(where(SPARK))
        return df.select(*key.split(", "), *[F.expr(sql).alias(c) for c, sql in build(SPARK).items()])

    columns = ", ".join(f"{sql} AS {c}" for c, sql in build(DUCK).items())
    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {key}, {columns} FROM {source}" + (f" WHERE {where(DUCK)}" if where else "")


def title_of(d: text.Dialect) -> str:
    newline = "'\\n'" if d.spark else "chr(10)"
    return f"split_part(text, {newline}, 1)"


DOC_TITLE = f"SELECT doc_id, lang, source, {title_of(DUCK)} AS title FROM documents"
#: A part as a noisy title.
PART_TITLE = "concat(p_name, ' (Pt. III) & ', cast(p_size as varchar(9)), 'th twenty one @ IV + ', p_brand, ' _s v.mp3')"


def _part(d: text.Dialect) -> str:
    return PART_TITLE.replace("varchar(9)", "string") if d.spark else PART_TITLE


# Scalar functions on titles.
projection("slugify", "documents", "doc_id", lambda d: {"slug": text.create_slug(title_of(d), d)})
projection("is_slug", "documents", "doc_id", lambda d: {"title_is": text.is_slug(title_of(d), d), "slug_is": text.is_slug(text.create_slug(title_of(d), d), d)})
projection("strip_extension", "pages", "page_id", lambda d: {"stripped": text.remove_file_extension("url", d)})
projection("strip_control", "documents", "doc_id", lambda d: {"clean": text.remove_control_chars("concat(text, " + ("'\\u0001'" if d.spark else "chr(1)") + ", lang)", d)})
projection("normalize_text", "documents", "doc_id", lambda d: {"normal": text.normalize_text(title_of(d), d)})
projection("normalize_text_parts", "part", "p_partkey", lambda d: {"normal": text.normalize_text(_part(d), d)})
projection("roman_numerals", "part", "p_partkey", lambda d: {"x": text.roman_numerals(_part(d), d)})
projection("number_words", "part", "p_partkey", lambda d: {"x": text.number_words(_part(d), d)})
projection("ordinals", "part", "p_partkey", lambda d: {"x": text.ordinals(_part(d), d)})
projection("symbol_words", "part", "p_partkey", lambda d: {"x": text.symbol_words(_part(d), d)})
projection("part_marker", "part", "p_partkey", lambda d: {"x": text.part_marker(_part(d), d)})
PART_RULES = TitleRules((r"(?i)^small\s+",), (r"(?i)\s*v\.mp3$",), ("Brand 1 s",), (Replacement(r"Brand#(\d+)", r"Brand \1"), Replacement("ring", "band", "slug")))
projection("normalize_title_rules", "part", "p_partkey", lambda d: {"slug": text.normalize_title(_part(d), PART_RULES, d), "title_n": text.alignment_title(_part(d), PART_RULES, d)})

# The same functions on fixed texts with the values that they must have, worked out by hand.
def cases(name: str, build, expected: dict[str, str | float | bool | None]) -> None:
    def value(y) -> str:
        return "NULL" if y is None else f"'{y.replace(chr(39), chr(39) * 2)}'" if isinstance(y, str) else str(y).lower()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.createDataFrame(list(enumerate(expected)), "i int, x string").select("i", F.expr(build("x")).alias("y"))

    QUERIES[f"cases_{name}"] = run
    ORACLE_SQL[f"cases_{name}"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {value(y)})" for i, y in enumerate(expected.values())) + ") t(i, y)"


cases("slugify", text.create_slug, {
    "Hello World": "hello-world", "Don't Stop": "dont-stop", "He'd Rather Not": "hed-rather-not", "America's History": "americas-history", "Let_s Go": "lets-go", "Hello@World!": "helloworld", "Price: $99.99": "price-9999",
    "50% Off": "50-off", "Café": "cafe", "München": "munchen", "Привет": "privet", "Hello    World": "hello-world", "--Both--": "both", "Ωμέγα": "omega", "a.b.mp3": "ab", "Vol.3": "vol", "Vol.2": "vol2", "": "", "x" * 130: "x" * 100,
})
cases("strip_extension", text.remove_file_extension, {"my.file.txt": "my.file", "VIDEO.MP4": "VIDEO", "noext": "noext", "Vol.2": "Vol.2", "a.": "a.", ".hidden": ""})
cases("is_slug", text.is_slug, {"hello-world": True, "a1": True, "a-b-c": True, "Hello": False, "a--b": False, "-a": False, "a-": False, "a b": False, "": False, "a_b": False})
cases("normalize_text", text.normalize_text, {
    "Episode IV: A New Hope": "episode 4 a new hope", "Rise (Pt. II)": "rise part 2", "I & You": "1 and you", "twenty one pilots": "20 1 pilots", "The 1st and 22nd": "the 1 and 22", "100% Wolf #3": "100 percent wolf number 3",
    "ﬁne": "fine", "Part IX.mp4": "part 9", "a_b": "a_b", "": "", "  spaced   out  ": "spaced out",
})
cases("roman_numerals", text.roman_numerals, {"Rocky IV": "Rocky 4", "viii ix x": "8 9 10", "III II I": "3 2 1", "VIP mix": "VIP mix", "Act V, VI and VII": "Act 5, 6 and 7"})
cases("number_words", text.number_words, {"Twenty One": "20 1", "one hundred": "1 100", "onerous": "onerous", "Ninety nine thousand": "90 9 1000", "zero": "0"})
cases("ordinals", text.ordinals, {"1st 2nd 3rd 4th": "1 2 3 4", "21ST": "21", "1sting": "1sting", "the 100th": "the 100"})
cases("symbol_words", text.symbol_words, {"a&b": "a and b", "50%": "50 percent ", "@x": " at x", "#1": " number 1", "1+1=2": "1 plus 1 equals 2", "$5": " dollar 5"})
cases("part_marker", text.part_marker, {"A (Pt. II)": "A part II", "A (pt 3)": "A part 3", "A (Pt.IV)": "A part IV", "A (Part 2)": "A (Part 2)", "(Pt. V)": "part V"})
cases("normalize_title_rules", lambda x: text.normalize_title(x, TitleRules((r"(?i)^episode\s+\d+:\s*",), (r"(?i)\|\s*show$",), ("The Show",), (Replacement("^x-", "", "slug"),))), {"Episode 12: The Moon | Show": "the-moon", "X Ray The Show": "ray", "Plain": "plain", "Episode 1: ": ""})
cases("strip_control", text.remove_control_chars, {"a\x01b": "ab", "tab\tkept": "tab\tkept", "\x7f": "", "plain": "plain"})

# Dates, durations, hashes.
projection(
    "parse_duration", "events", "event_id",
    lambda d: {"seconds": scalars.parse_duration(f"case event_id % 5 when 0 then cast(user_id as {'string' if d.spark else 'varchar'}) when 1 then concat(user_id, ':', event_id % 60) when 2 then concat(user_id, ':', event_id % 60, ':07') when 3 then concat(user_id, ':1:2:3') else '' end", d)},
)
projection("epoch_parse", "events", "event_id", lambda d: {"at": scalars.unix_timestamp("case when event_id % 3 = 0 then event_type else concat(event_id * 1000, '') end", d) if d.spark else "CASE WHEN event_id % 3 = 0 THEN NULL ELSE to_timestamp(event_id * 1000) AT TIME ZONE 'UTC' END"})
ORACLE_SQL["epoch_parse"] = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch(to_timestamp(event_id * 1000)) END::BIGINT AS at FROM events"
QUERIES["epoch_parse"] = lambda spark, sf: table(spark, sf, "events").select("event_id", F.unix_seconds(F.expr(scalars.unix_timestamp("case when event_id % 3 = 0 then event_type else cast(event_id * 1000 as string) end"))).alias("at"))
projection("yyyymmdd_parse", "orders", "o_orderkey", lambda d: {"day": f"cast({scalars.compact_date('case when o_orderkey % 4 = 0 then o_orderpriority else ' + ('date_format(o_orderdate, ' + chr(39) + 'yyyyMMdd' + chr(39) + ')' if d.spark else 'strftime(o_orderdate, ' + chr(39) + '%Y%m%d' + chr(39) + ')') + ' end', d)} as {'string' if d.spark else 'varchar'})"})
projection("hash_prefix", "documents", "doc_id", lambda d: {"feed": scalars.md5_prefix("text", 16), "config": scalars.md5_prefix("lang", 8), "key": f"substring({'sha2(text, 256)' if d.spark else 'sha256(text)'}, 1, 24)"})

cases("parse_duration", scalars.parse_duration, {"90": 90.0, "1:30": 90.0, "01:01:30": 3690.0, "": None, "1:2:3:4": None, "x": None, "0:05.5": 5.5})
cases("yyyymmdd_parse", lambda x: f"cast({scalars.compact_date(x)} as string)", {"20240131": "2024-01-31", "20241301": None, "2024": None, "2024013x": None})
cases("byte_format", lambda x: scalars.byte_format(f"cast({x} as bigint)"), {"0": "0.0 B", "1023": "1023.0 B", "1024": "1.0 KB", "1280": "1.2 KB", "1408": "1.4 KB", "1572864": "1.5 MB", str(5 * 1024**5): "5.0 PB"})
cases("url_shape", scalars.channel_url, {
    "https://youtube.com/@Abc": "https://www.youtube.com/@Abc/videos", "https://www.youtube.com/@a-b/videos": "https://www.youtube.com/@a-b/videos", "yt://@x_1": "https://www.youtube.com/@x_1/videos",
    "yt://#PL1": "https://www.youtube.com/playlist?list=PL1", "https://youtube.com/playlist?list=PLx": "https://www.youtube.com/playlist?list=PLx", "ftp://x": None, "": None,
})
cases("url_extract", scalars.video_id, {"https://www.youtube.com/watch?v=ab-_1&t=2": "ab-_1", "youtube.com/watch?v=Q": "Q", "https://youtu.be/abc": None, "x": None})
cases("path_stem", scalars.stem, {"a.b.mp3": "a.b", ".hidden": ".hidden", "x/.y": "x/.y", "plain": "plain", "dir.d/n": "dir.d/n"})
cases("audio_filter", lambda x: scalars.is_audio_url(x), {"http://a/1.mp3": True, "http://a/1.opus?x=1": True, "http://a/1.txt": False, "mp3": False})
cases("error_reason", scalars.error_reason, {
    "ERROR: Private video. Sign in": "private video", "Sign in to confirm your age": "age-restricted; retrying with authentication", "Premieres in 5 hours": "premiere not yet available", "not available in your country": "geo-restricted video",
    "geo restriction: block": "geo-restricted video", "Join: members-only content": "members-only video", "Video unavailable": "video unavailable", "odd\nsecond line": "odd",
})
cases("date_tiers", lambda x: f"cast({scalars.date_similarity(f'timestamp_seconds(1709251200 + 3600 * cast({x} as bigint))', 'timestamp_seconds(1709251200)')} as double)", {"0": 1.0, "60": 1.0, "-60": 0.7, "240": 0.7, "-241": 0.15, "456": 0.15, "840": 0.15, "864": 0.0, "-1440": 0.0})
cases("bit_rate", lambda x: f"cast({scalars.bit_rate(f'cast(nullif(split({x}, chr(44))[0], chr(45)) as int)', f'cast(nullif(split({x}, chr(44))[1], chr(45)) as int)', f'split({x}, chr(44))[2] = chr(102)')} as string)", {"128,96,-": "96", "64,96,-": "64", "64,96,f": "96", "-,96,-": "96", "64,-,-": None})
cases("progress", lambda x: f"cast({scalars.progress(f'split({x}, chr(44))[0]', f'try_cast(split({x}, chr(44))[1] as int)', f'cast(split({x}, chr(44))[2] as int)', f'try_cast(split({x}, chr(44))[3] as int)', f'cast(split({x}, chr(44))[4] as int)')} as double)", {"finished,-,0,-,0": 1.0, "on,50,200,-,0": 0.25, "on,300,200,-,0": 1.0, "on,-,0,3,4": 0.75, "on,-,0,-,0": None})


def _base_date(d: text.Dialect) -> str:
    if d.spark:
        return "timestampadd(HOUR, cast(l_partkey % 50 as int) * 12 - cast(l_suppkey % 40 as int) * 12, l_shipdate)"
    return "(l_shipdate + to_hours(cast((l_partkey % 50) * 12 - (l_suppkey % 40) * 12 as integer)))"


projection("date_tiers", "lineitem", "l_orderkey, l_linenumber, l_partkey", lambda d: {"legacy": scalars.date_similarity("l_shipdate", _base_date(d), d), "kernel": scalars.date_similarity("l_shipdate", _base_date(d), d, truncate=True)})

# URLs, names, messages.
projection("path_stem", "pages", "page_id", lambda d: {"stem": scalars.stem("url", d), "suffix": scalars.suffix("url", d), "bucket": ("split_part(trim(BOTH '/' FROM url), '/', 1)" if d.spark else "split_part(trim(url, '/'), '/', 1)")})
projection("url_extract", "pages", "page_id", lambda d: {"n_links": f"cast({'size' if d.spark else 'len'}(regexp_extract_all(concat(url, ' and ', url, '/x'), {d.text(scalars.LINK)}, 0)) as int)", "video": scalars.video_id("concat('https://www.youtube.com/watch?v=', split_part(url, '/', 4), '&x=1')", d)})
projection("url_shape", "supplier", "s_suppkey", lambda d: {"url": scalars.channel_url("concat(case s_suppkey % 5 when 0 then 'https://youtube.com/@' when 1 then 'yt://@' when 2 then 'yt://#' when 3 then 'https://www.youtube.com/playlist?list=' else 'ftp://' end, replace(s_name, '#', '_'))", d)})
_MESSAGE = (
    "case event_type when 'error' then 'ERROR: Private video. Sign in' when 'click' then 'This content is not available in your country' when 'view' then 'Video unavailable' "
    "when 'signup' then concat('HTTP error ', event_id, ' of user ', user_id) else 'Join this channel: members-only content' end"
)
projection("error_reason", "events", "event_id", lambda d: {"reason": scalars.error_reason(_MESSAGE, d)})
projection("byte_format", "lineitem", "l_orderkey, l_linenumber, l_partkey", lambda d: {"size": scalars.byte_format("cast(l_quantity as bigint) * l_partkey * l_suppkey * 1000", d)})
projection("bit_rate", "part", "p_partkey", lambda d: {"rate": scalars.bit_rate("case when p_size % 7 = 0 then null else p_size * 1000 end", "case when p_size % 5 = 0 then null else 24000 end", "p_size % 11 = 0")})
projection("progress", "events", "event_id", lambda d: {"share": scalars.progress("case when event_type = 'signup' then 'finished' else 'downloading' end", "case when event_id % 3 = 0 then null else user_id end", "100", "event_id % 10", "10")})
projection("audio_filter", "pages", "page_id", lambda d: {"name": scalars.is_audio_name("concat(split_part(url, '?', 1), case page_id % 3 when 0 then '.mp3' when 1 then '.MP3' else '' end)", d), "link": scalars.is_audio_url("concat(url, case page_id % 4 when 0 then '.opus?x' else '' end)", d)})
projection("object_url", "supplier", "s_suppkey", lambda d: {"url": "concat_ws('/', 'https://cdn.example.com', 'bucket', nullif(case when s_nationkey % 3 = 0 then '' else cast(s_nationkey as varchar(9)) end, ''), s_name)".replace("varchar(9)", "string" if d.spark else "varchar")})
QUERIES["object_url"] = lambda spark, sf: table(spark, sf, "supplier").select("s_suppkey", sinks.object_url(F.lit("https://cdn.example.com/"), F.lit("bucket"), F.when(F.col("s_nationkey") % 3 == 0, "").otherwise(F.col("s_nationkey").cast("string")), F.col("s_name")).alias("url"))

# Filters.
FILTER = SourceFilter(include=("the", "de"), exclude=("^Is", "shouting", "thth"))


@query("title_filter", f"WITH t AS ({DOC_TITLE}) SELECT doc_id, title FROM t WHERE NOT regexp_matches(title, '(?i)^is') AND NOT regexp_matches(title, '(?i)shouting') AND NOT regexp_matches(title, '(?i)thth') AND regexp_matches(title, '(?i)the|de')")
def _title_filter(spark, sf):
    return rules.title_filter(table(spark, sf, "documents").select("doc_id", F.expr(title_of(SPARK)).alias("title")), FILTER)


@query("public_filter", "SELECT event_id FROM events WHERE event_type IN ('view', 'click', 'signup')")
def _public_filter(spark, sf):
    availability = F.when(F.col("event_type") == "view", None).when(F.col("event_type").isin("click", "signup"), "public").otherwise(F.col("event_type"))
    return table(spark, sf, "events").where(rules.public(availability)).select("event_id")


@query("rrule_day_filter", "SELECT event_id FROM events WHERE dayofweek(ts) IN (1, 4) OR (dayofmonth(ts) = 15) OR (date_diff('day', DATE '2024-01-02', CAST(ts AS DATE)) >= 0 AND date_diff('day', DATE '2024-01-02', CAST(ts AS DATE)) % 6 = 0)")
def _rrule(spark, sf):
    return rules.date_filter(table(spark, sf, "events"), ["FREQ=WEEKLY;BYDAY=MO,TH", "FREQ=MONTHLY;BYMONTHDAY=15", "DTSTART:20240102T000000\nRRULE:FREQ=DAILY;INTERVAL=6", "FREQ=SOMETIMES"], "ts").select("event_id")


@query("schedule_rules", "SELECT o_orderkey, dayofweek(o_orderdate) = 3 AS w, (dayofweek(o_orderdate) = 3 AND (date_diff('week', DATE '1995-01-02', CAST(o_orderdate AS DATE)) % 2 = 0) AND o_orderdate >= DATE '1995-01-03') AS biweekly, (month(o_orderdate) = 3 AND dayofmonth(o_orderdate) = 1 AND o_orderdate >= DATE '1996-03-01') AS yearly FROM orders")
def _schedule(spark, sf):
    o, day = table(spark, sf, "orders"), F.col("o_orderdate")
    return o.select("o_orderkey", rules.on_schedule(day, ["FREQ=WEEKLY;BYDAY=WE"]).alias("w"), rules.on_schedule(day, ["DTSTART:19950103T000000\nRRULE:FREQ=WEEKLY;INTERVAL=2;BYDAY=WE"]).alias("biweekly"), rules.on_schedule(day, ["DTSTART:19960301T000000\nRRULE:FREQ=YEARLY"]).alias("yearly"))


@query("rrule_standard", """SELECT event_id, dayofweek(ts) = 2 AND dayofmonth(ts) BETWEEN 8 AND 14 AS second_tuesday,
dayofmonth(ts) = dayofmonth(last_day(ts)) - CASE dayofweek(last_day(ts)) WHEN 0 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS last_workday, dayofyear(ts) IN (10, 20, 30) AS day_of_year, true AS hourly FROM events""")
def _rrule_standard(spark, sf):
    on = lambda rule: rules.on_schedule(F.col("ts"), [rule])
    return table(spark, sf, "events").select("event_id", on("FREQ=MONTHLY;BYDAY=2TU").alias("second_tuesday"), on("FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1").alias("last_workday"), on("FREQ=YEARLY;BYYEARDAY=10,20,30").alias("day_of_year"), on("FREQ=HOURLY;INTERVAL=5").alias("hourly"))


@query("due_shows", "SELECT n_name AS name FROM nation WHERE n_nationkey % 4 = 0 OR n_nationkey % 4 = 1 OR n_nationkey % 12 = 3")
def _due(spark, sf):
    """On Wednesday, 3 January 2024: no rule, weekly on Wednesday, weekly on Friday, first Wednesday or first Monday of the month."""
    import datetime as dt

    rule = F.when(F.col("n_nationkey") % 4 == 1, "FREQ=WEEKLY;BYDAY=WE").when(F.col("n_nationkey") % 4 == 2, "FREQ=WEEKLY;BYDAY=FR").when(F.col("n_nationkey") % 12 == 3, "FREQ=MONTHLY;BYDAY=1WE").when(F.col("n_nationkey") % 4 == 3, "FREQ=MONTHLY;BYDAY=1MO")
    shows = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.when(rule.isNull(), F.array().cast("array<string>")).otherwise(F.array(rule)).alias("schedule"))
    return rules.due(shows, dt.date(2024, 1, 3)).select("name")


@query("stage_ok", "SELECT user_id AS show, NOT bool_or(event_type = 'error' AND event_id % 2 = 0) AS ok FROM events GROUP BY user_id")
def _stage_ok(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("show"), "event_type", "event_id")
    errors = e.where("event_type in ('error', 'view')").select("show", F.expr("event_type = 'error' and event_id % 2 = 0").alias("fatal"))
    return workplan.stage_ok(errors, e)


@query("landed_versions", "SELECT user_id AS url, arg_max(event_id, event_id) FILTER (event_type <> 'view') AS body, max(event_id) AS checked_at FROM events GROUP BY user_id HAVING body IS NOT NULL")
def _landed(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("url"), F.col("event_id").alias("fetched_at"), F.when(F.col("event_type") == "view", 304).otherwise(200).alias("status"), F.col("event_id").alias("body"))
    return readers.latest(e).select("url", "body", "checked_at")


@query("listing_by_stem", "SELECT p_name AS stem, max(concat(p_name, CASE WHEN p_size % 2 = 0 THEN '.mp3' ELSE '.opus' END)) AS name FROM part GROUP BY p_name")
def _by_stem(spark, sf):
    name = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".mp3").otherwise(".opus"))
    objects = table(spark, sf, "part").select(F.lit("b").alias("bucket"), F.lit("").alias("prefix"), name.alias("name"), F.lit("e").alias("etag")).withColumn("stem", F.expr(scalars.stem("name")))
    return readers.by_stem(objects).select("stem", "name")


@query("incremental_ids", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)")
def _incremental(spark, sf):
    known = table(spark, sf, "supplier").where("s_nationkey < 12").select(F.col("s_suppkey").alias("id"))
    return readers.new_ids(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), known)


@query("upload_actions", "SELECT concat('k/', p_partkey, CASE WHEN p_size % 2 = 0 THEN '.m4a' ELSE '.mp3' END) AS key, CASE WHEN p_size % 2 = 0 THEN 'audio/mp4' ELSE 'audio/mpeg' END AS content_type, 'public-read' AS acl, CAST(p_size AS VARCHAR) AS duration, 8388608 AS part_bytes, 4 AS threads FROM part")
def _uploads(spark, sf):
    key = F.concat(F.lit("k/"), "p_partkey", F.when(F.col("p_size") % 2 == 0, ".m4a").otherwise(".mp3"))
    rows = table(spark, sf, "part").select(F.lit("b").alias("bucket"), key.alias("key"), F.lit("/x").alias("path"), F.create_map(F.lit("duration"), F.col("p_size")).alias("metadata"))
    return sinks.uploads(rows).select("key", "content_type", "acl", F.col("metadata")["duration"].alias("duration"), "part_bytes", "threads")


@query("epoch_seconds", "SELECT event_id, CAST(trunc(epoch_us(ts - INTERVAL 54 YEAR) / 1000000.0) AS BIGINT) AS seconds FROM events")
def _epoch_seconds(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(scalars.epoch_seconds("ts - interval 54 years")).alias("seconds"))


@query("tag_filter", "SELECT p_partkey FROM part WHERE lower(p_name) = 'red widget' OR lower(p_type) IN ('economy', 'promo') OR lower(p_brand) IN ('economy', 'promo')")
def _tags(spark, sf):
    p = table(spark, sf, "part")
    return p.where(rules.has_tag(F.col("p_name"), F.col("p_brand"), F.array("p_type", F.lit(" ")), ["RED WIDGET", " Economy ", "promo", ""])).select("p_partkey")


@query("freshness", "SELECT event_id, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) <= 12 * 3600000000 AS bundle, epoch_us(TIMESTAMP '2024-01-20') - epoch_us(ts) <= 3600000000 AS head, false AS refreshed FROM events")
def _fresh(spark, sf):
    now = F.lit("2024-01-20").cast("timestamp")
    return table(spark, sf, "events").select("event_id", rules.fresh(F.col("ts"), now, 12).alias("bundle"), rules.fresh(F.col("ts"), now, 1).alias("head"), rules.fresh(F.col("ts"), now, 1, True).alias("refreshed"))


@query("unexpired", "SELECT event_id FROM events WHERE event_type = 'view' OR ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-15'")
def _unexpired(spark, sf):
    e = table(spark, sf, "events").withColumn("expires_at", F.when(F.col("event_type") != "view", F.col("ts").cast("timestamp") + F.expr("interval 30 days")))
    return readers.unexpired(e, F.lit("2024-02-15").cast("timestamp")).select("event_id")


@query("source_dispatch", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'rss' ELSE 'video' END AS kind FROM supplier")
def _dispatch(spark, sf):
    url = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "https://feeds.example.com/").when(F.col("s_suppkey") % 3 == 1, "yt://@").otherwise("yt://#"), F.translate("s_name", "#", "_"))
    return table(spark, sf, "supplier").select("s_suppkey", readers.standard_registry().kind(url, {readers.rss_episodes: "rss", readers.video_episodes: "video"}).alias("kind"))


@query("coalesce_fields", "SELECT d.doc_id, coalesce(CASE WHEN quality = 1 THEN '' END, source) AS present, coalesce(nullif(CASE WHEN quality = 1 THEN '' END, ''), nullif(lang, ''), '') AS filled FROM documents d LEFT JOIN labels l USING (doc_id)")
def _coalesce(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("q", F.when(F.col("quality") == 1, ""))
    return d.select("doc_id", rules.first_value("q", "source").alias("present"), rules.first_filled("q", "lang").alias("filled"))


@query("conditional_enrich", "SELECT d.doc_id AS id, CASE WHEN d.doc_id % 3 = 0 OR d.doc_id % 5 = 0 THEN coalesce(l.quality, CASE WHEN d.doc_id % 3 <> 0 THEN 7 END) ELSE 7 END AS pub_date, CASE WHEN d.doc_id % 3 = 0 OR d.doc_id % 5 = 0 THEN coalesce(l.toxic, CASE WHEN d.doc_id % 5 <> 0 THEN 8 END) ELSE 8 END AS image, CASE WHEN (d.doc_id % 3 = 0 OR d.doc_id % 5 = 0) AND d.doc_id % 2 = 0 THEN coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'new' END, '') WHEN d.doc_id % 2 = 0 THEN '' ELSE d.lang END AS description FROM documents d LEFT JOIN labels l USING (doc_id)")
def _enrich(spark, sf):
    i = F.col("doc_id")
    episodes = table(spark, sf, "documents").select(i.alias("id"), F.when(i % 3 != 0, 7).alias("pub_date"), F.when(i % 5 != 0, 8).alias("image"), F.when(i % 2 == 0, "").otherwise(F.col("lang")).alias("description"))
    info = table(spark, sf, "labels").select(i.alias("id"), F.col("quality").alias("pub_date"), F.col("toxic").alias("image"), F.lit("new").alias("description"))
    return rules.enrich(episodes, info)


# Token sets: every pair of a part's name with its own noisy title.
def _token_pairs(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    a = linkage.with_tokens(p.select("p_partkey", F.lit("").alias("show"), F.expr("concat(p_name, ' part ', p_size % 3)").alias("title_n")), Alignment().stopwords)
    b = linkage.with_tokens(p.select("p_partkey", F.lit("").alias("show"), F.expr("concat(lower(p_type), ' ', p_name, case when p_size % 2 = 0 then ' may' else '' end, ' part ', p_size % 4)").alias("title_n")), Alignment().stopwords)
    left, right = linkage.sides(a, "a"), linkage.sides(b, "b")
    return left.drop("show").join(right.drop("show"), F.col("a_p_partkey") == F.col("b_p_partkey"))


_TOKENS = """WITH t AS (
  SELECT p_partkey, p_size % 3 AS x, p_size % 4 AS y,
    list_filter(list_distinct(string_split(concat(p_name, ' part ', p_size % 3), ' ')), lambda w: w <> 'part') AS a,
    list_filter(list_distinct(string_split(concat(lower(p_type), ' ', p_name, CASE WHEN p_size % 2 = 0 THEN ' may' ELSE '' END, ' part ', p_size % 4), ' ')), lambda w: w <> 'part') AS b
  FROM part), s AS (
  SELECT *, list_filter(a, lambda w: NOT list_contains(b, w)) AS only_a, list_filter(b, lambda w: NOT list_contains(a, w)) AS only_b, list_filter(a, lambda w: list_contains(b, w)) AS shared FROM t), e AS (
  SELECT *, CASE WHEN len(only_a) = 0 THEN only_b WHEN len(only_b) = 0 THEN only_a END AS extra FROM s) """


@query("anchor_overlap", _TOKENS + "SELECT p_partkey, CAST(len(shared) AS INTEGER) AS overlap, len(list_filter(shared, lambda w: (regexp_matches(w, '[0-9]') AND length(w) >= 2) OR (regexp_matches(w, '[A-Za-z]') AND length(w) >= 4))) > 0 AS discriminating FROM e")
def _anchor_overlap(spark, sf):
    both = F.array_intersect("a_anchors", "b_anchors")
    return _token_pairs(spark, sf).select(F.col("a_p_partkey").alias("p_partkey"), F.size(both).alias("overlap"), linkage.discriminating_overlap(both).alias("discriminating"))


@query("containment", _TOKENS + "SELECT p_partkey, (len(shared) = least(len(a), len(b)) AND least(len(a), len(b)) >= 2) AS inside FROM e")
def _containment(spark, sf):
    return _token_pairs(spark, sf).select(F.col("a_p_partkey").alias("p_partkey"), linkage.containment().alias("inside"))


@query("subset_extras", _TOKENS + "SELECT p_partkey, array_to_string(list_sort(extra), ' ') AS extra, len(list_filter(extra, lambda w: regexp_matches(w, '[A-Za-z]') AND w <> 'may')) > 0 AS discriminating FROM e")
def _subset_extras(spark, sf):
    rows = _token_pairs(spark, sf).withColumn("extra", linkage.subset_extra())
    return rows.select(F.col("a_p_partkey").alias("p_partkey"), F.array_join(F.array_sort("extra"), " ").alias("extra"), linkage.discriminating_extra(F.col("extra")).alias("discriminating"))


@query("marker_mismatch", _TOKENS + "SELECT p_partkey, x <> y AS mismatch FROM e")
def _marker_mismatch(spark, sf):
    return _token_pairs(spark, sf).select(F.col("a_p_partkey").alias("p_partkey"), linkage.marker_mismatch().alias("mismatch"))


_MARKS = ("listener tales episode ", "part ", "vol ", "episode ")


@query("marker_patterns", """SELECT p_partkey, (p_partkey % 4 = p_size % 4 OR (p_partkey % 4 = 0 AND p_size % 4 = 3) OR (p_partkey % 4 = 3 AND p_size % 4 = 0)) AND p_size % 3 <> p_size % 5 AS mismatch FROM part""")
def _marker_patterns(spark, sf):
    """All four kinds of marker, of one kind on both sides or of two ("listener tales episode N" is two at once)."""
    p = table(spark, sf, "part")
    mark = lambda key, n: "concat(p_name, ' ', case " + " ".join(f"when {key} % 4 = {i} then '{m}'" for i, m in enumerate(_MARKS)) + f" end, {n})"
    side = lambda key, n, name: linkage.sides(linkage.with_tokens(p.select("p_partkey", F.lit("").alias("show"), F.expr(mark(key, n)).alias("title_n")), ()), name).drop("show")
    both = side("p_partkey", "p_size % 3", "a").join(side("p_size", "p_size % 5", "b"), F.col("a_p_partkey") == F.col("b_p_partkey"))
    return both.select(F.col("a_p_partkey").alias("p_partkey"), linkage.marker_mismatch().alias("mismatch"))


# Similarity of all pairs of names of one brand.
def _names(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select("p_brand", "p_name").distinct()


_LCS = """WITH RECURSIVE n AS (SELECT DISTINCT p_brand, p_name FROM part), p AS (SELECT DISTINCT a.p_name AS a, b.p_name AS b FROM n a JOIN n b ON a.p_brand = b.p_brand),
tok AS MATERIALIZED (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb,
  array_to_string(list_sort(list_filter(list_distinct(string_split(a, ' ')), lambda w: NOT list_contains(string_split(b, ' '), w))), ' ') AS da,
  array_to_string(list_sort(list_filter(list_distinct(string_split(b, ' ')), lambda w: NOT list_contains(string_split(a, ' '), w))), ' ') AS db,
  length(array_to_string(list_filter(list_distinct(string_split(a, ' ')), lambda w: list_contains(string_split(b, ' '), w)), ' ')) AS s FROM p),
q AS MATERIALIZED (SELECT DISTINCT x, y FROM (SELECT a AS x, b AS y FROM tok UNION ALL SELECT sa, sb FROM tok UNION ALL SELECT da, db FROM tok)),
dp AS (
  SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda k: 0) AS r FROM q
  UNION ALL
  SELECT x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc,
    CASE WHEN substring(x, i + 1, 1) = substring(y, CAST(j AS BIGINT), 1) THEN r[j] + 1 ELSE greatest(r[j + 1], acc[j]) END), [0])
  FROM dp WHERE i < length(x)),
lcs AS MATERIALIZED (SELECT x, y, r[length(y) + 1] AS l FROM dp WHERE i = length(x)),
sim AS (SELECT a, b,
  2.0 * l0.l / (length(a) + length(b)) AS ratio, 2.0 * l1.l / (length(sa) + length(sb)) AS sorted,
  CASE WHEN s > 0 AND (da = '' OR db = '') THEN 1.0
       WHEN s > 0 THEN greatest(2.0 * (s + 1 + l2.l) / (2 * s + 2 + length(da) + length(db)), 2.0 * s / (2 * s + 1 + length(da)), 2.0 * s / (2 * s + 1 + length(db)))
       ELSE 2.0 * l2.l / (length(da) + length(db)) END AS sets
  FROM tok JOIN lcs l0 ON l0.x = a AND l0.y = b JOIN lcs l1 ON l1.x = sa AND l1.y = sb JOIN lcs l2 ON l2.x = da AND l2.y = db) """


def _similarity_query(name: str, udf, sql: str) -> None:
    def run(spark, sf):
        a, b = _names(spark, sf).withColumnRenamed("p_name", "a"), _names(spark, sf).withColumnRenamed("p_name", "b")
        return a.join(b, "p_brand").select("a", "b").distinct().select("a", "b", F.round(udf("a", "b"), 6).alias("sim"))

    QUERIES[name] = run
    ORACLE_SQL[name] = _LCS + f"SELECT a, b, round({sql}, 6) AS sim FROM sim"


_similarity_query("lcs_ratio", similarity.ratio, "ratio")
_similarity_query("token_sort_ratio", similarity.token_sort_ratio, "sorted")
_similarity_query("token_set_ratio", similarity.token_set_ratio, "sets")
_similarity_query("token_ratio", similarity.token_ratio, "greatest(sorted, sets)")
_similarity_query("blended_similarity", similarity.similarity, "0.4 * ratio + 0.3 * sorted + 0.3 * sets")


# Shows of documents: references and downloads by parity of doc_id div 20.
def sides_of_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "lang", "source").alias("show"), F.col("doc_id").alias("idx"), F.concat(F.lit("d"), F.col("doc_id")).alias("id"),
        F.expr(title_of(SPARK)).alias("title"), F.expr("substring(text, length(split_part(text, '\\n', 1)) + 2)").alias("description"),
        F.concat(F.lit("https://example.com/"), "doc_id", F.lit(".mp3")).alias("content"), F.lit(None).cast("string").alias("image"), F.expr("(doc_id div 20) % 2").alias("side"),
    )
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate").cast("timestamp")).alias("pub_date"))
    rows = docs.join(dates, "idx", "left")
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


# Parts as episodes: references and downloads by parity of the key.
def sides_of_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    columns = [F.expr(sql).alias(c) for c, sql in linkage_sql.EPISODE.items()]
    rows = table(spark, sf_dir, "part").select(*columns).withColumn("pub_date", F.timestamp_seconds(F.lit(1704067200) + F.col("hours") * 3600)).drop("hours")
    return rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("exact_backend", linkage_sql.EXACT)
def _exact(spark, sf):
    return linkage.align_scores(*sides_of_parts(spark, sf), semantics="exact")


for _name in ("legacy", "kernel"):
    QUERIES[f"pair_score_{_name}"] = lambda spark, sf, s=_name: _rounded(linkage.align_scores(*sides_of_parts(spark, sf), semantics=s))
    ORACLE_SQL[f"pair_score_{_name}"] = linkage_sql.PAIR_SCORES[_name]


@query("greedy_alignment", linkage_sql.ALIGNMENT)
def _alignment(spark, sf):
    return _rounded(assign.greedy_classes(linkage.align_classes(*sides_of_parts(spark, sf), least=None)))


@query("fold_dedup", linkage_sql.FOLD)
def _fold_dedup(spark, sf):
    return fuse.fold_dedup([*sides_of_parts(spark, sf)]).select("show", "idx", "id", "title")


@query("merged_episodes", linkage_sql.EPISODES)
def _merged(spark, sf):
    refs, dls = sides_of_parts(spark, sf)
    return _rounded(merge([refs], [dls], explain=False).episodes).withColumns({"source": F.array_join("source", ","), "upload_seconds": F.unix_seconds("upload_date")}).drop("upload_date")


@query("match_files", linkage_sql.FILES)
def _match_files(spark, sf):
    refs, dls = sides_of_parts(spark, sf)
    files = refs.select("show", "idx", F.expr(text.create_slug("title")).alias("stem"))
    return _rounded(match_titles(files, dls.select("show", "idx", "title")))


# The same over whole documents, whose long titles and descriptions the other engine cannot align in time.
@query("pair_score_documents")
def _document_scores(spark, sf):
    return _rounded(linkage.align_scores(*sides_of_documents(spark, sf)))


@query("merged_documents")
def _merged_documents(spark, sf):
    refs, dls = sides_of_documents(spark, sf)
    return merge([refs], [dls], explain=False).episodes


# Scored pairs of events: users against hours of the month, per kind of event; scores tie often.
def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("show"), F.col("user_id").alias("ref_idx"), (F.dayofmonth("ts") * 24 + F.hour("ts")).cast("bigint").alias("dl_idx"))
    return e.agg((F.count("*") / 10).alias("score")).withColumn("score", F.least(F.lit(1.0), F.col("score") + 0.55 + F.when((F.col("ref_idx") + F.col("dl_idx")) % 4 == 0, 0.2).otherwise(0.0)))


_SCORES = """n AS (SELECT event_type AS show, user_id AS ref_idx, dayofmonth(ts) * 24 + hour(ts) AS dl_idx, count(*) AS n FROM events GROUP BY ALL),
s AS MATERIALIZED (SELECT show, ref_idx, dl_idx, least(1.0::DOUBLE, n / 10.0::DOUBLE + 0.55::DOUBLE + CASE WHEN (ref_idx + dl_idx) % 4 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) AS score FROM n),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY show ORDER BY score DESC, ref_idx, dl_idx) AS k FROM s WHERE score >= 0.75),
g AS (
  SELECT show, 0::BIGINT AS k, []::BIGINT[] AS rs, []::BIGINT[] AS ds, NULL::BIGINT AS r, NULL::BIGINT AS d, NULL::DOUBLE AS sc FROM (SELECT DISTINCT show FROM o)
  UNION ALL
  SELECT g.show, o.k, CASE WHEN list_contains(rs, o.ref_idx) OR list_contains(ds, o.dl_idx) THEN rs ELSE list_append(rs, o.ref_idx) END,
    CASE WHEN list_contains(rs, o.ref_idx) OR list_contains(ds, o.dl_idx) THEN ds ELSE list_append(ds, o.dl_idx) END,
    CASE WHEN list_contains(rs, o.ref_idx) OR list_contains(ds, o.dl_idx) THEN NULL ELSE o.ref_idx END, o.dl_idx, o.score
  FROM g JOIN o ON o.show = g.show AND o.k = g.k + 1),
p AS MATERIALIZED (SELECT show, r AS ref_idx, d AS dl_idx, sc AS score, row_number() OVER (PARTITION BY show ORDER BY k) AS rank FROM g WHERE r IS NOT NULL)"""
_PAIRS = f"WITH RECURSIVE {_SCORES} "
for _method in ("fold", "grouped", "rounds"):
    QUERIES[f"greedy_{_method}"] = lambda spark, sf, m=_method: assign.greedy(event_scores(spark, sf), method=m)
    ORACLE_SQL[f"greedy_{_method}"] = _PAIRS + "SELECT show, ref_idx, dl_idx, score, rank FROM p"

_TOP = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY show, ref_idx ORDER BY score DESC, dl_idx) AS place FROM s),
top AS (SELECT r.show, r.ref_idx, r.dl_idx, r.score, CASE WHEN place <= 3 THEN place ELSE 4 END AS place, p.ref_idx IS NOT NULL AS matched
  FROM ranked r LEFT JOIN p ON p.show = r.show AND p.ref_idx = r.ref_idx AND p.dl_idx = r.dl_idx WHERE place <= 3 OR p.ref_idx IS NOT NULL),
why AS (SELECT show, ref_idx, dl_idx, score, place, CASE WHEN matched THEN 'matched' WHEN score < 0.75 THEN 'below_threshold'
  WHEN EXISTS (SELECT 1 FROM p WHERE p.show = top.show AND p.dl_idx = top.dl_idx) THEN 'download_matched_elsewhere'
  WHEN EXISTS (SELECT 1 FROM p WHERE p.show = top.show AND p.ref_idx = top.ref_idx) THEN 'reference_matched_elsewhere' ELSE 'not_selected' END AS reason FROM top) """


def _event_pairs(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = event_scores(spark, sf)
    return s, assign.greedy(s)


@query("top3_candidates", _PAIRS + _TOP + "SELECT show, ref_idx, dl_idx, score, place, matched FROM top")
def _top3(spark, sf):
    return trace.top_candidates(*_event_pairs(spark, sf))


@query("match_reasons", _PAIRS + _TOP + "SELECT show, ref_idx, dl_idx, score, place, reason FROM why")
def _reasons(spark, sf):
    return trace.candidate_reasons(*_event_pairs(spark, sf))


@query("best_candidate", _PAIRS + _TOP + "SELECT show, dl_idx, ref_idx, score, reason FROM why QUALIFY row_number() OVER (PARTITION BY show, dl_idx ORDER BY score DESC, ref_idx) = 1")
def _best(spark, sf):
    return trace.best_candidate(trace.candidate_reasons(*_event_pairs(spark, sf)))


@query("trace_report", _PAIRS + _TOP + "SELECT u.show, u.ref_idx, p.dl_idx AS matched_dl_idx, p.score AS matched_score, (SELECT string_agg(w.dl_idx || ':' || w.reason, ',' ORDER BY w.place) FROM why w WHERE w.show = u.show AND w.ref_idx = u.ref_idx) AS candidates FROM (SELECT DISTINCT show, ref_idx FROM s) u LEFT JOIN p ON p.show = u.show AND p.ref_idx = u.ref_idx")
def _trace_report(spark, sf):
    s, p = _event_pairs(spark, sf)
    out = trace.traces(s.select("show", F.col("ref_idx").alias("idx")).distinct(), s, p)
    return out.withColumn("candidates", F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["dl_idx"].cast("string"), c["reason"])), ","))


@query("unmatched_anti", _PAIRS + "SELECT DISTINCT show, dl_idx AS idx FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.show = s.show AND p.dl_idx = s.dl_idx)")
def _unmatched(spark, sf):
    s, p = _event_pairs(spark, sf)
    return workplan.unmatched(s.select("show", F.col("dl_idx").alias("idx")).distinct(), p)


@query("unmatched_references", _PAIRS + "SELECT show, count(*) AS n, string_agg(ref_idx || ':t' || ref_idx, ',' ORDER BY ref_idx) AS unmatched FROM (SELECT DISTINCT show, ref_idx FROM s) u WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.show = u.show AND p.ref_idx = u.ref_idx) GROUP BY show")
def _unmatched_refs(spark, sf):
    s, p = _event_pairs(spark, sf)
    refs = s.select("show", F.col("ref_idx").alias("idx"), F.concat(F.lit("t"), "ref_idx").alias("title")).distinct()
    return sinks.unmatched_report(refs, p).withColumn("unmatched", F.array_join(F.transform("unmatched", lambda x: F.concat_ws(":", x["idx"].cast("string"), x["title"])), ","))


_FUSE = """WITH a AS (SELECT doc_id, lang, text, {t} AS title FROM documents) SELECT a.doc_id AS ref_idx, b.doc_id AS dl_idx,
CASE WHEN a.doc_id % 2 = 0 OR b.doc_id % 3 <> 0 THEN CASE WHEN b.doc_id % 3 = 0 THEN 'https://e/' || b.doc_id ELSE 'd' || b.doc_id END ELSE 'r' || a.doc_id END AS id,
CASE WHEN length(b.title) > length(a.title) OR (length(b.title) = length(a.title) AND length(b.title) - length(replace(b.title, ':', '')) > length(a.title) - length(replace(a.title, ':', ''))) THEN b.title ELSE a.title END AS title,
CASE WHEN length(CASE WHEN b.doc_id % 5 = 0 THEN '' ELSE b.text END) > length(a.text) THEN b.text ELSE a.text END AS description,
'https://e/a' || a.doc_id || CASE WHEN a.doc_id % 4 = 0 THEN '' ELSE ',https://e/b' || b.doc_id END AS source,
CASE WHEN a.doc_id % 2 = 0 AND a.doc_id % 3 = 0 THEN 'https://i.ytimg.com/vi/x/maxresdefault.jpg' WHEN a.doc_id % 3 = 0 THEN 'https://i.ytimg.com/vi/y/hqdefault.jpg' WHEN a.doc_id % 2 = 0 THEN 'https://i.ytimg.com/vi/x/maxresdefault.jpg' ELSE 'https://i.ytimg.com/vi/y/hqdefault.jpg' END AS thumbnail,
least(CASE WHEN a.doc_id % 11 <> 0 THEN 1704067200 + a.doc_id % 50 * 86400 END, CASE WHEN b.doc_id % 13 <> 0 THEN 1704067200 + b.doc_id * 7 % 50 * 86400 END) AS upload_seconds
FROM a JOIN a AS b ON b.doc_id = a.doc_id + 1"""


@query("fuse_pairs", _FUSE.format(t=title_of(DUCK)))
def _fuse(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.expr(title_of(SPARK)).alias("title"))
    i = F.col("doc_id")
    cols = lambda ident, description, content, image: [F.lit("s").alias("show"), i.alias("idx"), ident.alias("id"), F.col("title"), description.alias("description"), content.alias("content"), image.alias("image"), F.lit(None).cast("timestamp").alias("pub_date")]
    refs = d.select(*cols(F.when(i % 2 == 0, F.concat(F.lit("http"), i)).otherwise(F.concat(F.lit("r"), i)), F.col("text"), F.concat(F.lit("https://e/a"), i), F.when(i % 3 == 0, F.lit(None)).otherwise(F.lit("https://cdn/hq.jpg")).cast("string")))
    refs = refs.withColumn("image", F.when(F.col("idx") % 2 == 0, "https://i.ytimg.com/vi/x/maxresdefault.jpg").when(F.col("idx") % 3 == 0, None).otherwise("https://cdn/cover.jpg"))
    dls = d.select(*cols(F.when(i % 3 == 0, F.concat(F.lit("https://e/"), i)).otherwise(F.concat(F.lit("d"), i)), F.when(i % 5 == 0, None).otherwise(F.col("text")), F.when((i - 1) % 4 == 0, "").otherwise(F.concat(F.lit("https://e/b"), i)), F.lit("https://i.ytimg.com/vi/y/hqdefault.jpg")))
    at = lambda days: F.timestamp_seconds(F.lit(1704067200) + days % 50 * 86400)
    refs = refs.withColumn("pub_date", F.when(F.col("idx") % 11 != 0, at(F.col("idx"))))
    dls = dls.withColumn("pub_date", F.when(F.col("idx") % 13 != 0, at(F.col("idx") * 7)))
    pairs = d.select(F.lit("s").alias("show"), i.alias("ref_idx"), (i + 1).alias("dl_idx"), F.lit(1.0).alias("score"), i.alias("rank"))
    return fuse.fuse(pairs, refs, dls).select("ref_idx", "dl_idx", "id", "title", "description", F.array_join("source", ",").alias("source"), "thumbnail", F.unix_seconds("upload_date").alias("upload_seconds"))


@query("slug_guard", f"""WITH t AS (SELECT doc_id, lang AS show, {text.create_slug(title_of(DUCK), DUCK)} AS slug FROM documents)
SELECT show, slug, doc_id AS idx FROM t WHERE doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM t m WHERE m.doc_id % 3 = 0 AND m.show = t.show AND m.slug = t.slug)""")  # fmt: skip
def _slug_guard(spark, sf):
    d = workplan.slugs(table(spark, sf, "documents").select(F.col("lang").alias("show"), F.col("doc_id").alias("idx"), F.expr(title_of(SPARK)).alias("title")))
    return workplan.removable(d, d.where("idx % 3 = 0").select("show", F.col("idx").alias("dl_idx"))).select("show", "slug", "idx")


@query("exists_any", "SELECT c_custkey, (c_custkey IN (SELECT s_suppkey FROM supplier) OR c_name IN (SELECT replace(s_name, 'Supplier', 'Customer') FROM supplier WHERE s_nationkey > 10) OR c_mktsegment IN (SELECT 'FURNITURE' FROM supplier WHERE s_acctbal < -990)) AS exists_on_s3 FROM customer")
def _exists_any(spark, sf):
    listing = table(spark, sf, "supplier").select("s_suppkey", F.expr("case when s_nationkey > 10 then replace(s_name, 'Supplier', 'Customer') end").alias("n"), F.expr("case when s_acctbal < -990 then 'FURNITURE' end").alias("seg"))
    return workplan.exists_any(table(spark, sf, "customer"), listing, {"c_custkey": "s_suppkey", "c_name": "n", "c_mktsegment": "seg"}).select("c_custkey", "exists_on_s3")


@query("key_resolution", "WITH l AS (SELECT concat(p_name, CASE WHEN p_size % 2 = 0 THEN '.mp3' ELSE '.opus' END) AS name, p_name AS slug FROM part) SELECT d.slug, min(l.name) AS object_name FROM (SELECT DISTINCT CASE WHEN p_size % 9 = 0 THEN 'none' ELSE p_name END AS slug FROM part) d LEFT JOIN l USING (slug) GROUP BY d.slug")
def _keys(spark, sf):
    p = table(spark, sf, "part")
    listing = p.select(F.concat("p_name", F.when(F.col("p_size") % 2 == 0, ".mp3").otherwise(".opus")).alias("name"))
    return workplan.resolve_keys(p.select(F.when(F.col("p_size") % 9 == 0, "none").otherwise(F.col("p_name")).alias("slug")).distinct(), listing)


_DUP_NAME = "concat(p_name, CASE WHEN p_size % 3 = 0 THEN ' (1)' WHEN p_size % 3 = 1 THEN ' (2)' ELSE '' END)"


@query("duplicate_groups", f"WITH n AS (SELECT DISTINCT {_DUP_NAME} AS name FROM part), k AS (SELECT name, regexp_replace(name, ' \\(\\d+\\)$', '') AS canonical FROM n) SELECT canonical, name FROM k WHERE name <> canonical AND canonical IN (SELECT name FROM k)")
def _duplicates(spark, sf):
    return workplan.duplicate_groups(table(spark, sf, "part").select(F.expr(_DUP_NAME).alias("name")), "regexp_replace(name, ' \\\\(\\\\d+\\\\)$', '')")


@query("segment_inversion", """WITH e AS (SELECT user_id AS video_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, event_id * 1.0::DOUBLE AS a, event_id + value / 100 AS b FROM events),
g AS (SELECT video_id, pos, lag(b, 1, 0.0) OVER (PARTITION BY video_id ORDER BY pos) AS a, a AS b FROM e
  UNION ALL SELECT video_id, max(pos) + 1, max_by(b, pos), 1000000.0 FROM e GROUP BY video_id)
SELECT video_id, pos, a AS "start", b AS "end" FROM g WHERE b - a >= 0.1""")  # fmt: skip
def _segments(spark, sf):
    from pyspark.sql import Window

    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("video_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint").alias("pos"), F.col("event_id").cast("double").alias("start"), (F.col("event_id") + F.col("value") / 100).alias("end"))
    return workplan.kept_segments(rows, e.select(F.col("user_id").alias("video_id"), F.lit(1000000.0).alias("total")).distinct())


_QUEUE = "SELECT o_orderpriority AS show, o_orderkey AS idx, o_orderstatus = 'F' AS exists_on_s3, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS pub_date, 'order ' || o_custkey AS title FROM orders"


def _queue(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderpriority").alias("show"), F.col("o_orderkey").alias("idx"), (F.col("o_orderstatus") == "F").alias("exists_on_s3"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("pub_date"), F.concat(F.lit("order "), "o_custkey").alias("title"))


@query("download_queue", f"SELECT show, idx, exists_on_s3, title, row_number() OVER (PARTITION BY show ORDER BY exists_on_s3, pub_date DESC NULLS LAST, title, idx) AS place FROM ({_QUEUE})")
def _download_queue(spark, sf):
    from pyspark.sql import Window

    return _queue(spark, sf).select("show", "idx", "exists_on_s3", "title", F.row_number().over(Window.partitionBy("show").orderBy(*workplan.queue_order(), "idx")).alias("place"))


@query("capped_plan", f"SELECT show, idx, title, row_number() OVER (ORDER BY show, pub_date DESC NULLS LAST, title, idx) AS place FROM ({_QUEUE}) WHERE NOT exists_on_s3 QUALIFY place <= 100")
def _capped(spark, sf):
    return workplan.capped(_queue(spark, sf), 100).select("show", "idx", "title", "place")


@query("group_fingerprint", f"WITH t AS ({DOC_TITLE}) SELECT lang, source, substring(md5(string_agg(doc_id || '|' || title, chr(10) ORDER BY doc_id || '|' || title)), 1, 16) AS fingerprint FROM t GROUP BY lang, source")
def _fingerprint(spark, sf):
    return workplan.fingerprint(table(spark, sf, "documents").withColumn("title", F.expr(title_of(SPARK))), ["lang", "source"], ["doc_id", "title"])


@query("source_counts", "SELECT lang AS show, array_to_string(list(n ORDER BY side, source), ',') AS counts FROM (SELECT lang, doc_id % 2 AS side, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def _counts(spark, sf):
    d = table(spark, sf, "documents").select(F.col("lang").alias("show"), F.when(F.col("doc_id") % 2 == 0, "reference").otherwise("download").alias("role"), F.col("source").alias("source_ord"))
    return sinks.source_counts(d).select("show", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query("profile_stats", "SELECT event_type, round(sum(value), 1) AS total, count(value) AS count, round(avg(value), 1) AS avg, round(min(value), 1) AS min, round(max(value), 1) AS max FROM events GROUP BY event_type")
def _profile(spark, sf):
    return workplan.profile(table(spark, sf, "events"), "event_type", "value")


@query("median_p95", "WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, median(value) AS median, max(value) FILTER (k = greatest(0, floor(0.95 * n) - 1) + 1) AS p95 FROM x GROUP BY event_type")
def _median(spark, sf):
    return workplan.median_p95(table(spark, sf, "events"), "event_type", "value")


@query("quality_gate", "SELECT coalesce(count(*) FILTER (toxic = 1 AND quality = 1)::DOUBLE / nullif(count(*) FILTER (toxic = 1), 0), 1.0) AS precision, coalesce(count(*) FILTER (toxic = 1 AND quality = 0)::DOUBLE / nullif(count(*) FILTER (quality = 0), 0), 0.0) AS false_positive_rate FROM labels")
def _quality(spark, sf):
    return workplan.quality(table(spark, sf, "labels").select((F.col("quality") == 1).alias("label"), (F.col("toxic") == 1).alias("predicted")), "label", "predicted")


@query("channel_header", "SELECT n_name AS show, n_name AS title, arg_min(CASE WHEN s_acctbal > 0 THEN s_name END, CASE WHEN s_acctbal > 0 THEN s_suppkey END) AS author FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def _header(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return workplan.header(s.select(F.col("n_name").alias("show"), F.col("s_suppkey").alias("source_ord"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise("").alias("author")), ["title", "author"])


@query("sponsor_segments", "SELECT event_id, event_id * 1.0::DOUBLE AS a, event_id + 0.5::DOUBLE AS b FROM events WHERE event_type IN ('view', 'click')")
def _sponsors(spark, sf):
    item = "concat('{\"segment\":[', cast(event_id as double), ',', event_id + 0.5D, '],\"UUID\":\"u', event_id, '\",\"category\":\"', if(event_type = 'error', 'bad', 'sponsor'), '\",\"actionType\":\"skip\",\"videoDuration\":10.0}')"
    body = F.expr(f"case when event_type = 'click' then concat('[{{\"segments\":[', {item}, ']}}]') when event_type = 'purchase' then 'oops' when event_type = 'signup' then '[]' else concat('[', {item}, ']') end")
    return table(spark, sf, "events").select("event_id", F.explode(readers.skip_segments(body)).alias("s")).select("event_id", F.col("s.start").alias("a"), F.col("s.end").alias("b"))


@query("insert_only_upsert", "WITH old AS (SELECT user_id AS id, min(event_id) AS v FROM events WHERE event_type = 'view' AND user_id % 2 = 0 GROUP BY user_id) SELECT * FROM old UNION ALL SELECT user_id, min(event_id) FROM events WHERE event_type IN ('click', 'view') AND user_id NOT IN (SELECT id FROM old) GROUP BY user_id")
def _upsert(spark, sf):
    e = table(spark, sf, "events")
    old = e.where("event_type = 'view' and user_id % 2 = 0").groupBy(F.col("user_id").alias("id")).agg(F.min("event_id").alias("v"))
    new = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("v"), F.expr("case when event_type = 'view' then null when event_type = 'click' then 'public' else 'private' end").alias("availability"))
    return upsert.insert_only(old, new, "id", "v").select("id", "v")


@query("backend_diff", f"""WITH t AS (SELECT doc_id, {text.create_slug(title_of(DUCK), DUCK)} AS s, replace({text.normalize_text(title_of(DUCK), DUCK)}, ' ', '-') AS n FROM documents)
SELECT doc_id, s AS title, 'primary' AS side FROM t WHERE s <> n UNION ALL SELECT doc_id, n, 'candidate' FROM t WHERE s <> n""")  # fmt: skip
def _diff(spark, sf):
    d = table(spark, sf, "documents")
    return upsert.difference(d.select("doc_id", F.expr(text.create_slug(title_of(SPARK))).alias("title")), d.select("doc_id", F.expr(f"replace({text.normalize_text(title_of(SPARK))}, ' ', '-')").alias("title")))


@query("report_json", """SELECT event_type AS show, count(*) AS merged_count, '[' || string_agg('{"id":"' || user_id || '","title":"' || event_type || ' ' || event_id % 7 || '","source":["x"],"upload_date":"2024-01-0' || (1 + event_id % 9) || 'T00:00:00.000Z"}', ',' ORDER BY event_id) || ']' AS episodes FROM events GROUP BY event_type""")
def _report(spark, sf):
    day = F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") % 9 * 86400)
    title = F.concat_ws(" ", "event_type", (F.col("event_id") % 7).cast("string"))
    e = table(spark, sf, "events").select(F.col("event_type").alias("show"), F.col("event_id").alias("rank"), F.col("user_id").cast("string").alias("id"), title.alias("title"), F.lit("").alias("description"), F.array(F.lit("x")).alias("source"), F.lit(None).cast("string").alias("thumbnail"), day.alias("upload_date"))
    return sinks.report(e, describe=False)


@query("rss_items", "SELECT p_partkey, '<item><guid>' || p_partkey || '</guid><title>' || p_name || ' &amp; co</title><enclosure url=\"https://e/' || p_partkey || '.mp3\" type=\"audio/mpeg\"/><itunes:duration>' || p_size || '</itunes:duration></item>' AS item FROM part")
def _rss(spark, sf):
    p = table(spark, sf, "part")
    row = {"id": F.col("p_partkey").cast("string"), "title": F.concat("p_name", F.lit("\u0001 & co")), "description": F.lit(""), "content": F.concat(F.lit("https://e/"), "p_partkey", F.lit(".mp3")), "pub_date": F.lit(None).cast("timestamp"), "duration": F.col("p_size") + 0.5, "image": F.lit("none")}
    return p.select("p_partkey", sinks.rss_item(row).alias("item"))


@query("negative_cache", "SELECT e.event_id, (e.user_id % 2 <> 0 AND e.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND ts > TIMESTAMP '2024-01-24')) AS fetch FROM events e")
def _negative_cache(spark, sf):
    e = table(spark, sf, "events").withColumn("video_id", F.col("user_id"))
    info = e.where("user_id % 2 = 0").select("video_id").distinct()
    failed = e.where("event_type = 'error'").select("video_id", F.col("ts").alias("failed_at"))
    return download.looked_up(e, info, failed, F.lit("2024-01-31").cast("timestamp")).select("event_id", "fetch")


@query("sponsor_join", "WITH s AS (SELECT user_id, count(*) AS n, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR END AS video_id, coalesce(s.n, 0) AS n, round(coalesce(s.v, 0.0), 4) AS v FROM customer LEFT JOIN s ON s.user_id = c_custkey AND c_custkey % 2 = 0")
def _sponsor_join(spark, sf):
    segments = table(spark, sf, "events").where("event_type = 'view'").select(F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("pos"), F.lit(0.0).alias("start"), F.col("value").alias("end"))
    rows = table(spark, sf, "customer").withColumn("content", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), "c_custkey")).otherwise("https://a.example/x.mp3"))
    out = download.with_segments(rows, segments)
    return out.select("c_custkey", "video_id", F.size("sponsor_segments").cast("bigint").alias("n"), F.round(F.aggregate("sponsor_segments", F.lit(0.0), lambda acc, x: acc + x["end"]), 4).alias("v"))


@query("download_plan", linkage_sql.PLAN)
def _download_plan(spark, sf):
    refs, dls = sides_of_parts(spark, sf)
    listing = dls.where("idx % 3 = 0").select(F.expr(text.create_slug("title")).alias("stem"), F.col("content").alias("source"), F.lit(None).cast("string").alias("video_id"))
    segments = spark.createDataFrame([], "video_id string, pos bigint, start double, end double")
    return download.queue(merge([refs], [dls], explain=False), segments, listing, 1000).select("show", "idx", "title", "place")


# SHOW is a reserved word of the other engine.
for _name, _sql in ORACLE_SQL.items():
    ORACLE_SQL[_name] = re.sub(r'(?<!")\bshow\b(?!")', '"show"', _sql)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused episodes of all shows."""
    return _merged_documents(spark, sf_dir)


