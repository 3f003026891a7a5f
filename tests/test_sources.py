import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from feedweave import config
from feedweave.sources import readers, sinks
from feedweave.streaming import upserts

FEED = """<rss xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd"><channel><title>Show</title><link>http://s</link><description>d</description>
<item><guid isPermaLink="false">g1</guid><title>One</title><pubDate>Tue, 02 Jan 2024 10:00:00 +0000</pubDate><itunes:duration>1:00</itunes:duration><enclosure url="http://a/1.mp3" type="audio/mpeg"/></item>
<item><guid>g2</guid><title>Two</title><enclosure url="http://a/2.txt"/></item></channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    good, bad = readers.rss_episodes(spark, str(tmp_path / "f.xml"), "Show")
    row = good.first()
    assert (row["id"], row["idx"], row["content"], row["duration"], str(row["pub_date"])) == ("g1", 0, "http://a/1.mp3", 60.0, "2024-01-02 10:00:00")
    assert [r["id"] for r in bad.collect()] == ["g2"]
    assert readers.rss_channels(spark, str(tmp_path / "f.xml")).first()["title"] == "Show"


def test_videos(spark, tmp_path):
    (tmp_path / "v.json").write_text("\n".join(json.dumps(x) for x in [{"id": "a", "title": "A", "timestamp": 0}, {"id": "b", "upload_date": "20240102", "availability": "private", "thumbnails": [{"url": "u1"}, {"url": "u2"}]}]))
    rows = {r["id"]: r for r in readers.video_episodes(readers.videos(spark, str(tmp_path / "v.json"))).collect()}
    assert (rows["a"]["content"], rows["a"]["availability"], str(rows["a"]["pub_date"])) == ("https://youtube.com/watch?v=a", "public", "1970-01-01 00:00:00")
    assert (rows["b"]["image"], str(rows["b"]["pub_date"])) == ("u2", "2024-01-02 00:00:00")


def test_segments_reject_a_list_with_one_bad_item(spark):
    item = {"segment": [1, 2], "UUID": "u", "category": "sponsor", "actionType": "skip"}
    bodies = [json.dumps([item]), json.dumps([{"segments": [item]}]), json.dumps([item, item | {"category": "x"}]), "oops", None]
    got = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", F.size(readers.skip_segments(F.col("b"))).alias("n")).orderBy("i").collect()
    assert [r["n"] for r in got] == [1, 1, -1, -1, -1] or [r["n"] for r in got] == [1, 1, None, None, None]


def test_listing_and_registry(spark, tmp_path):
    (tmp_path / "x.y.mp3").write_text("a")
    assert readers.listing(spark, str(tmp_path)).first()["stem"] == "x.y"
    r = readers.standard_registry()
    assert r.choose("yt://@abc") is readers.video_episodes
    assert r.choose("https://feeds/x") is readers.rss_episodes


def test_metadata_is_all_or_nothing(spark):
    ok = {"duration": "1.5", "source": "s", "upload_date": "2024-01-01", "sponsors_removed": "true"}
    rows = spark.createDataFrame([(1, ok), (2, ok | {"duration": "x"})], "i int, metadata map<string,string>")
    assert [r["duration"] for r in readers.object_metadata(rows).orderBy("i").collect()] == [1.5, None]


def test_rss_document(spark):
    channel = spark.createDataFrame([("s", "S & T", "http://s", "", "A", ""), ("empty", "E", "", "", "", "")], "show string, title string, url string, description string, author string, subtitle string")
    items = spark.createDataFrame([("s", 1, "i", "t\x01<", None, "http://a/1.m4a", None, 61.9, "http://i")], "show string, rank int, id string, title string, description string, content string, pub_date timestamp, duration double, image string")
    rows = sinks.rss_documents(channel, items).collect()
    assert len(rows) == 1
    assert all(x in rows[0]["xml"] for x in ("<title>S &amp; T</title>", "<title>t&lt;</title>", 'type="audio/mp4"', "<itunes:duration>61<", 'href="http://i"'))


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('[[podcasts]]\nname = "My Show"\ntags = ["T"]\n[[podcasts.references]]\nurl = "u"\n[podcasts.alignment]\nmatch_tolerance = 0.8\n[podcasts.alignment.weights]\ntitle = 1\n')
    show = config.load(str(tmp_path / "c.toml"))[0]
    assert (show.slug, show.path, show.alignment.match_tolerance, show.alignment.weights.title) == ("my-show", "/media/podcasts/my-show", 0.8, 1.0)
    assert config.tagged([show], ["t"]) == [show] and config.tagged([show], ["x"]) == [] and config.tagged([show], [" "]) == [show]
    with pytest.raises(ValueError, match="unknown"):
        config.parse(config.Show, {"name": "x", "feeds": []})
    with pytest.raises(ValueError, match="missing"):
        config.parse(config.Show, {})
    assert json.loads(config.json_schema())["properties"]["name"] == {"type": "string"}


def test_streaming_upsert(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    for n, rows in enumerate([[("1", "a")], [("1", "b"), ("2", "c")]]):
        spark.createDataFrame(rows, "id string, v string").coalesce(1).write.mode("append").parquet(str(source))
        upserts.upsert_into(spark.readStream.schema("id string, v string").parquet(str(source)), str(out), str(tmp_path / "ck"))
    assert sorted(map(tuple, spark.read.parquet(str(out)).collect())) == [("1", "a"), ("2", "c")]


def test_bundles(spark, tmp_path):
    rows = spark.createDataFrame([("My Show", 1), ("Other", 2)], "show string, rank int")
    sinks.bundles(rows, str(tmp_path / "b"))
    assert sorted(p.name for p in (tmp_path / "b").iterdir() if p.is_dir()) == ["slug=my-show", "slug=other"]


def test_merge_from_configuration(spark, tmp_path):
    """Sources are dispatched by URL, filtered by their own patterns and days, merged with their show's own rules, and bundled."""
    from feedweave.operators.events import Timings
    from feedweave.plans import series

    item = lambda n, title, day: f'<item><guid>r{n}</guid><title>{title}</title><pubDate>{day}</pubDate><enclosure url="http://a/{n}.mp3"/></item>'
    feed = "<rss><channel><title>S</title>" + item(1, "Lost City Haunting | Show", "Tue, 02 Jan 2024 10:00:00 +0000") + item(2, "Trailer", "Tue, 02 Jan 2024 10:00:00 +0000") + item(3, "River Story", "Wed, 03 Jan 2024 10:00:00 +0000") + "</channel></rss>"
    (tmp_path / "a.xml").write_text(feed)
    (tmp_path / "v.json").write_text("\n".join(json.dumps(x) for x in [{"id": "v1", "title": "Lost City Haunting", "upload_date": "20240103"}, {"id": "v2", "title": "Lost City Haunting", "availability": "private"}, {"id": "v3", "title": "Other"}]))
    (tmp_path / "c.toml").write_text("""
[[podcasts]]
name = "First Show"
[[podcasts.references]]
url = "https://feeds/a"
[podcasts.references.filters]
exclude = ["trailer"]
r_rules = ["FREQ=WEEKLY;BYDAY=TU"]
[[podcasts.downloads]]
url = "yt://@first"
[podcasts.cleanup.title_normalization]
suffix_patterns = ['\\s*\\| Show$']
[[podcasts]]
name = "Quiet Show"
schedule = ["FREQ=WEEKLY;BYDAY=SU"]
[[podcasts.references]]
url = "https://feeds/a"
""")
    shows = config.load(str(tmp_path / "c.toml"))
    landed = {"https://feeds/a": str(tmp_path / "a.xml"), "yt://@first": str(tmp_path / "v.json")}.__getitem__
    timings = Timings()
    out = series.run(spark, shows, landed, dt.date(2024, 1, 2), timings=timings)
    assert [s.name for s in out.shows] == ["First Show"] and "align_episodes=" in timings.line("all")
    assert [(r["id"], r["title"], r["rank"]) for r in out.merged.episodes.collect()] == [("v1", "Lost City Haunting | Show", 1)]
    assert {r["show"]: r["counts"] for r in out.counts.collect()} == {"First Show": [1, 2]}
    sinks.series(spark, shows, out.reports, "file://" + str(tmp_path / "out"), "now")
    read = lambda name: json.loads((tmp_path / "out" / name).read_text())
    assert read("first-show/config.json")["slug"] == "first-show" and read("first-show/feeds/combined.json")["episodes"][0]["id"] == "v1"
    assert read("quiet-show/feeds/combined.json")["merged_count"] == 0
    assert read("index.json") == {"generated_at": "now", "series": [{"name": n, "slug": s, "directory": s, "config": f"{s}/config.json", "feeds": {"combined": f"{s}/feeds/combined.json"}} for n, s in (("First Show", "first-show"), ("Quiet Show", "quiet-show"))]}
    assert [r["merged_count"] for r in read("report.json")] == [1, 0]
    assert [s.name for s in series.run(spark, shows, landed).shows] == ["First Show", "Quiet Show"]


def test_landed_versions_and_listings(spark, tmp_path):
    rows = [("u", 1, 200, "a"), ("u", 2, 200, "b"), ("u", 3, 304, None), ("w", 1, 200, "c")]
    got = readers.latest(spark.createDataFrame(rows, "url string, fetched_at int, status int, body string")).collect()
    assert {r["url"]: (r["body"], r["fetched_at"], r["checked_at"]) for r in got} == {"u": ("b", 2, 3), "w": ("c", 1, 1)}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert [r["id"] for r in readers.new_ids(ids("a", "b", "c"), ids("a", "c", "c")).collect()] == ["b"]
    (tmp_path / "deep").mkdir()
    for name in ("x.mp3", "x.opus", "y.mp3", "deep/z.mp3"):
        (tmp_path / name).write_text(name)
    assert readers.listing(spark, str(tmp_path)).count() == 4
    direct = readers.listing(spark, str(tmp_path), recursive=False)
    assert sorted(r["name"] for r in direct.collect()) == ["x.mp3", "x.opus", "y.mp3"]
    assert {r["stem"]: r["name"] for r in readers.by_stem(direct).collect()} == {"x": "x.opus", "y": "y.mp3"}


def test_actions_and_cached_tables(spark, tmp_path):
    rows = spark.createDataFrame([("b", "k/a.m4a", "/tmp/a", {"duration": "1"})], "bucket string, key string, path string, metadata map<string,string>")
    got = sinks.uploads(rows).first()
    assert (got["content_type"], got["acl"], got["part_bytes"], got["threads"], got["metadata"]) == ("audio/mp4", "public-read", 8 << 20, 4, {"duration": "1"})
    cache = spark.createDataFrame([("b", "k/a.m4a", 1), ("b", "z", 2)], "bucket string, key string, n int")
    assert [r["n"] for r in sinks.invalidated(cache, rows).collect()] == [2]
    sinks.put_cached(cache, str(tmp_path / "cached"))
    sinks.put_cached(cache.limit(1), str(tmp_path / "cached"))
    assert spark.read.parquet(str(tmp_path / "cached")).count() == 1
