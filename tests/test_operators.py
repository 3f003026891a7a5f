import datetime as dt
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedweave.config import Alignment, SourceFilter, Weights
from feedweave.operators import alike, assign, blocks, fuse, linkage, rules, trace, upsert, workplan
from feedweave.plans.merge import match_titles, merge

ROW = "show string, idx bigint, id string, title string, description string, pub_date timestamp"
DAY = dt.datetime(2024, 3, 1)


def scores_of(spark, refs, dls, semantics="legacy", explicit=False, alignment=Alignment(), **how):
    """Scores in blocks, or (explicit) by the column expressions over every pair."""
    frame = lambda rows: spark.createDataFrame([("s", i, *r) for i, r in enumerate(rows)], ROW)
    if explicit:
        a, b = linkage.features(frame(refs), alignment), linkage.features(frame(dls), alignment)
        found = linkage.score(linkage.all_pairs(a, b), alignment, semantics).where("score > 0")
    elif how:
        found = blocks.scores(linkage.features(frame(refs), alignment), linkage.features(frame(dls), alignment), alignment, semantics, **how)
    else:
        found = linkage.align_scores(frame(refs), frame(dls), alignment, semantics=semantics)
    return {(r["ref_idx"], r["dl_idx"]): round(r["score"], 6) for r in found.collect()}


def test_same_id_with_other_part(spark):
    refs, dls = [("x", "Case Part 1", "", None)], [("x", "Case Part 2", "", None)]
    assert scores_of(spark, refs, dls) == {}
    assert scores_of(spark, refs, dls, "kernel") == {(0, 0): 1.0}


def test_day_delta_is_asymmetric_in_legacy_only(spark):
    early, late = DAY, DAY + dt.timedelta(hours=60)
    pair = lambda a, b, s: scores_of(spark, [("a", "the lost city haunting", "d", a)], [("b", "lost city haunting again here", "d", b)], s)[0, 0]
    assert pair(early, late, "legacy") != pair(late, early, "legacy")
    assert pair(early, late, "kernel") == pair(late, early, "kernel")


def test_rejects(spark):
    assert scores_of(spark, [("a", "moon landing", "", None)], [("b", "sun eclipse", "", None)]) == {}
    assert scores_of(spark, [("a", "moon", "", None)], [("b", "moon landing hoax", "", None)]) == {}  # sparse
    assert scores_of(spark, [("a", "listener tales 7", "", None)], [("b", "listener tales 8", "", None)]) == {}
    assert scores_of(spark, [("a", "", "", None)], [("b", "", "", None)]) == {}
    assert scores_of(spark, [], [("b", "x", "", None)]) == {}


def test_blocks_equal_all_pairs(spark):
    """Over the whole alphabet of normalised titles, with ids, dates, descriptions, markers and several chunks."""
    rng = random.Random(3)
    words = ["moon", "haunting", "family", "the", "part 1", "part 2", "episode 5", "river", "rivers", "may", "ghost", "ghosts", "a_b_c_d", "a_b_c_e", "x", "99", "Vol. 3"]
    rows = lambda p: [(f"{p}{i % 9}" if i % 3 else "", " ".join(rng.choices(words, k=rng.randint(0, 5))), rng.choice(["", "same", "other text", "same text here"]), rng.choice([None, DAY, DAY + dt.timedelta(days=9), DAY - dt.timedelta(hours=60)])) for i in range(60)]
    refs, dls = rows("x"), rows("x")
    for semantics in ("legacy", "kernel", "token_ratio", "exact"):
        want = scores_of(spark, refs, dls, semantics, True)
        assert scores_of(spark, refs, dls, semantics) == want
        if semantics != "exact":
            assert scores_of(spark, refs, dls, semantics, chunk=17, least=0.6) == {k: v for k, v in want.items() if v >= 0.6}
    assert all(0 < v <= 1 for v in scores_of(spark, refs, dls).values())


def test_titles_that_dates_rule_out_are_not_compared(monkeypatch):
    """A common word does not make a pair of titles compared whose dates are too far apart for the tolerance."""
    seen = []
    whole = blocks.similarity.blended
    monkeypatch.setattr(blocks.similarity, "blended", lambda a, b, kernel=False: seen.extend(zip(a, b)) or whole(a, b, kernel))

    def side(titles, day):
        n = len(titles)
        rows = {"idx": range(n), "id": [""] * n, "desc_n": ["d"] * n, "micros": [day * blocks._DAY] * n, "title_n": titles, "anchors": [t.split() for t in titles], "markers": [[None]] * n}
        return blocks.Side(pa.table({c: pa.array(list(x), pa.list_(pa.string()) if c in ("anchors", "markers") else None) for c, x in rows.items()}))

    a, b = ["haunted river house", "moon over water"], ["haunted lake place", "moon over water"]
    found = blocks.Block(side(a, 0), side(b, 400), Alignment(), "legacy").scores(0.75)
    assert [x.tolist() for x in found[:2]] == [[1], [1]]
    assert (a[1], b[1]) in seen and (a[0], b[0]) not in seen


@pytest.mark.parametrize("seed", range(4))
def test_bounds_lose_no_pair(spark, seed):
    """Titles without common anchors around the limit, of every character that normalisation keeps."""
    rng = random.Random(seed)
    alphabet = "ab_9z " if seed % 2 else "abcdefghijklmnopqrstuvwxyz0123456789_ "
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))) for _ in range(12)]
    near = lambda t: "".join(c if rng.random() > 0.12 else rng.choice(alphabet) for c in t)
    refs, dls = ([("", near(rng.choice(base)), "same", None) for _ in range(40)] for _ in range(2))
    assert scores_of(spark, refs, dls) == scores_of(spark, refs, dls, explicit=True)


def test_alignment_by_show(spark):
    """Weights, stop words and tolerance of each show apply to its own rows."""
    frame = lambda title, day: spark.createDataFrame([(show, 0, show + title, title, "d", day) for show in ("a", "b", "c")], ROW)
    refs, dls = frame("lost city haunting", DAY), frame("lost city haunting again here", DAY + dt.timedelta(days=30))
    own = {"b": Alignment(weights=Weights(date=0.01), match_tolerance=0.9), "c": Alignment(extra_stopwords=("again", "here", "lost"))}
    got = {r["show"]: r["score"] for r in linkage.align_scores(refs, dls, own).collect()}
    one = lambda how: linkage.align_scores(refs, dls, how).where("show = 'a'").first()["score"]
    assert got == {"a": one(Alignment()), "b": one(own["b"]), "c": one(own["c"])} and len(set(got.values())) >= 2
    scores = spark.createDataFrame([("a", 0, 0, 0.8), ("b", 0, 0, 0.8)], "show string, ref_idx bigint, dl_idx bigint, score double")
    assert [r["show"] for r in assign.greedy(scores, own).collect()] == ["a"]


def test_long_strings_are_compared_whole():
    from feedweave.functions import similarity

    rng = random.Random(8)
    a = ["".join(rng.choices("abcé ", k=rng.randint(300, 900))) for _ in range(6)]
    b = [x[: len(x) // 2] + "zz" + x[len(x) // 2 :] for x in a]
    assert similarity.lcs_lengths(a, b).tolist() == [len(x) for x in a]


def plain_greedy(rows, tolerance):
    refs, dls, out = set(), set(), []
    for s, r, d in sorted(((s, r, d) for r, d, s in rows), key=lambda x: (-x[0], x[1], x[2])):
        if s >= tolerance and r not in refs and d not in dls:
            refs.add(r)
            dls.add(d)
            out.append((r, d))
    return out


def test_assignment_forms_agree(spark):
    rng = random.Random(9)
    rows = [(r, d, round(rng.random() * 20) / 20) for r in range(12) for d in range(15) if rng.random() < 0.6] + [(100 + i, 200 + j, 0.9) for i in range(4) for j in range(4)]
    df = spark.createDataFrame([("s", *x) for x in rows], "show string, ref_idx bigint, dl_idx bigint, score double")
    want = plain_greedy(rows, 0.5)
    for method in ("fold", "grouped", "rounds", "auto"):
        got = assign.greedy(df, Alignment(match_tolerance=0.5), method).orderBy("rank").collect()
        assert [(r["ref_idx"], r["dl_idx"]) for r in got] == want
    assert assign.greedy(df.limit(0)).count() == 0


def test_classes_are_assigned_as_their_rows():
    rng = random.Random(4)
    for _ in range(300):
        refs, dls = ({c: sorted(rng.sample(range(c, 60, 6), rng.randint(1, 6)), reverse=True) for c in range(6)} for _ in range(2))
        edges = [(rng.choice([0.8, 0.9, 1.0]), x, y) for x in refs for y in dls if rng.random() < 0.5]
        want = plain_greedy([(r, d, s) for s, x, y in edges for r in refs[x] for d in dls[y]], 0.5)
        assert [(r, d) for r, d, _ in alike.assigned(edges, refs, dls)] == want


def test_equal_rows_are_scored_once(spark, monkeypatch):
    """Copies reach the blocks as one row, and every pair of copies comes out."""
    given = []

    def counted(a, b, *args, _scores=blocks.scores, **how):
        given.append((a.count(), b.count()))
        return _scores(a, b, *args, **how)

    monkeypatch.setattr(blocks, "scores", counted)
    titles = ["the big moon landing", "another story told", "third tale entirely"]
    rows = [("s", i, "", titles[i % 3], "", None, f"c{i}", None) for i in range(60)]
    frame = spark.createDataFrame(rows, ROW + ", content string, image string")
    pairs = linkage.align_scores(frame, frame)
    assert {(r["ref_idx"], r["dl_idx"]) for r in pairs.where("score = 1").collect()} == {(i, j) for i in range(60) for j in range(60) if i % 3 == j % 3}
    every = [(i, i, i + 1) for i in range(60)]
    assert [(r["ref_idx"], r["dl_idx"], r["rank"]) for r in merge([frame], [frame], explain=False).pairs.orderBy("rank").collect()] == every
    assert [(r["ref_idx"], r["dl_idx"], r["rank"]) for r in match_titles(frame.withColumnRenamed("title", "stem"), frame).orderBy("rank").collect()] == every
    assert fuse.fold_dedup([frame, frame.limit(40)]).count() == 60
    assert given == [(3, 3)] * 4


def test_fusion(spark):
    row = lambda i, **k: spark.createDataFrame([("s", 0, i, k.get("title", "t"), k.get("d"), k.get("c"), k.get("image"), k.get("date"))], "show string, idx bigint, id string, title string, description string, content string, image string, pub_date timestamp")
    pairs = spark.createDataFrame([("s", 0, 0, 0.9, 1)], "show string, ref_idx bigint, dl_idx bigint, score double, rank bigint")
    got = fuse.fuse(pairs, row("http://r", title="a:b", d="xx", c="u2", image="http://c/a.jpg", date=DAY), row("d", title="abc", d=None, c="u1", image="http://i/maxresdefault.jpg")).first()
    assert (got["id"], got["title"], got["description"], got["source"], got["thumbnail"], got["upload_date"]) == ("d", "a:b", "xx", ["u1", "u2"], "http://i/maxresdefault.jpg", DAY)


def test_unreachable_thumbnail(spark):
    url = "https://i.ytimg.com/vi/x/maxresdefault.jpg"
    pick = lambda a, b: spark.range(1).select(fuse.chosen_thumbnail(F.lit(a).cast("string"), F.lit(b).cast("string"), F.lit(False)).alias("t")).first()["t"]
    assert pick("http://c/cover.jpg", url) == "http://c/cover.jpg"
    assert pick(None, url) == "https://i.ytimg.com/vi/x/hqdefault.jpg"
    assert pick(None, None) is None


def test_fold_keeps_duplicates_inside_a_source(spark):
    frame = lambda titles: spark.createDataFrame([("s", i, f"{i}-{t}", t, "", None) for i, t in enumerate(titles)], ROW)
    got = fuse.fold_dedup([frame(["the big moon landing", "the big moon landing"]), frame(["big moon landing", "another story told"]), frame(["another story told", "third tale entirely"])])
    assert [r["title"] for r in got.orderBy("idx").collect()] == ["the big moon landing", "the big moon landing", "another story told", "third tale entirely"]


@pytest.mark.parametrize(("f", "title", "want"), [
    (SourceFilter(exclude=("ad",)), "An Ad", False), (SourceFilter(exclude=("^ad",)), "an ad", True), (SourceFilter(include=("a", "b")), "xbx", True),
    (SourceFilter(include=("a",), exclude=("b",)), "ab", False), (SourceFilter(include=("a",)), "a\nb", False), (SourceFilter(), "any", True), (SourceFilter(include=("a",)), "a\r\x85b", True),
])
def test_title_filter(spark, f, title, want):
    assert (rules.title_filter(spark.createDataFrame([(title,)], "title string"), f).count() == 1) is want


def test_rules_equal_the_calendar_library(spark):
    """Every kind of part over a year, as expressions or day by day; without DTSTART a rule starts on the day itself."""
    texts = [
        "FREQ=MONTHLY;BYDAY=2TU", "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1", "FREQ=YEARLY;BYYEARDAY=1,100,-1", "FREQ=YEARLY;BYWEEKNO=20", "FREQ=HOURLY;INTERVAL=36", "FREQ=MINUTELY", "FREQ=WEEKLY;WKST=SU;INTERVAL=2;BYDAY=SU",
        "FREQ=DAILY;INTERVAL=3", "FREQ=WEEKLY;BYDAY=MO,FR", "FREQ=MONTHLY;BYMONTHDAY=-1,15", "FREQ=YEARLY;BYMONTH=2,3", "FREQ=WEEKLY;INTERVAL=2", "FREQ=MONTHLY;BYMONTHDAY=31;COUNT=5", "FREQ=DAILY;UNTIL=20240401T000000", "FREQ=SOMETIMES", "FREQ=DAILY;BYHOUR=9,17", "FREQ=MONTHLY;BYDAY=-1FR;INTERVAL=2",
    ]
    texts += [f"DTSTART:20240103T000000\nRRULE:{t}" for t in texts if "MINUTELY" not in t] + ["DTSTART:20240124T000000Z\nRRULE:FREQ=WEEKLY;BYDAY=MO"]
    days = [dt.date(2023, 12, 20) + dt.timedelta(days=i) for i in (*range(60), *range(100, 400, 9))]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    got = df.select("d", *[rules.on_schedule(F.col("d"), [t]).alias(f"r{i}") for i, t in enumerate(texts)]).orderBy("d").collect()
    for i, t in enumerate(texts):
        assert [r[f"r{i}"] for r in got] == [rules.occurs(t, d) for d in days], t
    second = [r["d"] for r in got if r["r0"] and r["d"].month == 1]
    assert second == [dt.date(2024, 1, 9)] or all(d.weekday() == 1 for d in second)
    shows = spark.createDataFrame([("a", ["FREQ=WEEKLY;BYDAY=WE"]), ("b", ["FREQ=WEEKLY;BYDAY=TH", "FREQ=MONTHLY;BYDAY=1WE"]), ("c", []), ("d", ["nonsense"]), ("e", None)], "name string, schedule array<string>")
    assert sorted(r["name"] for r in rules.due(shows, dt.date(2026, 4, 1)).collect()) == ["a", "b", "c", "e"]


@pytest.mark.parametrize(("rule", "day", "want"), [
    ("FREQ=WEEKLY;BYDAY=MO", dt.date(2026, 3, 30), True), ("FREQ=WEEKLY;BYDAY=MO", dt.date(2026, 3, 31), False), ("FREQ=WEEKLY", dt.date(2026, 3, 31), True),
    ("FREQ=DAILY;INTERVAL=2", dt.date(2026, 4, 1), True), ("DTSTART:20260330T000000\nRRULE:FREQ=DAILY;INTERVAL=2", dt.date(2026, 3, 31), False),
    ("DTSTART:20260330T000000\nRRULE:FREQ=DAILY;COUNT=2", dt.date(2026, 4, 1), False), ("FREQ=MONTHLY;BYMONTHDAY=-1", dt.date(2026, 3, 31), True), ("nonsense", dt.date(2026, 4, 1), False),
])
def test_schedule(spark, rule, day, want):
    assert spark.range(1).select(rules.on_schedule(F.lit(day), [rule]).alias("x")).first()["x"] is want


def test_traces(spark):
    s = spark.createDataFrame([("s", 0, 0, 0.9), ("s", 0, 1, 0.8), ("s", 1, 0, 0.85), ("s", 1, 1, 0.2)], "show string, ref_idx bigint, dl_idx bigint, score double")
    p = assign.greedy(s)
    refs = spark.createDataFrame([("s", 0), ("s", 1), ("s", 2)], "show string, idx bigint")
    got = {r["ref_idx"]: [(c["dl_idx"], c["reason"]) for c in r["candidates"]] for r in trace.traces(refs, s, p).collect()}
    assert got == {0: [(0, "matched"), (1, "reference_matched_elsewhere")], 1: [(0, "download_matched_elsewhere"), (1, "below_threshold")], 2: []}


def test_unreachable_images_give_way_in_fusion(spark):
    url = "https://i.ytimg.com/vi/x/maxresdefault.jpg"
    row = lambda image: spark.createDataFrame([("s", 0, "i", "t", "", "u", image, None)], "show string, idx bigint, id string, title string, description string, content string, image string, pub_date timestamp")
    pairs = spark.createDataFrame([("s", 0, 0, 0.9, 1)], "show string, ref_idx bigint, dl_idx bigint, score double, rank bigint")
    gone = spark.createDataFrame([(url,), (url,)], "url string")
    pick = lambda a, b, g: fuse.fuse(pairs, row(a), row(b), g).first()["thumbnail"]
    assert pick("http://c/cover.jpg", url, gone) == "http://c/cover.jpg" and pick(None, url, gone) == "https://i.ytimg.com/vi/x/hqdefault.jpg"
    assert pick(None, url, gone.limit(0)) == url == pick(None, url, None)


def test_events_and_timings():
    from feedweave.operators.events import Events, StageDone, Timings

    events, seen = Events(), []
    events.subscribe(StageDone, seen.append)
    events.subscribe(int, lambda e: seen.append(-e))
    timings = Timings(events)
    for name in ("zeta", "write_outputs", "align_episodes"):
        with timings.stage(name):
            pass
    events.publish(True)  # another type than int
    events.publish(3)
    assert [getattr(e, "stage", e) for e in seen] == ["zeta", "write_outputs", "align_episodes", -3]
    assert [x.split("=")[0] for x in timings.line("S").split()] == ["TIMING", "S:", "align_episodes", "write_outputs", "zeta"] and Timings().line("S") == ""


def test_plan_and_cleanup(spark):
    q = spark.createDataFrame([("a", 0, False, DAY, "x"), ("a", 1, True, DAY, "y"), ("a", 2, False, None, "z"), ("b", 0, False, DAY, "w")], "show string, idx bigint, exists_on_s3 boolean, pub_date timestamp, title string")
    assert [(r["show"], r["idx"]) for r in workplan.capped(q, 2).orderBy("place").collect()] == [("a", 0), ("a", 2)]
    names = spark.createDataFrame([("a",), ("a (1)",), ("b (1)",)], "name string")
    assert [r["name"] for r in workplan.duplicate_groups(names, "regexp_replace(name, ' .1.$', '')").collect()] == ["a (1)"]
    seg = spark.createDataFrame([("v", 0, 1.0, 2.0), ("v", 1, 2.05, 3.0)], "video_id string, pos bigint, start double, end double")
    total = spark.createDataFrame([("v", 5.0), ("w", 4.0)], "video_id string, total double")
    assert sorted((r["video_id"], r["start"], r["end"]) for r in workplan.kept_segments(seg, total).collect()) == [("v", 0.0, 1.0), ("v", 3.0, 5.0), ("w", 0.0, 4.0)]


def test_upsert_and_difference(spark):
    old = spark.createDataFrame([("1", "a")], "id string, v string")
    new = spark.createDataFrame([("1", "b", None), ("2", "c", "public"), ("3", "d", "private")], "id string, v string, availability string")
    assert sorted(map(tuple, upsert.insert_only(old, new).collect())) == [("1", "a"), ("2", "c")]
    assert sorted(r["side"] for r in upsert.difference(old, spark.createDataFrame([("1", "z")], "id string, v string")).collect()) == ["candidate", "primary"]


def test_weights_change_scores(spark):
    refs, dls = [("a", "lost city haunting", "d", DAY)], [("b", "lost city haunting again here", "d", DAY + dt.timedelta(days=30))]
    light = Alignment(weights=Weights(date=0.01))
    assert scores_of(spark, refs, dls, alignment=light)[0, 0] > scores_of(spark, refs, dls)[0, 0]


def test_scorer_registry(spark, monkeypatch):
    from feedweave.operators import ports

    frame = lambda t: spark.createDataFrame([("s", 0, t, t, "", None)], ROW)
    result, differs = ports.shadow(frame("big moon"), frame("big moon"), "legacy", "exact")
    assert result.count() == 1 and differs.count() in (0, 2)
    monkeypatch.setenv("FEEDWEAVE_SCORER", "none")
    with pytest.raises(ValueError, match="unknown scorer"):
        ports.scorer()
    assert isinstance(ports.scorer("kernel"), ports.Scorer)


def test_download_and_cleanup_plans(spark):
    from feedweave.plans import download
    from feedweave.plans.merge import merge

    row = ROW + ", content string, image string, duration double"
    frame = lambda titles, p: spark.createDataFrame([("s", i, f"{p}{i}", t, "", None, f"http://x/{p}{i}.mp3", None, 1.0) for i, t in enumerate(titles)], row)
    merged = merge([frame(["the big moon landing", "a river story"], "r")], [frame(["big moon landing", "a river story", "odd one out"], "d")])
    listing = spark.createDataFrame([("big-moon-landing.mp3", "the-big-moon-landing", None, None), ("odd-one-out.mp3", "odd-one-out", None, None)], "name string, stem string, source string, video_id string")
    none = spark.createDataFrame([], "video_id string, pos bigint, start double, end double")
    assert [r["title"] for r in download.queue(merged, none, listing, 5).collect()] == ["a river story"]
    assert [(r["object_name"], r["action"]) for r in download.cleanup(merged, listing).collect()] == [("odd-one-out.mp3", "delete")]
    channels = spark.createDataFrame([("s", "S", "u", "", "", "")], "show string, title string, url string, description string, author string, subtitle string")
    files = spark.createDataFrame([("s", 0, "a-river-story", "http://f/a.mp3")], "show string, idx bigint, stem string, url string")
    assert "http://f/a.mp3" in download.feed(channels, files, merged.references).first()["xml"]


def test_document_scores_are_a_search(spark):
    """Every document with an id divisible by 50 is a query, of either side, and finds itself among all rows."""
    from feedweave.plans import catalogue

    docs = "/root/testdata/sf0.001"
    wanted = {r["doc_id"] for r in spark.read.parquet(f"{docs}/documents.parquet").where("doc_id % 50 = 0").collect()}
    rows = catalogue.QUERIES["pair_score_documents"](spark, docs).collect()
    assert {r["ref_idx"] for r in rows} == wanted and {(i, i) for i in wanted} <= {(r["ref_idx"], r["dl_idx"]) for r in rows}


def test_pairs_of_rows_deal_scores_without_lists(spark, monkeypatch):
    """No list of rows travels with a score: lists join below the place where pairs are dealt only beyond the broadcast's size."""
    monkeypatch.setattr(alike, "PIECE", 2)
    rows = {"refs": [(7, i) for i in range(5)] + [(8, 9)], "dls": [(7, i) for i in range(4)] + [(6, 11)]}
    members = {k: spark.createDataFrame([("s", c, i) for c, i in v], "show string, class bigint, idx bigint") for k, v in rows.items()}
    scores = [(7, 7, 0.5), (8, 6, 1.0)]
    scored = alike.Scored(spark.createDataFrame([("s", *x) for x in scores], "show string, ref_idx bigint, dl_idx bigint, score double"), **members)
    wanted = sorted((i, j, s) for r, d, s in scores for c, i in rows["refs"] if c == r for e, j in rows["dls"] if e == d)

    def pairs():
        found = scored.pairs()
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        above = plan[: plan.index("RepartitionByExpression")]
        return sorted((r["ref_idx"], r["dl_idx"], r["score"]) for r in found.collect()), above.count("Join Inner")

    assert pairs() == (wanted, 2)
    monkeypatch.setattr(alike, "BROADCAST_ROWS", 3)
    assert pairs() == (wanted, 0)


def test_kernel_pairs_deal_scores_without_lists(spark):
    from feedweave.plans import catalogue

    found = catalogue.QUERIES["pair_score_kernel"](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan[: plan.index("RepartitionByExpression")].count("Join Inner") == 2
    a, b = (linkage.features(x) for x in catalogue.sides_of_parts(spark, "/root/testdata/sf0.001"))
    wanted = linkage.score(linkage.all_pairs(a, b), semantics="kernel").where("score > 0").withColumn("score", F.round("score", 6))
    key = lambda df: sorted((r["ref_idx"], r["dl_idx"], r["score"]) for r in df.collect())
    assert key(found) == key(wanted)


def test_document_scores_are_whole(spark):
    """All references against all downloads of their shows, with the scores of the column expressions."""
    from feedweave.plans import catalogue

    docs = "/root/testdata/sf0.001"
    a, b = (linkage.features(x) for x in catalogue.sides_of_documents(spark, docs))
    wanted = linkage.score(linkage.all_pairs(a, b)).where("score > 0").withColumn("score", F.round("score", 6))
    key = lambda df: sorted((r["show"], r["ref_idx"], r["dl_idx"], r["score"]) for r in df.collect())
    found = key(catalogue.QUERIES["pair_score_documents"](spark, docs))
    assert found == key(wanted) and any(r % 50 for _, r, _, _ in found)


def test_blocks_are_dealt_to_many_tasks(spark):
    """Blocks of few bytes are not put together into one task."""
    rows = spark.createDataFrame([("s", i, f"x{i}", f"moon story {i}", "", None) for i in range(12)], ROW)
    found = blocks.scores(linkage.features(rows), linkage.features(rows), chunk=2)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
