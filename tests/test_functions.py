import random

import pytest
from pyspark.sql import functions as F

from feedweave.functions import scalars, similarity, text
from feedweave.functions.text import Replacement, TitleRules


def values(spark, function, inputs, *args):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in rows.select("i", F.expr(function("x", *args)).alias("y")).orderBy("i").collect()]


def test_slug(spark):
    cases = {
        "America_s History": "americas-history", "Price: $99.99": "price-9999", "a" * 200: "a" * 100, "They'll Come": "theyll-come", "  A -- b ": "a-b",
        "Café Ünïcode": "cafe-unicode", "Привет": "privet", "Straße": "strasse", "": "", "Vol.3": "vol", "Vol.2": "vol2", "song.mp3": "song",
    }
    assert values(spark, text.create_slug, cases) == list(cases.values())


def test_slug_of_a_name_is_the_column_form(spark):
    names = ["My Show.mp3", "America_s History", "They'll Come", "Café Ünïcode & Söhne", "Привет мир", "Ωμέγα", "日本", "a" * 150, "--x__y--", "Æon №5"]
    assert [text.slug_of(n) for n in names] == values(spark, text.create_slug, names)
    assert values(spark, text.normalize_title, ["The End (They'll Come)"], TitleRules(slug_suffixes=("They'll Come",))) == ["the-end"]


def test_extension_and_slug_form(spark):
    assert values(spark, text.remove_file_extension, ["my.file.txt", "VIDEO.MP4", "a.mp3\n", "a.mp3\r", "none"]) == ["my.file", "VIDEO", "a\n", "a.mp3\r", "none"]
    assert values(spark, text.is_slug, ["a-b1", "A", "a--b", "-a", "", "a_b", "a\n"]) == [True, False, False, False, False, False, True]


def test_control_characters(spark):
    assert values(spark, text.remove_control_chars, ["a\x00b\x1fc\td\n", None, "\x7f"]) == ["abc\td\n", "", ""]


def test_normalize_text(spark):
    cases = {
        "Episode IV: A New Hope": "episode 4 a new hope", "Rise (Pt. II)": "rise part 2", "I & You": "1 and you", "twenty one pilots": "20 1 pilots",
        "The 1st and 22nd": "the 1 and 22", "100% Wolf #3": "100 percent wolf number 3", "ﬁne": "fine", "": "", "Ω日本": "o", "a\nb": "a b",
    }
    assert values(spark, text.normalize_text, cases) == list(cases.values())


def test_title_rules(spark):
    rules = TitleRules((r"(?i)^episode\s+\d+:\s*",), (r"(?i)\|\s*show$",), ("The Show",), (Replacement(r"\(([^/)]+)/[^)]*\)", r"(\1)"), Replacement("^x-", "", "slug")))
    assert values(spark, text.normalize_title, ["Episode 12: The Moon | Show", "X Ray (a/b) The Show", "$1 (b/c)"], rules) == ["the-moon", "ray-a", "1-b"]


def test_durations_and_dates(spark):
    assert values(spark, scalars.parse_duration, ["90", "1:30", "1:01:30", "", "1:2:3:4", "x"]) == [90.0, 90.0, 3690.0, None, None, None]
    assert [str(x) for x in values(spark, scalars.compact_date, ["20240131", "20241301", "2024", "x"])] == ["2024-01-31", "None", "None", "None"]
    assert [x is None for x in values(spark, scalars.feed_date, ["Tue, 02 Jan 2024 10:00:00 +0000", "2024-01-02T10:00:00Z", "2024-01-02", "soon"])] == [False, False, False, True]


@pytest.mark.parametrize(("hours", "legacy", "kernel"), [(0, 1.0, 1.0), (60, 1.0, 1.0), (-60, 0.7, 1.0), (24 * 10, 0.7, 0.7), (24 * 19, 0.15, 0.15), (24 * 35, 0.15, 0.15), (24 * 60, 0.0, 0.0)])
def test_date_tiers(spark, hours, legacy, kernel):
    row = spark.sql(f"select {scalars.date_similarity('a', 'b')} l, {scalars.date_similarity('a', 'b', truncate=True)} k from (select timestamp'2024-03-01' + interval {hours} hours a, timestamp'2024-03-01' b)").first()
    assert (float(row["l"]), float(row["k"])) == (legacy, kernel)


def test_names_and_messages(spark):
    assert values(spark, scalars.stem, ["a.b.mp3", ".hidden", "x/.y", "plain", "dir.d/n"]) == ["a.b", ".hidden", "x/.y", "plain", "dir.d/n"]
    assert values(spark, scalars.video_id, ["https://www.youtube.com/watch?v=ab-_1&t=2", "https://youtu.be/abc"]) == ["ab-_1", None]
    assert values(spark, scalars.byte_format, ["0", "1023", "1024", "1280", str(5 * 1024**5)]) == ["0.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "5.0 PB"]
    assert values(spark, scalars.error_reason, ["This is Private Video", "geo block", "first\nsecond"]) == ["private video", "geo-restricted video", "first"]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            held = row[j + 1]
            row[j + 1] = before + 1 if x == y else max(held, row[j])
            before = held
    return row[-1]


def test_lcs_matches_dynamic_programme():
    rng = random.Random(5)
    word = lambda sizes: "".join(rng.choice("abc dé") for _ in range(rng.choice(sizes)))
    a = [word([0, 1, 3, 63, 64, 65, 130]) for _ in range(150)]
    b = [word([0, 2, 64, 70, 129]) for _ in range(150)]
    assert similarity.lcs_lengths(a, b).tolist() == [slow_lcs(x, y) for x, y in zip(a, b, strict=True)]


def test_token_ratios():
    one = lambda f, a, b, *rest: round(float(f([a], [b], *rest)[0]), 6)
    assert one(similarity.token_sort_ratios, "new moon", "moon new") == 1.0
    assert one(similarity.token_set_ratios, "new moon", "bonus new moon") == 1.0
    assert one(similarity.token_set_ratios, "ax", "bx") == 0.5
    assert one(similarity.token_set_ratios, "ax", "bx", True) == round(2 * 2 / 6, 6)
    assert one(similarity.token_set_ratios, "", "b") == 0.0
    assert one(similarity.ratios, "", "") == 1.0
