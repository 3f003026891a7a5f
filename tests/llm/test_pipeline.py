"""The pipeline against its stages' brute force, and its contract."""

import random

import corpus_pipeline
from feedweave.llm import bpe


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(600)]
    passage = " ".join(rng.choices(words, k=25))
    say = lambda n: " ".join(rng.choices(words, k=n))
    base = [say(80) for _ in range(20)]
    texts = [*base, base[0], base[1] + " tail", f"{say(30)} {passage} {say(30)}", f"{say(40)} token=abcdef123456 {say(10)}", "", None]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, current = [], spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, current, str(tmp_path))
        if n < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{n}"))
        current = spark.read.parquet(str(tmp_path / f"s{n}"))
        kept.append({r["doc_id"]: r for r in current.collect()})
    assert set(kept[0]) == set(range(24))
    assert set(kept[1]) == set(range(20)) | {22, 23}
    assert set(kept[2]) == set(kept[3]) == set(kept[4]) == set(range(20)) | {23}
    assert "[SECRET]" in kept[3][23]["text"] and "abcdef123456" not in kept[3][23]["text"] and kept[3][23]["n_chars"] == len(kept[3][23]["text"])
    t = bpe.WordTokenizer(bpe.word_bpe_path())
    assert all(bytes(r["ids"]) == t.encode(kept[3][i]["text"]) for i, r in kept[4].items())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept[4])


def test_edges(spark, tmp_path):
    """Null ids and columns, repeated rows, very long texts, columns with clashing names; nothing that is clean goes."""
    rng = random.Random(22)
    words = [f"w{i}" for i in range(800)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(1, say(50), "en", "s", 1), (None, say(60), None, None, None), (None, None, None, None, None), (2, say(40), "en", None, 1), (2, "same id, other text " + say(40), "en", "s", 1), (3, say(40_000), "en", "s", 1), (4, None, "en", "s", None)]
    rows += [(5, say(45), "en", "s", 1)] * 2
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS component_id", "'x' AS spans", "2 AS kept", "'y' AS __base", "3 AS doc", "4 AS row", "5 AS ids", "6 AS bucket")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(None, None), (1, say(20))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    current = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        current = stage(spark, current, str(tmp_path))
        if n < 4:
            assert current.columns == docs.columns
        kept = sorted((r["doc_id"] for r in current.collect()), key=lambda x: (x is None, x))
        assert kept == [1, 2, 2, 3, 5, 5, None, None], n


def test_empty_documents(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_little_room_changes_no_ids(spark):
    """A worker of the pipeline remembers ROOM words at most, and decodes nothing that the stage does not return."""
    rng = random.Random(23)
    rows = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(40))) for i in range(20)]
    t, few = (bpe.WordTokenizer(bpe.word_bpe_path(), room) for room in (None, 30))
    assert [few.encode(x) for _, x in rows] == [t.encode(x) for _, x in rows]
    for held in (few.words, few.parts):
        assert len(held) + len(held.old) <= 30
    assert len(few.merges.pairs) <= 11 and len(few.merges.starts) <= 11
    out = bpe.encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), bpe.word_bpe_path(), room=corpus_pipeline.ROOM, decode=False)
    assert out.columns == ["doc_id", "ids", "n_tokens"]
    assert {r["doc_id"]: bytes(r["ids"]) for r in out.collect()} == {i: t.encode(x) for i, x in rows}
