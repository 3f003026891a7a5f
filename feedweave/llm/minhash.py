"""Near-duplicate groups: universal-hash minima, banding, signature verification, exact confirmation, components.

1. One Arrow pass makes, per document, the set of its 5-word shingles (64-bit hashes) and from it a fingerprint,
   ``BANDS`` band keys over ``BANDS * ROWS`` universal-hash minima, and a signature: the lowest byte of each minimum and a
   bit set of the shingles.
2. Documents with equal sets collapse into one representative, so exact copies never meet each other.
3. Band buckets with more than one representative give candidates.  In a bucket every member is compared with its
   centre, the member with the smallest id, and not with every other member: a group of k copies costs k pairs.
4. Candidates pass the signatures (below), then the full sets, which travel once per document and once per centre and task.
5. Components of the confirmed links by alternating large-star and small-star.
6. Buckets that still hold several components are finished, so that no link is missed because neither end was the centre:
   members outside the centre's component are the queries, and meet all members of other components.  Buckets of up to MANY
   members do so by a join and the same confirmation.  Documents of larger ones are crowds, each document once however many
   buckets it shares; in a crowd blocks of queries meet blocks of members with their full sets, and what leaves a block are
   confirmed links that join different components, fewer than its rows.

What can be missed, for two sets at the threshold 0.75: no common band, (1 - 0.75**3)**32 < 3e-8; fewer than ``AGREE`` equal
bytes of 96, < 1e-8.  The bit sets never reject a link: each differing bit is a shingle that only one side has.

The work of step 6 is the number of queries times the members that share a bucket, or a crowd, with them: linear in the number
of documents for groups of bounded size.  In a group of which a fixed share is near, but not at, the threshold, the comparisons
inside the blocks are quadratic in its size; the rows that come out of a block are not.

Defined results: a null or empty text, or one without words, has an empty set and is linked with nothing; rows with one
doc_id are one document with the links of them all; ties go to the smaller doc_id; an empty table gives
an empty table; other columns are not read.  Rows with a null doc_id are one document, linked with nothing and kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.llm.common import BROADCAST_IDS, cut, drop, gram_hashes, heavy_map, hold, lower_bytes, mix, span_hashes, table, texts, word_spans

SHINGLE = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 32, 3
#: Equal bytes of the BANDS * ROWS minima that a candidate needs, and bits of the shingles' bit set.
AGREE, BITS = 44, 1024
_PLANE, _BIT_LONGS = -(-BANDS * ROWS // 64), BITS // 64
#: Members of a bucket that are paired by a join, and rows and bytes of sets of a side of a block in larger ones.
MANY, BLOCK, BLOCK_BYTES = 64, 2048, 8 << 20
#: Documents named in a broadcast at most, and bytes of sets that one task compares, about.
BROADCAST_ROWS, TASK_BYTES = 200_000, 16 << 20
#: The columns that tell sets apart.
SET = ["f1", "f2", "n_shingles"]

_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; one for the whole sequence if it is shorter."""
    data = lower_bytes(text)
    starts, ends = word_spans(data)
    return np.unique(gram_hashes(span_hashes(data, starts, ends), size))


def minima(values: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(values), 1024):
        np.minimum(low, (values[at : at + 1024, None] * _MUL + _ADD).min(axis=0), out=low)
    return low


def band_keys(low: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of ROWS minima; the band's number is part of the key."""
    key = _SALT.copy()
    for row in low.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(31) + row)
    return key


def signature(values: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The last byte of each (mixed) minimum as eight planes of one bit each, then the bit set of the shingles, as longs."""
    planes = np.zeros((8, 64 * _PLANE), np.uint8)
    planes[:, : len(low)] = np.unpackbits((mix(low) & np.uint64(255)).astype(np.uint8)[:, None], axis=1).T
    bits = np.zeros(BITS, np.uint8)
    bits[(values >> np.uint64(20)) % np.uint64(BITS)] = 1
    return np.packbits(np.concatenate([planes.ravel(), bits])).view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fingerprint (two longs), bands, marks for each row of (doc_id, text)."""

    def run(batches):
        kind = pa.list_(pa.int64())
        for batch in batches:
            n, f1, f2, bands, marks = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                n.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                f2.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                low = minima(s) if len(s) else None
                bands.append(band_keys(low).view(np.int64) if len(s) else [])
                marks.append(signature(s, low) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, kind), pa.array(marks, kind)],
                ["doc_id", "n_shingles", "f1", "f2", "bands", "marks"],
            )

    return heavy_map(docs, run, "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, marks array<bigint>")


def alike_in_size(a: str, b: str):
    """Column: the sizes of two sets allow a similarity of THRESHOLD or more."""
    return 100 * F.least(a, b) >= THRESHOLD * F.greatest(a, b)


def close_enough():
    """Column: the signatures of rows a and b allow a similarity of THRESHOLD or more."""
    apart = lambda i: f"(a_marks[{i}] ^ b_marks[{i}])"
    other = " + ".join(f"bit_count({' | '.join(apart(_PLANE * plane + i) for plane in range(8))})" for i in range(_PLANE))
    missing = " + ".join(f"bit_count({apart(i)})" for i in range(8 * _PLANE, 8 * _PLANE + _BIT_LONGS))
    return F.expr(f"{BANDS * ROWS} - ({other}) >= {AGREE} AND {100 + THRESHOLD} * ({missing}) <= {100 - THRESHOLD} * (a_n + b_n)")


def asked_for(docs: DataFrame, need: DataFrame, few: bool) -> DataFrame:
    """Rows of docs with the columns of need, one row for each document that is asked for: only their texts travel."""
    if few:
        return docs.join(F.broadcast(need), "doc_id")
    return (docs.join(F.broadcast(need.select("doc_id")), "doc_id", "left_semi") if need.count() <= BROADCAST_IDS else docs).join(need, "doc_id")


def crowds(rows: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component, is_query, crowd: each document once, in the crowd of all whose buckets meet, by a query or not."""
    first = rows.groupBy("bucket").agg(F.min("doc_id").alias("a"))
    of = components(rows.join(first, "bucket").select("a", F.col("doc_id").alias("b"))).withColumnsRenamed({"node": "doc_id", "component": "crowd"})
    once = rows.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component").alias("component"), F.max("is_query").alias("is_query"))
    return once.join(of, "doc_id", "left").withColumn("crowd", F.coalesce("crowd", "doc_id"))


def met(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join all components of a crowd that are linked through a query, found on the full sets.

    rows: as crowds() makes them.  Blocks of queries meet blocks of members.  A link that joins what the block has joined
    already is not looked for, so a block makes fewer links than it has rows.
    """
    rows = hold(rows)
    blocks = lambda some, name: F.greatest(F.ceil(F.count(some) / BLOCK), F.ceil(8 * F.sum(F.when(some.isNotNull(), F.col("n_shingles"))) / BLOCK_BYTES)).cast("int").alias(name)
    count = rows.groupBy("crowd").agg(blocks(F.when(F.col("is_query"), 1), "of_q"), blocks(F.lit(1), "of_m")).where("of_q > 0")
    asks = "if(is_query, transform(sequence(0, of_m - 1), m -> struct(cast(pmod(xxhash64(doc_id), of_q) as int) as q, m as m, true as asks)), array())"
    told = "transform(sequence(0, of_q - 1), q -> struct(q as q, cast(pmod(xxhash64(doc_id), of_m) as int) as m, false as asks))"
    need = rows.join(count, "crowd").select("doc_id", "component", "is_query", "crowd", F.expr(f"concat({asks}, {told})").alias("places"))
    of_sets = asked_for(docs, need, rows.count() <= BROADCAST_ROWS).select("doc_id", "text", "component", "is_query", "crowd", "places")

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, pa.binary())], ["doc_id", "component", "is_query", "crowd", "places", "set"])

    made = heavy_map(of_sets, sets, "doc_id bigint, component bigint, is_query boolean, crowd bigint, places array<struct<q:int,m:int,asks:boolean>>, set binary")
    made = made.where("length(set) > 0").select("doc_id", "component", "is_query", "crowd", "set", F.explode("places").alias("p")).select("crowd", "p.q", "p.m", "p.asks", "doc_id", "component", "is_query", "set")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(block: pa.Table) -> pa.Table:
        asks = block["asks"].to_numpy()
        found = spanning(*(_side(block.filter(pa.array(side))) for side in (asks, ~asks)))
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in found], schema=schema)

    return made.groupBy("crowd", "q", "m").applyInArrow(run, "a bigint, b bigint")


def _side(block: pa.Table) -> tuple:
    """doc_id, component, is_query and set of each row."""
    return *(block[c].to_numpy() for c in ("doc_id", "component", "is_query")), [np.frombuffer(x.as_py(), np.uint64) for x in block["set"]]


def spanning(queries: tuple, members: tuple) -> tuple[list[int], list[int]]:
    """Links between queries and members that join all components that any such link joins, one for each joining.

    Two queries meet once, where the member's component is the greater.
    """
    (ids, of, _, asked), (docs, component, is_query, sets) = queries, members
    if not len(ids) or not len(docs):
        return [], []
    # Shingles as places of the queries' different ones; a member's others, which no query has, are only counted.
    words = np.unique(np.concatenate(asked))
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    place = np.minimum(np.searchsorted(words, flat), len(words) - 1)
    place[words[place] != flat] = len(words)
    start = np.concatenate([[0], np.cumsum(size)])
    label_q, label = of.copy(), component.copy()
    a, b = [], []
    for i, x in enumerate(asked):
        at = np.flatnonzero((label != label_q[i]) & (~is_query | (component > of[i])) & (100 * np.minimum(size, len(x)) >= THRESHOLD * np.maximum(size, len(x))))
        if not len(at):
            continue
        has = np.zeros(len(words) + 1, np.int32)
        has[np.searchsorted(words, x)] = 1
        ends = np.cumsum(size[at])
        taken = np.arange(ends[-1]) + np.repeat(start[at] - ends + size[at], size[at])
        common = np.add.reduceat(has[place[taken]], ends - size[at])
        at = at[100 * common >= THRESHOLD * (size[at] + len(x) - common)]
        joined, one = np.unique(label[at], return_index=True)
        a += [int(ids[i])] * len(joined)
        b += docs[at[one]].tolist()
        mine = label_q[i]
        label[np.isin(label, joined)] = mine
        label_q[np.isin(label_q, joined)] = mine
    return a, b


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold, of pairs (a, a_n, b, b_n) with the sets' sizes.

    Tasks are dealt by b.  A task gets the set of each of its b, and of each a that it meets once, so the set of an a with
    many partners travels once for each task and not once for each pair.
    """
    size = pairs.agg(F.sum(F.col("a_n") + F.col("b_n")).alias("shingles"), F.count("*").alias("n")).first()
    tasks = max(1, -(-8 * (size["shingles"] or 0) // TASK_BYTES))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(tasks)).alias("task"))
    place = F.explode(F.array(F.struct(F.col("a").alias("doc_id"), "task", F.lit(0).alias("kind")), F.struct(F.col("b").alias("doc_id"), "task", F.lit(1).alias("kind"))))
    need = dealt.select(place.alias("x")).select("x.*").groupBy("doc_id").agg(F.collect_set(F.struct("task", "kind")).alias("places"))  # two for each task at most
    of_sets = asked_for(docs, need, 2 * size["n"] <= BROADCAST_ROWS).select("doc_id", "text", "places")

    def sets(batches):
        for batch in batches:
            found = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "places", "set"])

    made = heavy_map(of_sets, sets, "doc_id bigint, places array<struct<task:bigint,kind:int>>, set binary")
    made = made.select(F.explode("places").alias("p"), "doc_id", "set").select("p.task", "p.kind", "doc_id", F.lit(None).cast("bigint").alias("a"), "set")
    asked = dealt.select("task", F.lit(2).alias("kind"), F.col("b").alias("doc_id"), "a", F.lit(None).cast("binary").alias("set"))
    both = made.unionByName(asked).repartition(tasks, "task").sortWithinPartitions("task", F.least("kind", F.lit(1)), "doc_id", "kind")

    def run(batches):
        task, held, at, own = None, {}, None, []  # sets of each a; the b at hand and its sets
        for batch in batches:
            a, b = [], []
            for n, (t, kind, doc, other) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)):
                if t != task:
                    task, held, at, own = t, {}, None, []
                if kind == 2:
                    if any(similar(x, y) for x in held[other] for y in own):
                        a.append(other)
                        b.append(doc)
                    continue
                found = np.frombuffer(batch.column(4)[n].as_py(), np.uint64)
                if kind == 0:
                    held.setdefault(doc, []).append(found)
                elif doc == at:
                    own.append(found)
                else:
                    at, own = doc, [found]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return heavy_map(both, run, "a bigint, b bigint")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= THRESHOLD * (len(x) + len(y) - common)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large-star and small-star steps.

    The least neighbours of all nodes are kept before they are joined, so a node with very many neighbours is a skewed
    join that Spark divides, or a broadcast where they are few.  Each round begins from a written table.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        # Large star: of each node's neighbours and itself the least; larger neighbours move to it.
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        least = hold(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = hold(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # Small star: neighbours not larger than the node, and the node itself, move to the least of them.
        low = hold(large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")))
        small = large.join(low.where("m < most"), "u").select("v", "m").where("v <> m").union(low.select("u", "m"))
        after = cut(small.toDF("u", "v").distinct())
        # Done when every edge leads to a root: no node has two parents, or a parent that has one.
        done = after.groupBy("u").count().where("count > 1").isEmpty() and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
        drop(edges, least, large, low)
        if done:
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = after


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = texts(docs, id_col, text_col)
    sigs = cut(signatures(docs))
    some = sigs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = cut(some.groupBy(*SET).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("marks").alias("marks")))

    rows = reps.select("doc_id", "n_shingles", F.explode("bands").alias("bucket"))
    tops = hold(rows.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.min_by("n_shingles", "doc_id").alias("centre_n"), F.count("*").alias("size")).where("size > 1"))
    held = cut(rows.join(tops, "bucket"))

    def screened(pairs: DataFrame) -> DataFrame:
        """Different pairs (a, a_n, b, b_n) that the signatures allow."""
        side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("marks").alias(f"{x}_marks"), F.col("n_shingles").alias(f"{x}_n"))
        return pairs.join(side("a"), ["a", "a_n"]).join(side("b"), ["b", "b_n"]).where(close_enough()).select("a", "a_n", "b", "b_n").distinct()

    star = held.where("doc_id <> centre").where(alike_in_size("n_shingles", "centre_n")).select(F.col("centre").alias("a"), F.col("centre_n").alias("a_n"), F.col("doc_id").alias("b"), F.col("n_shingles").alias("b_n")).distinct()
    near = cut(screened(star))
    # Rows of one doc_id with different texts belong together.
    several = some.groupBy("doc_id").agg(F.min(F.struct(*SET)).alias("x"), F.max(F.struct(*SET)).alias("y")).where("x <> y").select("doc_id")
    bound = some.join(several, "doc_id", "left_semi").select("doc_id", *SET).join(reps.select(*SET, F.col("doc_id").alias("b")), SET).select(F.col("doc_id").alias("a"), "b")
    found = components(confirmed(near, docs).union(bound))
    drop(tops, near)

    # Buckets that hold more than one component: queries against members of other components, but for the centre.
    label = held.where("size > 2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "size", "centre", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    label = hold(label)
    broken = hold(label.groupBy("bucket").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max(F.when(F.col("doc_id") == F.col("centre"), F.col("component"))).alias("home")).where("c0 <> c1").select("bucket", "home"))
    open_ = cut(label.join(broken, "bucket").where("doc_id <> centre").withColumn("is_query", F.col("component") != F.col("home")))
    side = lambda x, rows: rows.select("bucket", F.col("doc_id").alias(x), F.col("n_shingles").alias(f"{x}_n"), F.col("component").alias(f"{x}_c"), F.col("is_query").alias(f"{x}_q"))
    small = open_.where(F.col("size") <= MANY)
    rest = side("a", small.where("is_query")).join(side("b", small), "bucket").where("a_c <> b_c AND (NOT b_q OR a_c < b_c)").where(alike_in_size("a_n", "b_n"))
    rest = screened(rest.select("a", "a_n", "b", "b_n").distinct())
    left = cut(rest)
    more = confirmed(left, docs)
    large = open_.where(F.col("size") > MANY)
    if not large.isEmpty():
        more = more.union(met(crowds(large), docs))
    more = cut(more)
    if not more.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    drop(held, label, broken, open_, left, more)

    of = reps.select(*SET, "copies", "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(*SET, "copies", F.col("doc_id").alias("rep"), F.coalesce("component", "doc_id").alias("component"))
    of = cut(of.where("copies > 1 OR component <> rep").select(*SET, "component"))
    out = sigs.select("doc_id", *SET).join(of, SET, "left").groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"), F.min(F.when(F.col("doc_id").isNotNull(), F.col("component"))).alias("component"))
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The linked documents by their full sets: words, shingles, exact similarity, and reachability.
OP7_SQL = r"""
WITH RECURSIVE
w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE
           WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[])
           WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
           ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
  FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s AS a JOIN s AS b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents AS d LEFT JOIN n USING (doc_id)
JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) AS c ON c.a = d.doc_id
"""

QUERIES = {"op7_minhash": op7_minhash}
ORACLE_SQL = {"op7_minhash": OP7_SQL}
