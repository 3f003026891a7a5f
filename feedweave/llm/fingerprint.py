"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph (a line) hashes to a wide vector: EXACT lanes of its BLAKE2b digest, taken modulo 2**64, and LANES lanes,
taken modulo 2**32, in which each of its 3-word windows adds +1 or -1 to one lane.  A document's fingerprint is the sum
of its paragraphs' vectors, so the order of paragraphs does not matter, equal multisets are equal, and a paragraph is
inserted or deleted by adding or subtracting one vector, without the rest of the document.  The first part decides
equality; the second is a sketch in which the squared distance of two sums estimates the squared distance of their
window counts, so ``likeness`` is an estimate of 2<x,y> / (<x,x> + <y,y>), exact at 1 for equal documents.

Defined results: a null or empty text is one empty paragraph; repeated rows follow each other in order of text; a null
doc_id comes after all others; the last document is followed by the first, a single one by itself; an empty table
gives an empty table; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.llm.common import heavy_map, mix, span_hashes, table, texts, word_spans

EXACT, LANES, WINDOW = 8, 256, 3
OUT_ROWS = 512
#: Characters of a bucket, about, and buckets at most (their first ids are part of the plan).
BUCKET_CHARS, BUCKETS = 1 << 24, 20_000


class Fingerprint:
    """A multiset of paragraphs: + and - are insertion and deletion."""

    __slots__ = ("exact", "sketch")

    def __init__(self, exact: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.exact = np.zeros(EXACT, np.uint64) if exact is None else exact
        self.sketch = np.zeros(LANES, np.uint32) if sketch is None else sketch

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        data = text.encode("utf-8", "surrogatepass")
        digests = b"".join([hashlib.blake2b(line, digest_size=8 * EXACT).digest() for line in data.split(b"\n")])
        exact = np.frombuffer(digests, np.uint64).reshape(-1, EXACT).sum(axis=0, dtype=np.uint64)
        features = windows(np.frombuffer(data, np.uint8))
        sign = np.where((features >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
        lanes = np.bincount((features % np.uint64(LANES)).astype(np.int64), sign, LANES)
        return cls(exact, lanes.astype(np.int64).astype(np.uint32))

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.sketch - other.sketch)

    def __eq__(self, other) -> bool:
        return bool((self.exact == other.exact).all() and (self.sketch == other.sketch).all())

    __hash__ = None

    def hex(self) -> str:
        return (self.exact.astype("<u8").tobytes() + self.sketch.astype("<u4").tobytes()).hex()

    def likeness(self, other: Fingerprint) -> float:
        if self == other:
            return 1.0
        x, y = self.sketch.view(np.int32).astype(np.float64), other.sketch.view(np.int32).astype(np.float64)
        size = float(x @ x + y @ y)
        return min(1.0, max(0.0, 2.0 * float(x @ y) / size)) if size else 0.0


def windows(data: np.ndarray) -> np.ndarray:
    """Hashes of the WINDOW-word windows inside each line; a line with fewer words has one window of them all."""
    starts, ends = word_spans(data)
    if not len(starts):
        return np.empty(0, np.uint64)
    words = span_hashes(data, starts, ends)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    n = len(words)
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]])
    size = np.diff(np.r_[first, n])
    left = np.repeat(first + size, size) - np.arange(n)  # words from here to the end of the line
    start = (left >= WINDOW) | ((np.repeat(size, size) < WINDOW) & (left == np.repeat(size, size)))
    padded = np.concatenate([words, np.zeros(WINDOW - 1, np.uint64)])
    acc = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        acc = acc * np.uint64(0x9E6C63D0876A9A47) + np.where(left > i, padded[i : i + n], np.uint64(0))
    return mix(acc[start])


def edited(text: str, following: str) -> str:
    """The last quarter of the text's code points replaced by the first as many of the next document."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def refreshed(whole: Fingerprint, text: str, new: str) -> Fingerprint:
    """The fingerprint of new, from that of text: paragraphs after their common beginning go and come."""
    k = len(text) // 4
    at = text.rfind("\n", 0, len(text) - k) + 1
    if at == 0:
        return Fingerprint.of(new)
    return whole - Fingerprint.of(text[at:]) + Fingerprint.of(new[at:])


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, bucket, tail): rows in buckets of consecutive ids, each bucket closed by a copy (tail) of the row
    that follows it.  One shuffle of the texts; the cuts are ids, as many as there are buckets, and these grow with the texts."""
    size = docs.select(F.sum(F.length("text"))).first()[0] or 0
    n = min(BUCKETS, max(2, -(-size // BUCKET_CHARS)))
    ids = docs.agg(F.min("doc_id").alias("low"), F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("cuts")).first()
    if ids["low"] is None:
        return docs.select("doc_id", "text", F.lit(0).alias("bucket"), F.lit(False).alias("tail"))
    cuts = sorted({ids["low"], *(ids["cuts"] or [])})
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    array = lambda xs: "array(" + ", ".join(f"{x}L" if x >= 0 else f"cast('{x}' as bigint)" for x in xs) + ")"
    coarse, fine = array([g[0] for g in groups]), "array(" + ", ".join(array(g) for g in groups) + ")"
    rows = docs.withColumn("g", F.expr(f"if(doc_id is null, {len(groups) - 1}, size(filter({coarse}, x -> x <= doc_id)) - 1)"))
    rows = rows.withColumn("f", F.expr(f"{fine}[g]"))
    rows = rows.withColumn("bucket", F.expr(f"if(doc_id is null, {len(cuts) - 1}, g * {step} + size(filter(f, x -> x <= doc_id)) - 1)"))
    opens = F.expr("coalesce(array_contains(f, doc_id), false)")
    before = F.expr(f"if(bucket = 0, {len(cuts) - 1}, bucket - 1)")
    own = F.struct("bucket", F.lit(False).alias("tail"))
    places = F.when(opens, F.array(own, F.struct(before.alias("bucket"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    return rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.bucket", "p.tail")


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and the likeness of its own to that and to the next one's."""
    ordered = in_order(texts(docs, id_col, text_col))
    ordered = ordered.repartition("bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_last(), "text")

    def run(batches):
        out: list[tuple] = []
        held = None  # (bucket, id, text, fingerprint) of the row before
        for batch in batches:
            for doc, text, bucket, tail in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if tail and (held is None or held[0] != bucket):
                    continue
                text = text.as_py()
                print_ = Fingerprint.of(text)
                if held is not None:
                    same = held[0] == bucket
                    out.append(row(held, text if same else "", print_ if same else Fingerprint.of("")))
                held = None if tail else (bucket, doc, text, print_)
                if len(out) >= OUT_ROWS:
                    yield batch_of(out)
                    out = []
        if held is not None:
            out.append(row(held, "", Fingerprint.of("")))
        if out:
            yield batch_of(out)

    def row(held, following: str, next_print: Fingerprint) -> tuple:
        _, doc, text, own = held
        new = edited(text, following)
        other = refreshed(own, text, new)
        sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
        return doc, len(text), sha, own.hex(), other.hex(), own.likeness(other), own.likeness(next_print)

    def batch_of(out):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return heavy_map(ordered, run, SCHEMA)


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op2_fingerprint": op2_fingerprint}
ORACLE_SQL: dict[str, str] = {}
