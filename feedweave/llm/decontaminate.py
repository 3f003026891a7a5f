"""Benchmark decontamination by spaced-seed hashing.

A token is a run of letters and digits (ASCII punctuation and white space separate tokens), lower-cased.  Each of the
fixed masks is slid over a token sequence and hashes only the positions marked 1, so that a substituted token at
an ignored position does not change the hash.  MASKS serve all items, LIGHT_MASKS those under LIGHT_TOKENS tokens too, and
items shorter than a mask have masks of their own length, with one ignored position (two from eight tokens on) in every
place, and shorter by as many positions with fewer ignored, for texts that begin or end inside the item.

The hashes of the benchmark's windows are a table of seeds.  One pass over the documents keeps the windows whose hash is in a
bit filter of the seeds (FILTER_BITS bits at most, whatever the benchmark's size; false positives only cost rows), and these are joined to the
seeds by hash, so a hot seed is a skewed join that Spark divides.  A hit names a document, an item and a diagonal.  The words
of the document along that diagonal are cut out and compared with the item's, word by word: the best-scoring segment, a match counting 1 and
a substitution ``SUBSTITUTION``, and the item as a whole.  A segment is an overlap if it has ``LONG`` matching tokens or
``COVER`` of the item's, and at least ``IDENTITY`` of its tokens match; the whole is one if ``IDENTITY`` of the item's
tokens match.

Nothing of the documents reaches the driver, and of the benchmark only the bit filter.

Defined results: null or empty texts and items have no overlaps; items with fewer than ``SHORT`` tokens are not searched;
a null doc_id or item_id stays null in the result; items with one id and different texts are items of their own; repeated
documents give repeated results, repeated items one; ties between overlaps of one document and item go to the leftmost; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.llm.common import MASK64, cut, drop, heavy_map, mix, span_hashes, table, text_blocks, texts

#: Positions that count (1) and that are ignored (0).
MASKS = ("1110110111", "1101011011", "11110011011", "1011101111")
LIGHT_MASKS, LIGHT_TOKENS = ("1101011", "1110011", "1011101"), 30
SUBSTITUTION = -2
LONG, COVER, IDENTITY, SHORT = 13, 0.8, 0.75, 5
#: Bits of the seed filter: this many for each seed, and at most.
BITS_A_SEED, FILTER_BITS = 32, 29
#: Documents named in a broadcast at most.
BROADCAST_ROWS = 200_000

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of a byte array."""
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = _WORD[data]
    edge = np.diff(flag)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def token_hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    return span_hashes(data, *tokens(data))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the marked positions of every window of a mask's length."""
    k = len(words) - len(mask) + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(k, np.uint64(hash_of_mask(mask)))
    for i, on in enumerate(mask):
        if on == "1":
            acc = acc * np.uint64(0x9E6C63D0876A9A47) + words[i : i + k]
    return mix(acc)


def hash_of_mask(mask: str) -> int:
    return int(mask, 2) * 0xD6E8FEB86659FD93 + len(mask) & MASK64


def masks_of(size: int) -> list[str]:
    """The masks of an item of so many tokens."""
    if size >= len(MASKS[0]):
        return [m for m in (*MASKS, *(LIGHT_MASKS if size < LIGHT_TOKENS else ())) if len(m) <= size]
    ignored = 2 if size >= 8 else 1 if size >= SHORT else -1
    sizes = [(size - cut_off, ignored - cut_off) for cut_off in range(ignored + 1)]
    return ["".join("0" if i in at else "1" for i in range(n)) for n, k in sizes for at in itertools.combinations(range(n), k)]


def items_of(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item (a key), item_id, words (hashes of the tokens) of the different items that are searched."""

    def run(batches):
        for batch in batches:
            words = [token_hashes(t.as_py()).view(np.int64) for t in batch.column(2)]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.int64()))], ["item", "item_id", "words"])
            yield out.filter(pa.array([len(w) >= SHORT for w in words], pa.bool_()))

    rows = texts(benchmark, item_col, item_text).distinct()
    keyed = rows.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").alias("item"), F.col("doc_id").alias("item_id"), "text")
    return heavy_map(keyed, run, "item bigint, item_id bigint, words array<bigint>")


def seeds_of(items: DataFrame) -> DataFrame:
    """hash, item, place of every window of every item under every mask of its."""

    def run(batches):
        for batch in batches:
            found: list[tuple] = []
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = np.array(words.as_py(), np.int64).view(np.uint64)
                for mask in masks_of(len(words)):
                    h = seed_hashes(words, mask)
                    found.append((h.view(np.int64), np.full(len(h), item, np.int64), np.arange(len(h))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["hash", "item", "place"])

    return heavy_map(items.select("item", "words"), run, "hash bigint, item bigint, place bigint").distinct()


class Filter:
    """Which hashes may be seeds: one bit for each value of their first bits."""

    def __init__(self, seeds: DataFrame):
        self.bits = min(FILTER_BITS, max(16, (BITS_A_SEED * seeds.count()).bit_length()))
        at = seeds.select(F.shiftrightunsigned("hash", 64 - self.bits).alias("at"))
        found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
        rows = found.toArrow()  # 2 ** (FILTER_BITS - 6) rows at most
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        self.words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def hits(docs: DataFrame, known: Filter, masks: list[str]) -> DataFrame:
    """doc (a key), hash, at: the windows of (doc, text) whose hashes pass the filter."""
    spread = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        passes = spread.value
        for batch in batches:
            docs_, hashes, ats = [], [], []
            for ids, run_ in text_blocks(batch):
                data = [t.lower().encode("utf-8", "surrogatepass") for t in run_]
                joined = np.frombuffer(b"\n".join(data), np.uint8)
                starts, ends = tokens(joined)
                words = span_hashes(joined, starts, ends)
                edges = np.searchsorted(starts, np.cumsum([0] + [len(d) + 1 for d in data]))
                keys = np.array(ids, np.int64)
                for mask in masks:
                    h = seed_hashes(words, mask)
                    at = np.flatnonzero(passes.holds(h)) if len(h) else np.empty(0, np.int64)
                    doc = np.searchsorted(edges, at, "right") - 1
                    whole = at + len(mask) <= edges[doc + 1] if len(at) else np.empty(0, bool)  # not across two documents
                    at, doc = at[whole], doc[whole]
                    docs_.append(keys[doc])
                    hashes.append(h[at].view(np.int64))
                    ats.append(at - edges[doc])
            if docs_:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (docs_, hashes, ats)], ["doc", "hash", "at"])

    return heavy_map(docs, run, "doc bigint, hash bigint, at bigint")


def best_segment(equal: np.ndarray) -> tuple[int, int]:
    """Start and end of the segment with the highest score; the leftmost and longest of equals."""
    sums = np.r_[0, np.cumsum(np.where(equal, 1, SUBSTITUTION))]
    low = np.minimum.accumulate(sums)
    end = int((sums - low).argmax())
    return int(np.flatnonzero(sums[: end + 1] == low[end])[0]), end


def overlap(words: np.ndarray, first: int, item: np.ndarray) -> tuple[int, int, int] | None:
    """(first, tokens, matching) in item positions, of words aligned with item[first:]; None if they do not overlap enough."""
    equal = words == item[first : first + len(words)]
    found = None
    start, end = best_segment(equal)
    matched = int(equal[start:end].sum())
    if (matched >= LONG or matched >= COVER * len(item)) and matched >= IDENTITY * (end - start) and matched:
        found = start, end - start, matched
    if int(equal.sum()) >= IDENTITY * len(item) and (found is None or int(equal.sum()) > found[2]):
        at = np.flatnonzero(equal)
        found = int(at[0]), int(at[-1] - at[0] + 1), int(equal.sum())
    return found and (first + found[0], found[1], found[2])


def windows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc, item, diagonal, words: what the documents (doc, text) have along the diagonals of wanted (doc, ask)."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, text, ask in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = token_hashes(text.as_py()).view(np.int64)
                out += [(doc, x["item"], x["diagonal"], words[max(0, x["diagonal"]) : max(0, x["diagonal"] + x["size"])]) for x in ask]
            if out:
                a, b, c, d = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.list_(pa.int64()))], ["doc", "item", "diagonal", "words"])

    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.dropDuplicates(["doc"]) if not few else docs
    return heavy_map(rows.join(F.broadcast(wanted) if few else wanted, "doc").select("doc", "text", "ask"), run, "doc bigint, item bigint, diagonal bigint, words array<bigint>").distinct()


def verified(rows: DataFrame) -> DataFrame:
    """doc, item_id, doc_token, n_tokens, n_matched, item_tokens, item_token of (doc, item_id, diagonal, words, item_words)."""
    names = ["doc", "item", "item_id", "doc_token", "n_tokens", "n_matched", "item_tokens", "item_token"]

    def run(batches):
        for batch in batches:
            out = []
            for doc, item, item_id, diagonal, words, own in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                found = overlap(np.array(words, np.int64), max(0, -diagonal), np.array(own, np.int64))
                if found:
                    out.append((doc, item, item_id, diagonal + found[0], found[1], found[2], len(own), found[0]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return heavy_map(rows.select("doc", "item", "item_id", "diagonal", "words", "item_words"), run, ", ".join(f"{n} bigint" for n in names))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that overlap: where, how many tokens, how many of them match."""
    keyed = texts(docs, id_col, text_col).select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text").alias("doc"), "doc_id", "text")
    items = cut(items_of(benchmark, item_col, item_text))
    seeds = cut(seeds_of(items))
    sizes = [r["n"] for r in items.select(F.least(F.size("words"), F.lit(LIGHT_TOKENS)).alias("n")).distinct().collect()]  # LIGHT_TOKENS at most
    masks = sorted({m for n in sizes for m in masks_of(n)})
    found = hits(keyed.select("doc", "text"), Filter(seeds), masks)
    diagonals = found.join(seeds, "hash").select("doc", "item", (F.col("at") - F.col("place")).alias("diagonal")).distinct()
    asked = diagonals.join(items.select("item", F.size("words").cast("bigint").alias("size")), "item")
    wanted = cut(asked.groupBy("doc").agg(F.collect_list(F.struct("item", "diagonal", "size")).alias("ask")))
    cuts = windows(keyed.select("doc", "text"), wanted)
    checked = verified(cuts.join(items.withColumnRenamed("words", "item_words"), "item"))
    rank = F.struct("n_matched", (-F.col("doc_token")).alias("left"), "n_tokens", "item_token", "item_tokens", "item_id")
    best = cut(checked.groupBy("doc", "item").agg(F.max(rank).alias("x")).select("doc", "x.*"))
    drop(seeds, wanted)
    few = best.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = keyed.select("doc", "doc_id").join(F.broadcast(best) if few else best, "doc")
    return out.select("doc_id", "item_id", (-F.col("left")).alias("doc_token"), "n_tokens", "n_matched", "item_tokens", "item_token")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op8_decontaminate": op8_decontaminate}
ORACLE_SQL: dict[str, str] = {}
