"""Language-model scores by context-tree weighting over binary-decomposed bytes.

The text's token sequence (words with A-Z lowered, one space between two, one line feed as the end) is read as bytes, and
each byte as eight binary decisions.  Each decision (the bits of the byte that are known so far) has a context tree over
the preceding DEPTH bytes.  Every node holds a Krichevsky-Trofimov estimator of the training counts, and the estimators
of all depths are mixed by the weights of the context-tree recursion, P = (KT + product of the children) / 2, so that the
score is the code length of the text under the mixture.  A context never seen in training predicts as its longest seen
suffix does.

The documents go into blocks of about BLOCK characters, by a hash.  Each block asks once: it lists its different
(DEPTH + 1)-byte strings and its different words, with how often its training documents have them, and sends them to parts
by a hash of the word, or by the TOP bytes before the symbol.  A part adds up the counts of all blocks; those are the whole
tree, at every size, since everything below depth TOP depends on those bytes only, and no process holds more than a part
of it.  Parts hand up the sums of their nodes' log probabilities, from which the driver builds the levels above TOP (at most
256 ** TOP strings).  Then each part answers each block with the probabilities of the strings and the counts of the words that
it asked for, and the block's documents are scored.  Texts are shuffled twice, rows of words or strings never: they travel
in one packed array for each block and part.

Defined results: a null or empty text has the end token only; repeated rows are scored and counted as often as they
occur; a null doc_id is never held out; without training rows every count is 0; an empty table gives an empty table; only
the id and text columns are read.
"""

from __future__ import annotations

import collections
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.llm.common import cut, drop, table, texts
from feedweave.session import ship

FOLDS, HELD_OUT = 5, 1
DEPTH = 5
TOP = 2
#: Characters of the documents in a block, and for each part, about.
BLOCK, PART = 1 << 24, 1 << 22
END = 10
#: Bytes of text that are scored or counted together.
_CHUNK = 1 << 19


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def stream(words: list[bytes]) -> bytes:
    """The bytes that the model codes: words, single spaces, end."""
    return b" ".join(words) + b"\n"


def grams(data: np.ndarray, depth: int) -> np.ndarray:
    """For each byte, the preceding `depth` bytes (line feeds before the start) and itself, as one integer."""
    padded = np.concatenate([np.full(depth, END, np.uint8), data]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for i in range(depth + 1):
        out = (out << np.uint64(8)) | padded[i : i + len(data)]
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the KT block probability of a ones and b zeros."""
    out = np.empty(len(a))
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        out[at : at + (1 << 16)] = _lgamma(x + 0.5) + _lgamma(y + 0.5) - _lgamma(x + y + 1.0) - np.log(np.pi)
    return out


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after shifting the argument to 8 or more (error below 1e-10)."""
    shift = np.zeros_like(x)
    y = x.astype(np.float64).copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        shift[small] += np.log(y[small])
        y[small] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys, and the sums of the values for each."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


def _decisions(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted node keys of the eight decisions of each string's last byte, with counts of ones and of zeros."""
    symbol, context = keys & np.uint64(255), (keys >> np.uint64(8)) << np.uint64(8)
    keys_, ones_, zeros_ = [], [], []
    for bit in range(8):
        prefix = (np.uint64(1) << np.uint64(bit)) | (symbol >> np.uint64(8 - bit))
        one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.float64)
        one *= counts
        for part, got in zip((keys_, ones_, zeros_), _summed(context | prefix, one, counts - one), strict=True):
            part.append(got)
    key = np.concatenate(keys_)
    del keys_, symbol, context
    order = np.argsort(key).astype(np.uint32)
    key = key[order]
    ones = np.concatenate(ones_)
    del ones_
    ones = ones[order]
    zeros = np.concatenate(zeros_)
    del zeros_
    return key, ones, zeros[order]


class Tree:
    """The weighted context trees of counted strings.

    levels[d]: sorted node keys (the d context bytes, then the prefix of the byte with a leading one, 8 bits), the weight
    of stopping at the node, and its estimate of a one.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int = DEPTH, least: int = 0, below: tuple[np.ndarray, np.ndarray] | None = None):
        """Levels depth to least.  below: (parent keys, summed log Pw) of the level under the deepest; for least > 0, handed up as .below."""
        self.depth = depth
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [None] * (depth + 1)
        keys, counts = keys.astype(np.uint64), counts.astype(np.float64)
        self.strings = keys
        for d in range(depth, least - 1, -1):  # one level at a time: only keys and counts of strings are carried on
            if d < depth:
                keys, counts = _summed(keys & np.uint64((1 << (8 * (d + 1))) - 1), counts)
            key, ones, zeros = _decisions(keys, counts)
            weighted = log_kt(ones, zeros)
            stop = np.ones(len(key), np.float32)
            if below is not None:
                at = np.searchsorted(key, below[0])
                own = weighted[at] - np.log(2)
                joint = np.logaddexp(own, below[1] - np.log(2))
                stop[at] = np.exp(own - joint)
                weighted[at] = joint
            ones += 0.5
            zeros += ones
            zeros += 0.5
            ones /= zeros
            self.levels[d] = (key, stop, ones.astype(np.float32))
            del ones, zeros, stop
            if d:
                below = _summed(key & np.uint64((1 << (8 * d)) - 1), weighted)
        self.below = below
        self.values = None if least else self.slow(self.strings).astype(np.float32)

    def under(self, top: Tree) -> Tree:
        """The tree with the levels of top above its own."""
        self.levels[: top.depth + 1] = top.levels
        return self

    def slow(self, strings: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each string after the others."""
        total = np.zeros(len(strings))
        symbol, context = strings & np.uint64(255), strings >> np.uint64(8)
        for at in range(0, len(strings), 1 << 18):
            cut = slice(at, at + (1 << 18))
            s, c = symbol[cut], context[cut]
            for bit in range(8):
                prefix = (np.uint64(1) << np.uint64(bit)) | (s >> np.uint64(8 - bit))
                p, alive = np.full(len(s), 0.5), np.ones(len(s), bool)
                path, seen = [], alive
                for d in range(self.depth + 1):
                    key, stop, one = self.levels[d]
                    if not len(key):
                        break
                    want = ((c & np.uint64((1 << (8 * d)) - 1)) << np.uint64(8)) | prefix
                    i = np.minimum(np.searchsorted(key, want), len(key) - 1)
                    alive = alive & (key[i] == want)
                    if not alive.any():
                        break
                    path.append((alive, stop[i], one[i]))
                for alive, stop, one in reversed(path):
                    # A node without a seen child on the path predicts by itself.
                    if alive is path[-1][0]:
                        p = np.where(alive, one, p)
                    else:
                        p = np.where(seen, stop * one + (1 - stop) * p, np.where(alive, one, p))
                    seen = alive
                bit_is_one = ((s >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
                total[cut] += np.log10(np.where(bit_is_one, p, 1 - p))
        return total


def pack(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted keys (as differences) and their values, compressed."""
    data = values.dtype.str.encode().ljust(4) + np.diff(keys, prepend=np.uint64(0)).tobytes() + values.tobytes()
    return zstandard.ZstdCompressor(level=3).compress(data)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    kind = np.dtype(raw[:4].decode().strip())
    size = (len(raw) - 4) // (8 + kind.itemsize)
    return np.cumsum(np.frombuffer(raw, np.uint64, size, 4), dtype=np.uint64), np.frombuffer(raw, kind, size, 4 + 8 * size)


def added(parts) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys of pairs (sorted keys, counts) and their sums, merged whenever as many again have come in."""
    held, have, size = [(np.empty(0, np.uint64), np.empty(0, np.int64))], 0, 0
    for keys, counts in parts:
        held.append((keys, counts))
        size += len(keys)
        if size > max(1 << 21, have):
            held = [_merged(held)]
            have, size = len(held[0][0]), 0
    return _merged(held)


def _merged(held) -> tuple[np.ndarray, np.ndarray]:
    return _summed(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))


class Known:
    """Strings with their values, for a scorer that meets no others."""

    def __init__(self, strings: np.ndarray, values: np.ndarray):
        self.strings, self.values = strings, values


class Scorer:
    """log10 probabilities of strings: an open-addressing table in front of the tree, which also keeps what the tree computes."""

    def __init__(self, tree: Tree | Known, spare: int = 1 << 19):
        self.tree = tree
        self.bits = max(10, int(1.4 * (len(tree.strings) + spare)).bit_length())
        self.key = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.value = np.zeros(1 << self.bits, np.float32)
        self.room = len(tree.strings) + spare
        self._insert(tree.strings, tree.values)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _insert(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        if len(keys) > self.room:
            return
        self.room -= len(keys)
        slot, rest, empty = self._slot(keys), np.arange(len(keys)), np.uint64(0xFFFFFFFFFFFFFFFF)
        while len(rest):
            at = slot[rest]
            free = self.key[at] == empty
            self.key[at[free]] = keys[rest[free]]  # of several for one slot, the last stays
            done = self.key[at] == keys[rest]
            self.value[at[done]] = values[rest[done]]
            rest = rest[~done]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def __call__(self, strings: np.ndarray) -> np.ndarray:
        out = np.empty(len(strings), np.float32)
        slot, empty = self._slot(strings), np.uint64(0xFFFFFFFFFFFFFFFF)
        key = self.key[slot]
        hit = key == strings
        out[hit] = self.value[slot[hit]]
        rest = np.flatnonzero(~hit)
        missing = [rest[key[rest] == empty]]
        rest = rest[key[rest] != empty]
        at = slot[rest]
        while len(rest):
            at = (at + 1) & ((1 << self.bits) - 1)
            key = self.key[at]
            hit = key == strings[rest]
            out[rest[hit]] = self.value[at[hit]]
            gone = key == empty
            missing.append(rest[gone])
            go = ~(hit | gone)
            rest, at = rest[go], at[go]
        miss = np.concatenate(missing)
        if len(miss):
            new, back = np.unique(strings[miss], return_inverse=True)
            values = self.tree.slow(new).astype(np.float32)
            out[miss] = values[back]
            self._insert(new, values)
        return out


def held_out(doc_id, folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def laid_out(streams: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Streams one after the other, each behind `depth` line feeds: strings at each byte, begin and end of each stream."""
    lead = b"\n" * depth
    data = np.frombuffer(b"".join([x for s in streams for x in (lead, s)]), np.uint8)
    ends = np.cumsum([depth + len(s) for s in streams])
    begins = np.r_[0, ends[:-1]] + depth
    return grams(data, depth), begins, ends


def inside(size: int, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the strings are those of a stream's bytes, not of the line feeds before it."""
    use = np.zeros(size + 1, np.int8)
    np.add.at(use, begins, 1)
    np.add.at(use, ends, -1)
    return np.cumsum(use[:-1]).astype(bool)


def word_hash(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def chunks(batch, size: int = _CHUNK):
    """Lists of (position in the batch, words) of about `size` bytes."""
    out, have = [], 0
    for i, text in enumerate(batch.column("text")):
        words = tokens(text.as_py())
        out.append((i, words))
        have += sum(map(len, words))
        if have >= size:
            yield out
            out, have = [], 0
    if out:
        yield out


def part_of(strings: np.ndarray, parts: int) -> np.ndarray:
    """The part of strings, by the TOP bytes before the last."""
    return ((strings >> np.uint64(8) & np.uint64((1 << (8 * TOP)) - 1)) * np.uint64(40503) % np.uint64(65521) % np.uint64(parts)).astype(np.int64)


def dealt(keys: np.ndarray, counts: np.ndarray, part: np.ndarray):
    """(part, sorted keys, counts) of sorted keys."""
    order = np.argsort(part, kind="stable")
    keys, counts, part = keys[order], counts[order], part[order]
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    for a, b in zip(first, [*first[1:], len(part)], strict=True):
        yield int(part[a]), keys[a:b], counts[a:b]


#: What blocks ask for and parts answer with.
STRINGS, WORDS = 0, 1
_ASKED = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("data", pa.binary())])
_ANSWERED = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
_BUILT = pa.schema([("part", pa.int64()), ("data", pa.binary()), ("below", pa.binary()), ("shorter", pa.binary())])


def asked(blocked: DataFrame, parts: int, depth: int = DEPTH) -> DataFrame:
    """(kind, part, block, data: different strings or hashes of words, with their counts in the training documents)."""

    def run(group: pa.Table) -> pa.Table:
        words: collections.Counter = collections.Counter()
        others: set[bytes] = set()
        block = group["block"][0].as_py()

        def strings():
            for train in (True, False):
                for batch in group.filter(pc.equal(group["train"], train)).to_batches():
                    for some in chunks(batch):
                        for _, w in some:
                            (words if train else others).update(w)
                        if train:
                            words[b"\n"] += len(some)
                        else:
                            others.add(b"\n")
                        every, begins, ends = laid_out([stream(w) for _, w in some], depth)
                        keys = np.sort(every[inside(len(every), begins, ends)])
                        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                        counts = np.diff(np.r_[first, len(keys)])
                        yield keys[first], counts if train else np.zeros_like(counts)

        keys, counts = added(strings())
        rows = [(STRINGS, i, block, pack(k, n)) for i, k, n in dealt(keys, counts, part_of(keys, parts))]
        others.difference_update(words)
        hashes = word_hash([*words, *others])
        keys, counts = _summed(hashes, np.r_[np.fromiter(words.values(), np.int64, len(words)), np.zeros(len(others), np.int64)])
        rows += [(WORDS, i, block, pack(k, n)) for i, k, n in dealt(keys, counts, (keys % np.uint64(parts)).astype(np.int64))]
        return pa.Table.from_pylist([dict(zip(_ASKED.names, r, strict=True)) for r in rows], _ASKED)

    ship(blocked.sparkSession)
    return blocked.groupBy("block").applyInArrow(run, "kind int, part bigint, block bigint, data binary")


def built(asks: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(part, data: its strings and counts, below, shorter: what the levels above TOP need) of the training strings."""

    def run(group: pa.Table) -> pa.Table:
        keys, counts = added(unpack(x.as_py()) for x in group["data"])
        keys, counts = keys[counts > 0], counts[counts > 0]
        below = Tree(keys, counts, depth, TOP).below
        row = (group["part"][0].as_py(), pack(keys, counts), pack(*below), pack(*_summed(keys & np.uint64((1 << (8 * TOP)) - 1), counts)))
        return pa.Table.from_pylist([dict(zip(_BUILT.names, row, strict=True))], _BUILT)

    return asks.where(F.col("kind") == STRINGS).groupBy("part").applyInArrow(run, "part bigint, data binary, below binary, shorter binary")


def top_of(model: DataFrame) -> Tree:
    """The levels above TOP of all parts; one part at a time comes to the driver."""
    below, shorter = (np.empty(0, np.uint64), np.empty(0)), (np.empty(0, np.uint64), np.empty(0, np.int64))
    for row in model.select("below", "shorter").orderBy("part").toLocalIterator():
        below, shorter = ([np.concatenate(x) for x in zip(a, unpack(bytes(b)), strict=True)] for a, b in ((below, row["below"]), (shorter, row["shorter"])))
        below, shorter = _summed(*below), _summed(*shorter)
    return Tree(*shorter, TOP - 1, 0, below if len(below[0]) else None)


def string_values(asks: DataFrame, model: DataFrame, top: Tree, depth: int = DEPTH) -> DataFrame:
    """(kind, block, data: the block's strings of a part and their log10 probabilities)."""
    above = asks.sparkSession.sparkContext.broadcast(top)

    def run(group: pa.Table) -> pa.Table:
        mine, (keys, counts) = [], (np.empty(0, np.uint64), np.empty(0, np.int64))
        for block, data in zip(group["block"].to_pylist(), group["data"], strict=True):
            if block is None:
                keys, counts = unpack(data.as_py())
            else:
                mine.append((block, data))
        tree = Tree(keys, counts, depth, TOP).under(above.value)
        strings, _ = added(unpack(data.as_py()) for _, data in mine)
        values = tree.slow(strings).astype(np.float32)
        rows = []
        for block, data in mine:
            some, _ = unpack(data.as_py())
            rows.append({"kind": STRINGS, "block": block, "data": pack(some, values[np.searchsorted(strings, some)])})
        return pa.Table.from_pylist(rows, _ANSWERED)

    both = asks.where(F.col("kind") == STRINGS).select("part", "block", "data").unionByName(model.select("part", F.lit(None).cast("bigint").alias("block"), "data"))
    return both.groupBy("part").applyInArrow(run, "kind int, block bigint, data binary")


def word_values(asks: DataFrame) -> DataFrame:
    """(kind, block, data: the block's words of a part and their counts in all training documents, n, v): n and v, the part's
    tokens and different words in training, are on one row of a part."""

    def run(group: pa.Table) -> pa.Table:
        keys, counts = added(unpack(x.as_py()) for x in group["data"])
        rows = []
        for block, data in zip(group["block"].to_pylist(), group["data"], strict=True):
            some, _ = unpack(data.as_py())
            rows.append({"kind": WORDS, "block": block, "data": pack(some, counts[np.searchsorted(keys, some)]), "n": 0, "v": 0})
        rows[0] |= {"n": int(counts.sum()), "v": int((counts > 0).sum())}
        return pa.Table.from_pylist(rows, pa.schema([*_ANSWERED, ("n", pa.int64()), ("v", pa.int64())]))

    return asks.where(F.col("kind") == WORDS).groupBy("part").applyInArrow(run, "kind int, block bigint, data binary, n bigint, v bigint")


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, part: int = PART, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    docs = texts(docs, id_col, text_col)
    size = docs.select(F.sum(F.length("text"))).first()[0] or 0
    blocked = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // block))))).withColumn("train", ~held_out(F.col("doc_id")))
    asks = cut(asked(blocked, max(1, -(-size // part)), depth))
    model = cut(built(asks, depth))
    words = cut(word_values(asks))
    values = cut(string_values(asks, model, top_of(model), depth))
    drop(asks, model)
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n, base = total["n"], float(np.log10(0.5 / (total["n"] + 0.5 * (total["v"] + 1))))

    def run(group: pa.Table) -> pa.Table:
        answers = [(kind, unpack(data.as_py())) for kind, data in zip(group["kind"].to_pylist(), group["data"], strict=True) if kind is not None]
        join = lambda kind: tuple(np.concatenate(x) for x in zip(*(x for k, x in answers if k == kind), strict=True))
        scorer, (hashes, counts) = Scorer(Known(*join(STRINGS)), 0), join(WORDS)
        order = np.argsort(hashes)
        hashes, gain = hashes[order], np.log10(2.0 * counts[order] + 1.0)
        del answers
        group = group.filter(pc.is_valid(group["text"])).combine_chunks()
        worth: dict[bytes, float] = {}  # log10 (2 c + 1) of the words met so far
        out = []
        for batch in group.to_batches():
            ids, train = batch.column("doc_id").to_pylist(), batch.column("train").to_pylist()
            for some in chunks(batch):
                new = list({w for _, ws in some for w in ws if w not in worth} | ({b"\n"} - worth.keys()))
                worth.update(zip(new, gain[np.searchsorted(hashes, word_hash(new))].tolist(), strict=True))
                coded = [stream(w) for _, w in some]
                every, begins, ends = laid_out(coded, depth)
                each = np.zeros(len(every))
                mine = inside(len(every), begins, ends)
                each[mine] = scorer(every[mine])
                sums = np.r_[0.0, np.cumsum(each)]
                for (i, ws), s, code in zip(some, (sums[ends] - sums[begins]).tolist(), coded, strict=True):
                    known = [worth[w] for w in ws]
                    known.append(worth[b"\n"])
                    k = len(known)
                    out.append((ids[i], not train[i], k, k - known.count(0.0), n, math.fsum(known) + k * base, s, -s / math.log10(2) / len(code)))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), SCORED.types, strict=True)], schema=SCORED)

    both = blocked.unionByName(values.unionByName(words.drop("n", "v")), allowMissingColumns=True)
    return both.groupBy("block").applyInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double")


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


QUERIES = {"op9_ctw": op9_ctw}
ORACLE_SQL: dict[str, str] = {}
