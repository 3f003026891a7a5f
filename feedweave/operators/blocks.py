"""Scores of all pairs of a show without making the pairs: blocks of rows meet in one Arrow task and are compared as matrices.

A show's references and downloads are cut into chunks of about CHUNK rows; every chunk of one side meets every chunk of the
other (a block nested-loop join, so a hot show is many tasks and no task holds more than two chunks).  Inside a block all that depends on
titles is done once for each pair of different titles: common anchors, containment, markers and letters are matrices of counts.
The longest common subsequences, the costly part, are only found where these bounds leave a score above zero possible:

* other numbers in a marker: rejected;
* no common anchor: the title similarity must reach WEAK_ANCHOR, which bounds the letters in common and then the plain ratio;
* `least` above zero: the similarity of titles that a pair's dates, ids and anchors still ask for must be within the letters in common;
* descriptions are compared last, and only if the pair can still reach `least`.

The bounds are never below the similarity, so the result is that of scoring every pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from feedweave.config import CERTAINTY, CONTAINMENT_BONUS, MONTHS, OVERLAP_BONUS, RESCUE, WEAK_ANCHOR, Alignment
from feedweave.functions import similarity
from feedweave.session import ship

CHUNK = 1000
#: Pairs of strings that are compared at a time.
_PAIRS = 100_000
_SLACK = 1e-9
SCORES = pa.schema([("show", pa.string()), ("ref_idx", pa.int64()), ("dl_idx", pa.int64()), ("score", pa.float64())])
_DAY = 86_400_000_000


def scores(a: DataFrame, b: DataFrame, alignment: Alignment | dict[str, Alignment] = Alignment(), semantics: str = "legacy", least: float | None = 0.0, chunk: int | None = None) -> DataFrame:
    """show, ref_idx, dl_idx, score of the pairs of features() that score above zero, and at least `least` (None: the show's tolerance).

    alignment: one for all shows, or one for each show by name (others: the default).  semantics "title" compares titles alone.
    """
    chunk = chunk or CHUNK
    columns = ["idx", "id", "title_n", "desc_n", F.unix_micros(F.col("pub_date").cast("timestamp")).alias("micros"), "anchors", F.transform("markers", lambda m: m.cast("string")).alias("markers")]
    count = lambda df, name: df.groupBy("show").agg(F.ceil(F.count("*") / chunk).cast("int").alias(name))
    sizes = count(a, "of_a").join(count(b, "of_b"), "show")
    place = lambda n: F.pmod(F.xxhash64("idx"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = a.select("show", *columns).join(sizes, "show").withColumn("ca", place("of_a")).withColumn("cb", every("of_b"))
    right = b.select("show", *columns).join(sizes, "show").withColumn("cb", place("of_b")).withColumn("ca", every("of_a"))
    both = left.withColumn("is_ref", F.lit(True)).unionByName(right.withColumn("is_ref", F.lit(False))).drop("of_a", "of_b")

    def run(block: pa.Table) -> pa.Table:
        show = block["show"][0].as_py()
        how = alignment.get(show, Alignment()) if isinstance(alignment, dict) else alignment
        refs, dls = (Side(block.filter(side)) for side in (block["is_ref"], pa.compute.invert(block["is_ref"])))
        r, c, s = Block(refs, dls, how, semantics).scores(how.match_tolerance if least is None else least)
        return pa.Table.from_arrays([pa.array([show] * len(r), pa.string()), pa.array(refs.idx[r]), pa.array(dls.idx[c]), pa.array(s)], schema=SCORES)

    spark = ship(a.sparkSession)
    # Blocks are few bytes and much work: by their bytes adaptive execution would put many of them, or all, into one task.
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(tasks, "show", "ca", "cb").groupBy("show", "ca", "cb").applyInArrow(run, "show string, ref_idx bigint, dl_idx bigint, score double")


def _distinct(values: list) -> tuple[list, np.ndarray]:
    """The different values, and the place of each value among them."""
    of: dict = {}
    return of, np.array([of.setdefault(v, len(of)) for v in values], np.int64)


class Side:
    """One side of a block: columns of its rows, and its different titles with what depends on them."""

    def __init__(self, rows: pa.Table):
        self.idx = rows["idx"].to_numpy()
        self.ids, self.descs = ([x or "" for x in rows[c].to_pylist()] for c in ("id", "desc_n"))
        micros = rows["micros"]
        self.dated, self.micros = micros.is_valid().to_numpy(), micros.fill_null(0).to_numpy()
        titles, self.title = _distinct(rows["title_n"].to_pylist())
        self.titles = list(titles)
        first = {t: n for n, t in reversed(list(enumerate(self.title.tolist())))}
        anchors, markers = rows["anchors"].to_pylist(), rows["markers"].to_pylist()
        self.anchors = [set(anchors[first[t]]) for t in range(len(self.titles))]
        self.markers = [markers[first[t]] for t in range(len(self.titles))]
        self.length = np.array([len(t) for t in self.titles], np.int64)


def common(a: list[set], b: list[set], of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many elements that satisfy `of` each set of a has, each of b, and each pair in common."""
    at: tuple[dict, dict] = ({}, {})
    for places, sets in zip(at, (a, b), strict=True):
        for n, tokens in enumerate(sets):
            for t in tokens:
                if of(t):
                    places.setdefault(t, []).append(n)
    both = np.zeros((len(a), len(b)), np.int32)
    for t in at[0].keys() & at[1].keys():
        both[np.ix_(at[0][t], at[1][t])] += 1
    sizes = [np.array([sum(map(of, tokens)) for tokens in sets], np.int32) for sets in (a, b)]
    return sizes[0][:, None], sizes[1][None, :], both


_LETTERS, _DIGITS, _MONTHS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), frozenset("0123456789"), frozenset(MONTHS)


def named(token: str) -> bool:
    return token not in _MONTHS and not _LETTERS.isdisjoint(token)


def telling(token: str) -> bool:
    return token not in _MONTHS and (len(token) >= 2 and not _DIGITS.isdisjoint(token) or len(token) >= 4 and not _LETTERS.isdisjoint(token))


class Block:
    def __init__(self, a: Side, b: Side, alignment: Alignment, semantics: str):
        self.a, self.b, self.how = a, b, alignment
        self.kernel, self.plain, self.title_only = semantics == "kernel", semantics == "token_ratio", semantics == "title"

    def letters(self) -> np.ndarray:
        """The letters that titles have in common, in share of both lengths: no ratio is above it."""
        count = [{}, {}]
        for side, counts in ((self.a, count[0]), (self.b, count[1])):
            for n, t in enumerate(side.titles):
                for c in set(t):
                    counts.setdefault(c, np.zeros(len(side.titles), np.int32))[n] = t.count(c)
        same = np.zeros((len(self.a.titles), len(self.b.titles)), np.int32)
        for c in count[0].keys() & count[1].keys():
            same += np.minimum(count[0][c][:, None], count[1][c][None, :])
        return 2.0 * same / np.maximum(1, self.a.length[:, None] + self.b.length[None, :])

    def mismatch(self) -> np.ndarray:
        """Two different numbers for one marker."""
        out = np.zeros((len(self.a.titles), len(self.b.titles)), bool)
        for k in range(len(self.a.markers[0])):
            _, codes = _distinct([m[k] for m in (*self.a.markers, *self.b.markers)])
            null = np.array([m[k] is None for m in (*self.a.markers, *self.b.markers)])
            x, y = codes[: len(self.a.markers)], codes[len(self.a.markers) :]
            out |= (x[:, None] != y[None, :]) & ~null[: len(x), None] & ~null[None, len(x) :]
        return out

    def similar(self, x: np.ndarray, y: np.ndarray, a: list[str], b: list[str]) -> np.ndarray:
        """Similarity of the strings a[x] and b[y]."""
        out = np.empty(len(x))
        for at in range(0, len(x), _PAIRS):
            p, q = [a[i] for i in x[at : at + _PAIRS]], [b[i] for i in y[at : at + _PAIRS]]
            if self.plain:
                out[at : at + _PAIRS] = np.maximum(similarity.token_sort_ratios(p, q), similarity.token_set_ratios(p, q))
            else:
                out[at : at + _PAIRS] = similarity.blended(p, q, self.kernel)
        return out

    def needed(self, same: np.ndarray, bonus: np.ndarray, least: float) -> np.ndarray:
        """Of each pair of titles the similarity that one of its pairs of rows needs to reach least, if descriptions are equal.

        CERTAINTY is enough for any, because then dates do not count.
        """
        a, b, w = self.a, self.b, self.how.weights
        has_desc = np.array([d != "" for d in a.descs])[:, None] & np.array([d != "" for d in b.descs])[None, :]
        has_date = a.dated[:, None] & b.dated[None, :]
        date = self.date_scores(a.micros[:, None] - b.micros[None, :])
        weight = w.title + np.where(has_desc, w.description, 0.0) + np.where(has_date, w.date, 0.0)
        rest = np.where(has_desc, w.description, 0.0) + np.where(has_date, w.date * date, 0.0)
        extra = bonus[a.title][:, b.title] + np.where(same & (not self.kernel), w.id, 0.0)
        rows = np.minimum(CERTAINTY, ((least - extra) * weight - rest) / w.title)
        out = np.full((len(a.titles), len(b.titles)), np.inf)
        np.minimum.at(out, (np.broadcast_to(a.title[:, None], rows.shape), np.broadcast_to(b.title[None, :], rows.shape)), rows)
        return out

    def date_scores(self, apart: np.ndarray) -> np.ndarray:
        days = np.abs(apart) // _DAY if self.kernel else np.abs(apart // _DAY)
        return np.select([days <= n for n, _ in self.how.date_score_tiers], [v for _, v in self.how.date_score_tiers], 0.0)

    def title_similarity(self, viable: np.ndarray, overlap: np.ndarray, need: np.ndarray | None = None) -> np.ndarray:
        """Of viable pairs; 0 where it is known to be below WEAK_ANCHOR without a common anchor, or below need."""
        t = np.zeros(viable.shape)
        r, s, u = similarity.BLEND
        letters = self.letters()
        if need is not None:
            empty = (self.a.length[:, None] == 0) | (self.b.length[None, :] == 0)  # letters know nothing of these
            viable = viable & (empty | ((r + s) * letters + u >= need - _SLACK))
        alone = viable & (overlap == 0) & (self.a.length[:, None] > 0) & (self.b.length[None, :] > 0) & ((r + s) * letters + u >= WEAK_ANCHOR - _SLACK)
        x, y = np.nonzero(alone)
        ratio = np.concatenate([similarity.ratios([self.a.titles[i] for i in x[at : at + _PAIRS]], [self.b.titles[i] for i in y[at : at + _PAIRS]]) for at in range(0, max(1, len(x)), _PAIRS)])
        keep = r * ratio + s * letters[x, y] + u >= WEAK_ANCHOR - _SLACK
        more_x, more_y = np.nonzero(viable & (overlap > 0))
        x, y = np.concatenate([x[keep], more_x]), np.concatenate([y[keep], more_y])
        t[x, y] = self.similar(x, y, self.a.titles, self.b.titles)
        return t

    def scores(self, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of a, rows of b, scores) of pairs above zero and not below least."""
        a, b = self.a, self.b
        if not len(a.idx) or not len(b.idx):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        _, codes = _distinct([*a.ids, *b.ids])
        x, y = codes[: len(a.ids)], codes[len(a.ids) :]
        same = (x[:, None] == y[None, :]) & np.array([i != "" for i in a.ids])[:, None]
        if self.plain:
            return self._plain(same, least)
        if self.title_only:
            return self._titles(least)
        size_a, size_b, overlap = common(a.anchors, b.anchors, lambda t: True)
        viable = ~self.mismatch()
        smaller = np.minimum(size_a, size_b)
        contained = (smaller >= 2) & (overlap == smaller)
        shared = common(a.anchors, b.anchors, telling)[2] > 0
        need = None
        if least > 0 and self.how.weights.title > 0:
            need = self.needed(same, np.where(contained, CONTAINMENT_BONUS, np.where(shared & (not self.kernel), OVERLAP_BONUS, 0.0)), least)
        t = self.title_similarity(viable, overlap, need)
        alive = viable & ((overlap > 0) | (t >= WEAK_ANCHOR))
        named_a, named_b, named_both = common(a.anchors, b.anchors, named)
        either = (size_a > 0) & (size_b > 0)
        in_b, in_a = either & (overlap == size_a), either & (overlap == size_b) & (overlap != size_a)
        one_extra = (in_b & (size_b - overlap == 1) & (named_b > named_both)) | (in_a & (size_a - overlap == 1) & (named_a > named_both))

        rows = alive[a.title][:, b.title]
        r, c = np.nonzero(rows | same if self.kernel else rows)
        i, j, same = a.title[r], b.title[c], same[r, c]
        rejected, t = ~alive[i, j], t[i, j]
        w, sure, free = self.how.weights, t >= CERTAINTY, same & (not self.kernel)
        desc_a, desc_b = (np.array([d != "" for d in s.descs]) for s in (a, b))
        has_desc, has_date = desc_a[r] & desc_b[c], a.dated[r] & b.dated[c]
        rejected |= ~sure & ~free & ~has_desc & (t < self.how.sparse_title_min)
        rejected |= ~sure & ~free & has_desc & has_date & one_extra[i, j] & (t >= RESCUE)
        use_date = ~sure & has_date
        apart = a.micros[r] - b.micros[c]
        date = self.date_scores(apart)
        bonus = np.where(~sure & contained[i, j], CONTAINMENT_BONUS, np.where(~sure & shared[i, j] & (not self.kernel), OVERLAP_BONUS, 0.0))

        def total(d):
            base = (w.title * t + np.where(has_desc, w.description * d, 0.0) + np.where(use_date, w.date * date, 0.0)) / (w.title + np.where(has_desc, w.description, 0.0) + np.where(use_date, w.date, 0.0))
            full = base + bonus
            return np.where(same, 1.0, np.minimum(1.0, full)) if self.kernel else np.minimum(1.0, full + np.where(same, w.id, 0.0))

        if self.kernel:
            rejected &= ~same
        keep = ~rejected & (total(1.0) >= max(least, 0.0) - _SLACK)
        ask = np.flatnonzero(keep & has_desc & ~(same & self.kernel))
        d = np.zeros(len(r))
        da, pa_ = _distinct(a.descs)
        db, pb_ = _distinct(b.descs)
        pairs, back = np.unique(pa_[r[ask]] * len(db) + pb_[c[ask]], return_inverse=True)
        d[ask] = self.similar(pairs // len(db), pairs % len(db), list(da), list(db))[back]
        s = total(d)
        keep &= (s > 0) & (s >= least)
        return r[keep], c[keep], s[keep]

    def _titles(self, least: float):
        """Title similarity alone."""
        a, b = self.a, self.b
        letters = self.letters()
        empty = (a.length[:, None] == 0) | (b.length[None, :] == 0)  # two empty titles are alike; letters know nothing of them
        r, s, u = similarity.BLEND
        x, y = np.nonzero(empty | ((r + s) * letters + u >= least - _SLACK))
        t = np.zeros(letters.shape)
        t[x, y] = self.similar(x, y, a.titles, b.titles)
        s = t[a.title][:, b.title]
        r, c = np.nonzero((s > 0) & (s >= least))
        return r, c, s[r, c]

    def _plain(self, same: np.ndarray, least: float):
        a, b = self.a, self.b
        x, y = (m.ravel() for m in np.indices((len(a.titles), len(b.titles))))
        t = self.similar(x, y, a.titles, b.titles).reshape(len(a.titles), len(b.titles))
        (da, pa_), (db, pb_) = _distinct(a.descs), _distinct(b.descs)
        x, y = (m.ravel() for m in np.indices((len(da), len(db))))
        d = self.similar(x, y, list(da), list(db)).reshape(len(da), len(db))
        s = np.minimum(1.0, 0.8 * t[a.title][:, b.title] + 0.1 * d[pa_][:, pb_] + np.where(same, 0.1, 0.0))
        r, c = np.nonzero((s > 0) & (s >= least))
        return r, c, s[r, c]
