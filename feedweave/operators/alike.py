"""Classes of rows that no scorer tells apart: they are scored once, assigned from as wholes, and made pairs of rows last.

Rows of one show with equal values in every column that a score reads are one class.  What is costly, the text functions and
the scores, is done for classes; copies cost their share of a class's list of rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from feedweave.operators.upsert import cut
from feedweave.session import ship

#: Rows of a class that are listed together when pairs are made, and pairs that one task makes, about.
PIECE, TASK_PAIRS = 1000, 5_000_000
#: Rows of each side of which lists are broadcast, 8 bytes a row and about 60 a class.
BROADCAST_ROWS = 2_000_000
#: Rows and scored pairs of classes of one show that one task assigns.
TASK_ROWS = 5_000_000


@dataclass
class Classes:
    rows: DataFrame  # show, idx (the class), columns
    members: DataFrame  # show, class, idx


@dataclass
class Scored:
    """Scores of pairs of classes: show, ref_idx, dl_idx (classes), score; and the rows of the classes of each side."""

    scores: DataFrame
    refs: DataFrame
    dls: DataFrame

    def pairs(self) -> DataFrame:
        """show, ref_idx, dl_idx, score of all pairs of rows.

        What is dealt to tasks are scores and the numbers of two pieces, not lists of rows: a class's list would travel
        once for each of its scores.  Lists come to the tasks by broadcast; beyond BROADCAST_ROWS of a side by a shuffle.
        """
        sized = self.scores.join(_sizes(self.refs, "ref"), ["show", "ref_idx"]).join(_sizes(self.dls, "dl"), ["show", "dl_idx"])
        total = sized.agg(F.sum(F.col("n_ref") * F.col("n_dl"))).first()[0] or 0
        spark = self.scores.sparkSession
        tasks = max(spark.sparkContext.defaultParallelism, -(-total // TASK_PAIRS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = sized.withColumn("ref_piece", every("of_ref")).withColumn("dl_piece", every("of_dl")).drop("n_ref", "n_dl", "of_ref", "of_dl")
        # One row may stand for PIECE squared pairs: rows are dealt before they are divided.
        dealt = lambda df: df.repartition(tasks, "ref_idx", "dl_idx", "ref_piece", "dl_piece")
        small = all(members.count() <= BROADCAST_ROWS for members in (self.refs, self.dls))
        rows = dealt(rows) if small else rows
        for members, side in ((self.refs, "ref"), (self.dls, "dl")):
            pieces = _pieces(members, side)
            rows = rows.join(F.broadcast(pieces) if small else pieces, ["show", f"{side}_idx", f"{side}_piece"])
        rows = rows if small else dealt(rows)
        rows = rows.select("show", F.explode("refs").alias("ref_idx"), "dls", "score")
        return rows.select("show", "ref_idx", F.explode("dls").alias("dl_idx"), "score")


def _sizes(members: DataFrame, side: str) -> DataFrame:
    """Rows of each class, and into how many pieces they are divided."""
    return members.groupBy("show", F.col("class").alias(f"{side}_idx")).agg(F.count("*").alias(f"n_{side}"), F.ceil(F.count("*") / PIECE).cast("int").alias(f"of_{side}"))


def _pieces(members: DataFrame, side: str) -> DataFrame:
    """Lists of about PIECE rows of each class."""
    size = _sizes(members, side).select("show", F.col(f"{side}_idx").alias("class"), F.col(f"of_{side}").alias("of"))
    piece = F.pmod(F.xxhash64("idx"), F.col("of")).cast("int")
    listed = members.join(size, ["show", "class"]).groupBy("show", F.col("class").alias(f"{side}_idx"), piece.alias(f"{side}_piece"))
    return listed.agg(F.collect_list("idx").alias(f"{side}s"))


def classes(df: DataFrame, columns: list[str]) -> Classes:
    """Classes of the rows (show, idx, columns) by show and columns; null is a value of its own."""
    told = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    keyed = df.where("show IS NOT NULL").select("show", F.col("idx").cast("bigint").alias("idx"), *columns, F.sha2(F.concat(*told), 256).alias("key"))
    first = keyed.groupBy("show", "key").agg(*[F.first(c).alias(c) for c in columns])
    first = cut(first.withColumn("class", F.monotonically_increasing_id()))
    members = cut(keyed.select("show", "key", "idx").join(first.select("show", "key", "class"), ["show", "key"]).select("show", "class", "idx"))
    return Classes(first.select("show", F.col("class").alias("idx"), *columns), members)


def one_task(scored: Scored) -> bool:
    """Every show's rows and scored pairs of classes fit a task."""
    parts = scored.scores.select("show").union(scored.refs.select("show")).union(scored.dls.select("show"))
    return (parts.groupBy("show").count().agg(F.max("count")).first()[0] or 0) <= TASK_ROWS


def greedy(scored: Scored) -> DataFrame:
    """show, ref_idx, dl_idx, score, rank: the greedy assignment of rows from the scores of classes, one task for each show.

    A class's rows leave in the order of their indices, so a place in its list is all that is kept of it.  Of the pairs with
    one score the least reference goes first, to the least download that is left among those its class is scored with.
    """
    none = F.lit(None)
    scores = scored.scores.select("show", F.lit(0).alias("kind"), F.col("ref_idx").alias("a"), F.col("dl_idx").alias("b"), "score")
    listed = [rows.select("show", F.lit(kind).alias("kind"), F.col("class").alias("a"), F.col("idx").alias("b"), none.cast("double").alias("score")) for kind, rows in ((1, scored.refs), (2, scored.dls))]
    schema = pa.schema([("show", pa.string()), ("ref_idx", pa.int64()), ("dl_idx", pa.int64()), ("score", pa.float64()), ("rank", pa.int64())])

    def run(block: pa.Table) -> pa.Table:
        show = block["show"][0].as_py()
        kind, a, b, score = (block[c].to_numpy() for c in ("kind", "a", "b", "score"))
        sides = []
        for of in (1, 2):
            rows: dict = {}
            for c, i in zip(a[kind == of].tolist(), b[kind == of].tolist(), strict=True):
                rows.setdefault(c, []).append(i)
            sides.append({c: sorted(x, reverse=True) for c, x in rows.items()})
        scored_ = kind == 0
        found = assigned(zip(score[scored_].tolist(), a[scored_].tolist(), b[scored_].tolist(), strict=True), *sides)
        r, d, s = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
        return pa.Table.from_arrays([pa.array([show] * len(found), pa.string()), pa.array(r, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64()), pa.array(range(1, len(found) + 1), pa.int64())], schema=schema)

    ship(scored.scores.sparkSession)
    return scores.union(listed[0]).union(listed[1]).groupBy("show").applyInArrow(run, "show string, ref_idx bigint, dl_idx bigint, score double, rank bigint")


def assigned(edges, refs: dict[int, list[int]], dls: dict[int, list[int]]) -> list[tuple[int, int, float]]:
    """(ref, dl, score) in order of commitment, of (score, class, class); rows of each class in falling order, consumed."""
    out, ref_gone, dl_gone = [], set(), set()

    def least(rows: list[int], gone: set) -> int | None:
        while rows and rows[-1] in gone:
            rows.pop()
        return rows[-1] if rows else None

    levels: dict[float, dict[int, list[int]]] = {}
    for score, x, y in edges:
        levels.setdefault(score, {}).setdefault(x, []).append(y)
    for score in sorted(levels, reverse=True):
        with_ = levels[score]
        heap = [(i, x) for x in with_ if (i := least(refs[x], ref_gone)) is not None]
        heapq.heapify(heap)
        while heap:
            i, x = heapq.heappop(heap)
            if i in ref_gone:  # a row that is listed twice
                i = least(refs[x], ref_gone)
                if i is not None:
                    heapq.heappush(heap, (i, x))
                continue
            left = [(j, y) for y in with_[x] if (j := least(dls[y], dl_gone)) is not None]
            with_[x] = [y for _, y in left]
            if not left:
                continue  # none of its downloads is left, nor for later rows of its class
            j, _ = min(left)
            ref_gone.add(i)
            dl_gone.add(j)
            out.append((i, j, score))
            after = least(refs[x], ref_gone)
            if after is not None:
                heapq.heappush(heap, (after, x))
    return out
