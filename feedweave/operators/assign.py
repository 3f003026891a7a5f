"""Greedy one-to-one assignment: highest score first, ties by reference and download index.

Three forms with one result.  ``fold``: an array fold per show in SQL, for small shows.  ``grouped``: one sorted pass per
show in a Python task.  ``rounds``: in each round every pair that is first on both of its sides is committed and both sides
leave; distributed, for shows that exceed one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedweave.config import Alignment
from feedweave.operators import alike

#: Pairs of one show that a single task takes.
TASK_PAIRS = 2_000_000
SCHEMA = "show string, ref_idx bigint, dl_idx bigint, score double, rank bigint"


def _tidy(scores: DataFrame, tolerance: float | Column) -> DataFrame:
    return scores.select(F.col("show").cast("string").alias("show"), F.col("ref_idx").cast("bigint").alias("ref_idx"), F.col("dl_idx").cast("bigint").alias("dl_idx"), F.col("score").cast("double").alias("score")).where(F.col("score") >= tolerance)


def fold(scores: DataFrame, tolerance: float | Column) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "ref_idx", "dl_idx")))
    taken = "aggregate(p, cast(array() as array<struct<neg:double,ref_idx:bigint,dl_idx:bigint>>), (acc, x) -> if(exists(acc, y -> y.ref_idx = x.ref_idx or y.dl_idx = x.dl_idx), acc, array_append(acc, x)))"
    rows = _tidy(scores, tolerance).groupBy("show").agg(pairs.alias("p")).select("show", F.posexplode(F.expr(taken)).alias("rank", "x"))
    return rows.select("show", "x.ref_idx", "x.dl_idx", (-F.col("x.neg")).alias("score"), (F.col("rank") + 1).cast("bigint").alias("rank"))


def grouped(scores: DataFrame, tolerance: float | Column) -> DataFrame:
    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "ref_idx", "dl_idx"], ascending=[False, True, True], kind="stable")
        refs, dls, keep = set(), set(), []
        for i, (r, d) in enumerate(zip(pdf["ref_idx"].tolist(), pdf["dl_idx"].tolist(), strict=True)):
            if r not in refs and d not in dls:
                refs.add(r)
                dls.add(d)
                keep.append(i)
        out = pdf.iloc[keep].copy()
        out["rank"] = range(1, len(out) + 1)
        return out

    return _tidy(scores, tolerance).groupBy("show").applyInPandas(take, SCHEMA)


def rounds(scores: DataFrame, tolerance: float | Column) -> DataFrame:
    from feedweave.operators.upsert import cut

    left = cut(_tidy(scores, tolerance).distinct())
    order = [F.desc("score"), F.asc("ref_idx"), F.asc("dl_idx")]
    done = left.limit(0)
    while not left.isEmpty():
        best = lambda side: left.groupBy("show", side).agg(F.min(F.struct((-F.col("score")).alias("n"), "ref_idx", "dl_idx")).alias("b")).select("show", "b.ref_idx", "b.dl_idx")  # noqa: E731, B023
        won = cut(left.join(best("ref_idx"), ["show", "ref_idx", "dl_idx"], "left_semi").join(best("dl_idx"), ["show", "ref_idx", "dl_idx"], "left_semi"))
        done = done.union(won)
        left = cut(left.join(won.select("show", "ref_idx"), ["show", "ref_idx"], "left_anti").join(won.select("show", "dl_idx"), ["show", "dl_idx"], "left_anti"))
    return done.withColumn("rank", F.row_number().over(Window.partitionBy("show").orderBy(*order)).cast("bigint"))


def greedy(scores: DataFrame, alignment: Alignment | dict[str, Alignment] = Alignment(), method: str = "auto") -> DataFrame:
    """show, ref_idx, dl_idx, score, rank (order of commitment), above the tolerance of each show.

    auto: grouped where every show fits a task, else rounds.
    """
    from feedweave.operators.linkage import by_show

    tolerance = by_show(alignment, lambda x: F.lit(x.match_tolerance))
    if method == "auto":
        most = _tidy(scores, tolerance).groupBy("show").count().agg(F.max("count")).first()[0] or 0
        method = "grouped" if most <= TASK_PAIRS else "rounds"
    return {"fold": fold, "grouped": grouped, "rounds": rounds}[method](scores, tolerance)


def greedy_classes(scored: alike.Scored, alignment: Alignment | dict[str, Alignment] = Alignment(), method: str = "auto") -> DataFrame:
    """greedy() of all pairs of rows of the scored classes.

    auto: from the classes where every show fits a task, else rounds over the pairs of rows.
    """
    from feedweave.operators.linkage import by_show

    tolerance = by_show(alignment, lambda x: F.lit(x.match_tolerance))
    above = alike.Scored(_tidy(scored.scores, tolerance), scored.refs, scored.dls)
    if method == "auto" and alike.one_task(above):
        return alike.greedy(above)
    return greedy(above.pairs(), alignment, "rounds" if method == "auto" else method)
