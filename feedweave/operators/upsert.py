"""Insert-only upsert, lineage cuts, and comparison of two results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F

from feedweave.operators.rules import public


def cut(df: DataFrame) -> DataFrame:
    """Materialise df as a table in the folder all executors share (spark.checkpoint.dir); lineage ends there.

    Unset, it is a temporary folder in local mode and an error elsewhere.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="feedweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder.rstrip('/')}/feedweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def insert_only(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Old rows, and the public new rows with ids that old lacks; of new rows with one id the first in order stays."""
    rows = new.where(public(F.col("availability"))) if "availability" in new.columns else new
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("r")).select("r.*") if order else rows.dropDuplicates([key])
    return old.unionByName(first.join(old.select(key), key, "left_anti").select(*old.columns))


def difference(primary: DataFrame, candidate: DataFrame) -> DataFrame:
    """Rows that only one of two results has, as often as it has them: side is primary or candidate."""
    columns = primary.columns
    a = primary.exceptAll(candidate.select(*columns)).withColumn("side", F.lit("primary"))
    return a.union(candidate.select(*columns).exceptAll(primary).withColumn("side", F.lit("candidate")))
