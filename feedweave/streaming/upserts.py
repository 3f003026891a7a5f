"""Insert-only upsert as a stream: an extension, labelled as such; the batch form is operators.upsert.insert_only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from feedweave.operators.rules import public


def first_versions(stream: DataFrame, key: str = "id", event_time: str | None = None, delay: str = "7 days") -> DataFrame:
    """The first public row of each id; with an event time, ids are remembered for the delay only."""
    rows = stream.where(public(F.col("availability"))) if "availability" in stream.columns else stream
    if event_time:
        return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def upsert_into(stream: DataFrame, folder: str, checkpoint: str, key: str = "id"):
    """Appends unseen rows to a Parquet folder, all that is available now; returns the finished query."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(folder).select(key)
        except Exception as error:  # the folder does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = None
        new = batch.dropDuplicates([key])
        (new if known is None else new.join(known, key, "left_anti")).write.mode("append").parquet(folder)

    rows = stream.where(public(F.col("availability"))) if "availability" in stream.columns else stream
    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
