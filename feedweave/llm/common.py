"""Shared plumbing of the training-data operators: inputs, checkpoints, vectorised word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.session import ship

MASK64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_BLOCK = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns (doc_id, text) only; a null text is an empty one."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.  In local mode, where none is configured, a temporary one; elsewhere that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="feedweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it from there: lineage ends, and the loss of executors is survived.

    Later reads take the columns they use only, and the planner knows the size.  drop() removes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/feedweave/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._feedweave_table = path
    return out


def hold(df: DataFrame) -> DataFrame:
    """Keep df, narrow rows that are read again soon, in the executors' memory and on their disks.

    Lineage stays: what a lost executor held is computed again, from the written tables before it.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def drop(*tables: DataFrame) -> None:
    """Remove tables that cut() wrote, and let go of what hold() kept; nothing that is still to be computed may need a written one."""
    for df in tables:
        spark, path = df.sparkSession, df.__dict__.pop("_feedweave_table", None)
        if path:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        else:
            df.unpersist()


#: Rows of an Arrow batch, which is held on both sides of the pipe: texts may be long.
ARROW_ROWS, ARROW_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def heavy_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow over one Arrow batch at a time.  The session's batches get smaller, unless they were set already."""
    spark = ship(df.sparkSession)
    if spark.conf.get(ARROW_SETTING) == "10000":
        spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))

    def run(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return what this process has freed to the system: an idle worker's memory adds to that of the stages after it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, vectorised (wraps modulo 2**64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    while have < n:
        step = np.uint64(pow(base, have, 1 << 64))
        take = min(have, n - have)
        out[have : have + take] = out[:take] * step
        have += take
    return out


_POW, _INV = _powers(_P, _BLOCK), _powers(_P_INV, _BLOCK)

#: True for the bytes that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without SPACE) of a byte array."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = np.empty(len(data) + 2, np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of a byte array, from polynomial prefix sums modulo 2**64.

    The array is taken in blocks that begin at span starts, so that the tables of powers stay small; a span
    longer than a block is hashed by its own polynomial, with the same value.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + _BLOCK - 1, side="right"))
        if j <= i:  # one span longer than a block
            span, acc, shift = data[base : ends[i]], 0, 1
            for at in range(0, len(span), _BLOCK):
                part = span[at : at + _BLOCK].astype(np.uint64) + np.uint64(1)
                acc = (acc + shift * int((part * _POW[: len(part)]).sum(dtype=np.uint64))) & MASK64
                shift = shift * pow(_P, len(part), 1 << 64) & MASK64
            out[i] = acc
            i += 1
            continue
        block = data[base : ends[j - 1]].astype(np.uint64) + np.uint64(1)
        total = np.empty(len(block) + 1, np.uint64)
        total[0] = 0
        np.cumsum(block * _POW[: len(block)], out=total[1:])
        a, b = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[b] - total[a]) * _INV[a]
        i = j
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word windows of an array of word hashes; fewer words than n make one window."""
    if len(words) == 0:
        return words
    if len(words) < n:
        n_used = len(words)
    else:
        n_used = n
    k = len(words) - n_used + 1
    acc = np.zeros(k, np.uint64)
    for i in range(n_used):
        acc = acc * np.uint64(0x9E6C63D0876A9A47) + words[i : i + k]
    return mix(acc + np.uint64(n_used * 0xA0761D6478BD642F & MASK64))


def lower_bytes(text: str) -> np.ndarray:
    """UTF-8 bytes with A-Z lowered."""
    return LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]


#: Ids that are sent to every executor at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in ids (one column).  Rows with a null id stay."""
    ids = hold(ids.toDF("__id").distinct())
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col] == ids["__id"], "left_anti")


def text_blocks(batch, size: int = 2 << 20):
    """(ids, texts) of an Arrow batch of (doc_id, text), in runs of about `size` characters."""
    ids, run, have = [], [], 0
    for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py()
        ids.append(doc)
        run.append(text)
        have += len(text)
        if have >= size:
            yield ids, run
            ids, run, have = [], [], 0
    if ids:
        yield ids, run
