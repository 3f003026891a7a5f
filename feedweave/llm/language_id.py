"""Language identification by Bayesian evidence fusion.

Evidence on a document's language, all of it estimated from the whole table:

* text: a multinomial over hashed byte trigrams for each declared language (counts over all documents, smoothed with
  the counts of all languages together).  Neighbouring trigrams are not independent, so the log-likelihood counts as
  that of at most ``EFFECTIVE`` of them;
* declared markup language: P(declared | language), from the table of declarations against what the texts say;
* address suffix: P(suffix | language), likewise;
* host: a prior smoothed hierarchically, global to domain to host, each level a Dirichlet prior for the next; a
  document's own vote is taken out of its host's and domain's counts.

The posterior adds them up over the languages and "none of them": trigrams drawn uniformly from the buckets, with prior
``UNKNOWN`` and the declarations and suffixes of all texts together.  A document is rejected if its text has no trigram or
no language reaches ``ACCEPT``.

Languages are those declared on texts of ``LEAST_CHARS`` characters or more altogether, as much as the smoothing weighs,
however small their share (all declared ones with text, where none has as much); the trigram model has BUCKETS rows and is
sent to the executors, 4 bytes for each bucket and language.  Host statistics are joined, broadcast only if few.

Defined results: a null or empty text has no text evidence and is rejected; a null declaration, suffix or host gives no
evidence; ties go to the language first in order of code; repeated rows are identified once each; an empty table gives
an empty table, and one without any declaration no language and no rejection but of blank texts; other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedweave.llm.common import cut, heavy_map, hold, table, without

BUCKETS = 1 << 16
EFFECTIVE = 40.0
LEAST_CHARS = 1000
ACCEPT, UNKNOWN = 0.5, 0.01
SMOOTH, STRENGTH = 0.5, 8.0
BROADCAST_HOSTS = 100_000


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, one space before and after it."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    if len(data) < 3 or not text.strip():
        return np.empty(0, np.uint32)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def evidence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host: Column | str | None = "source") -> DataFrame:
    """doc_id, text, declared, host, domain, suffix of each row."""
    name = F.lower(F.col(host) if isinstance(host, str) else host if host is not None else F.lit(None).cast("string"))
    parts = F.split(name, "[.]")
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        (F.lower(F.substring_index(F.col(declared_col).cast("string"), "-", 1)) if declared_col else F.lit(None).cast("string")).alias("declared"),
        name.alias("host"),
        F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".").alias("domain"),
        F.when(F.size(parts) > 1, F.element_at(parts, -1)).alias("suffix"),
    )


def languages(rows: DataFrame) -> list[str]:
    sizes = {r["declared"]: r["n"] for r in rows.where("declared <> ''").groupBy("declared").agg(F.sum(F.length(F.trim("text"))).alias("n")).where("n > 0").collect()}
    return sorted(x for x, n in sizes.items() if n >= LEAST_CHARS) or sorted(sizes)


def text_model(rows: DataFrame, langs: list[str]) -> np.ndarray:
    """log P(trigram bucket | language), BUCKETS x languages, from all rows that declare one of them."""
    number = {lang: i for i, lang in enumerate(langs)}

    def run(batches):
        counts = np.zeros((len(langs), BUCKETS), np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts[number[lang]] += np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
        for i in range(len(langs)):
            at = np.flatnonzero(counts[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i), pa.int32()), pa.array(at, pa.int32()), pa.array(counts[i][at], pa.int64())], ["i", "bucket", "n"])

    part = heavy_map(rows.where(F.col("declared").isin(langs)).select("declared", "text"), run, "i int, bucket int, n bigint")
    found = part.groupBy("i", "bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows for each language
    counts = np.zeros((BUCKETS, len(langs)))
    counts[found["bucket"].to_numpy(), found["i"].to_numpy()] = found["n"].to_numpy()
    pooled = counts.sum(axis=1, keepdims=True)
    pooled = (pooled + 0.01) / (pooled.sum() + 0.01 * BUCKETS)
    return np.log((counts + 1000 * pooled) / (counts.sum(axis=0) + 1000)).astype(np.float32)


def likelihoods(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, declared, host, domain, suffix, n_trigrams, ll (tempered log-likelihood of each language)."""

    def run(batches):
        for batch in batches:
            n, ll = [], []
            for text in batch.column("text"):
                t = trigrams(text.as_py())
                total = np.zeros(model.shape[1])
                for at in range(0, len(t), 1 << 18):
                    total += model[t[at : at + (1 << 18)]].sum(axis=0, dtype=np.float64)
                n.append(len(t))
                ll.append(total * min(1.0, EFFECTIVE / max(1, len(t))))
            flat = pa.array(np.concatenate(ll), pa.float64()) if ll else pa.array([], pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * model.shape[1], pa.int32()), flat)
            names = ["doc_id", "declared", "host", "domain", "suffix"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), lists], [*names, "n_trigrams", "ll"])

    return heavy_map(rows, run, "doc_id bigint, declared string, host string, domain string, suffix string, n_trigrams bigint, ll array<double>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host: Column | str | None = "source") -> DataFrame:
    """One row per input row: doc_id, language, probability, accepted, text_language, n_trigrams."""
    rows = evidence(docs, id_col, text_col, declared_col, host)
    langs = languages(rows)
    if not langs:
        return rows.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), (F.trim("text") != "").alias("accepted"), F.lit(None).cast("string").alias("text_language"), F.lit(0).cast("bigint").alias("n_trigrams"))
    size = len(langs)
    says = cut(likelihoods(rows, text_model(rows, langs)).withColumn("says", F.expr("if(n_trigrams = 0, -1, cast(array_position(ll, array_max(ll)) - 1 as int))")))
    sure = says.where("says >= 0")

    def votes(key: str) -> DataFrame:
        """key, n: array of the counts of each language among the documents of a key."""
        counts = [F.sum((F.col("says") == i).cast("double")) for i in range(size)]
        return sure.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*counts).alias(f"{key}_n"))

    total = [float(x) for x in (sure.agg(F.array(*[F.coalesce(F.sum((F.col("says") == i).cast("double")), F.lit(0.0)) for i in range(size)])).first()[0])]
    glob = F.array(*[F.lit((x + 1) / (sum(total) + size)) for x in total])

    out = says
    for key in ("domain", "host"):
        stats = hold(votes(key))
        small = stats.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
        out = out.join(F.broadcast(stats) if small else stats, key, "left")
    for key in ("declared", "suffix"):  # bounded: declared languages in use, and suffixes; the same check holds
        stats = hold(votes(key))
        small = stats.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
        out = out.join(F.broadcast(stats) if small else stats, key, "left")

    own = lambda key, i: F.coalesce(F.col(f"{key}_n")[i], F.lit(0.0)) - F.when(F.col(f"{key}_n").isNotNull() & (F.col("says") == i), 1.0).otherwise(0.0)
    for key in ("domain", "host"):
        out = out.withColumn(f"{key}_s", F.coalesce(F.aggregate(f"{key}_n", F.lit(0.0), lambda acc, x: acc + x) - F.when(F.col("says") >= 0, 1.0).otherwise(0.0), F.lit(0.0)))
    out = out.withColumn("p_domain", F.array(*[(own("domain", i) + STRENGTH * glob[i]) / (F.col("domain_s") + STRENGTH) for i in range(size)]))
    out = out.withColumn("p_host", F.array(*[(own("host", i) + STRENGTH * F.col("p_domain")[i]) / (F.col("host_s") + STRENGTH) for i in range(size)]))

    def given(key: str, i: int) -> Column:
        """log P(key's value | language i), smoothed; nothing where the value is null or was never seen with a text."""
        share = (F.col(f"{key}_n")[i] + SMOOTH) / F.lit(total[i] + SMOOTH * 2 * size)
        return F.when(F.col(f"{key}_n").isNull(), 0.0).otherwise(F.log(share))

    score = F.array(*[F.col("ll")[i] + F.log(F.col("p_host")[i]) + given("declared", i) + given("suffix", i) for i in range(size)])
    out = out.withColumn("score", score).withColumn("top", F.array_max("score"))

    def overall(key: str) -> Column:
        """log P(key's value), smoothed as given() is, whatever the language."""
        return F.coalesce(F.log((F.aggregate(f"{key}_n", F.lit(0.0), lambda acc, x: acc + x) + SMOOTH) / F.lit(sum(total) + SMOOTH * 2 * size)), F.lit(0.0))

    none = -float(np.log(BUCKETS)) * F.least(F.col("n_trigrams"), F.lit(EFFECTIVE)) + float(np.log(UNKNOWN)) + overall("declared") + overall("suffix")
    odds = F.exp(F.least(none - F.col("top"), F.lit(700.0)))
    out = out.withColumn("p", 1 / (odds + F.aggregate("score", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top")))))
    names = F.array(*[F.lit(x) for x in langs])
    return out.select(
        "doc_id",
        names[(F.array_position("score", F.col("top")) - 1).cast("int")].alias("language"),
        F.col("p").alias("probability"),
        ((F.col("n_trigrams") > 0) & (F.col("p") >= ACCEPT)).alias("accepted"),
        F.when(F.col("says") >= 0, names[F.greatest("says", F.lit(0))]).alias("text_language"),
        "n_trigrams",
    )


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host: str | None = "source") -> DataFrame:
    """The rows of docs that are not rejected."""
    return without(docs, identify(docs, id_col, text_col, declared_col, host).where("not accepted").select("doc_id"), id_col)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op6_language_id": op6_language_id}
ORACLE_SQL: dict[str, str] = {}
