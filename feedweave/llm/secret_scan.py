r"""Secrets in text: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Fixed kinds, leftmost non-overlapping each: assign (a password-like key with a value of 6 characters or more),
access (AKIA keys of 20 or more), hex (24 or more lower-case hexadecimal digits).

The battery looks at every run of 20 or more characters of ``[A-Za-z0-9+/_=-]``.  The smallest alphabet that holds
its symbols is its inferred encoding.  Three tests of the hypothesis "drawn uniformly from that alphabet" give
p-values that hold for short strings:

* chi-squared of the symbol counts.  It is a linear function of the number of pairs of equal symbols, which for n draws of a
  symbols is close to Poisson with mean n (n - 1) / 2a however few symbols there are to a cell; the tail is that of a gamma
  distribution (by Wilson and Hilferty), halfway between "as many" and "more", as the count is discrete;
* runs about the middle of the alphabet, and lag-one serial correlation, both normal.

Fisher's method joins them.  Random strings have uniform p-values, words have small ones, so in
each stratum (encoding, length class) the share of words among the strings with p >= t is estimated, Storey's way,
from the count above one half; the smallest t whose estimate is at most ``FALSE_SHARE`` is the stratum's threshold.
Letters of a single case need 48 symbols, decimals 40 and strings without a digit 32: below that the battery has not the
power to tell words from keys, and the control would have nothing to go by.  (English words run together that have a p-value above one
half: 10 % of 24 lower-case letters, 4 % of 32, 0.2 % of 48; with capitals 4 % of 24, 0.1 % of 32.)  Fixed kinds are
not concerned.

All of it is Spark SQL; the only rows that reach the driver are the strata's histograms (at most 11 encodings x 24
length classes x 40 bins).

Defined results: a null or empty text has no spans; repeated rows are scanned once each; an empty table gives an empty
table; only the id and text columns are read (the pipeline stage passes all others through unchanged).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.llm.common import table, texts
from feedweave.llm.spans import SPAN, joined, masked, matches, ordered

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
FALSE_SHARE = 0.05
BINS = 40

_DIGIT, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet up: name, pattern, symbols in order.
ENCODINGS = [
    ("decimal", "[0-9]+", _DIGIT),
    ("hex", "[0-9a-f]+", _DIGIT + "abcdef"),
    ("hex_upper", "[0-9A-F]+", _DIGIT + "ABCDEF"),
    ("lower", "[a-z]+", _LOWER),
    ("upper", "[A-Z]+", _UPPER),
    ("base32", "[A-Z2-7]+", _UPPER + "234567"),
    ("lower_digit", "[a-z0-9]+", _DIGIT + _LOWER),
    ("upper_digit", "[A-Z0-9]+", _DIGIT + _UPPER),
    ("letters", "[A-Za-z]+", _UPPER + _LOWER),
    ("base62", "[A-Za-z0-9]+", _UPPER + _LOWER + _DIGIT),
    ("base64", "[A-Za-z0-9+/_-]+", _UPPER + _LOWER + _DIGIT + "+/"),
]


def base_spans(text: str) -> str:
    assign = f"""filter({matches(text, ASSIGN, "assign", f"rlike({text}, '(?i:passw|secret|token|api_?key)')")},
        x -> length(regexp_extract(x.v, '{_sql(ASSIGN)}', 1)) >= 6)"""
    access = matches(text, ACCESS, "access", f"contains({text}, 'AKIA')")
    plain = matches(text, HEX, "hex", f"rlike({text}, '{HEX}')")
    return ordered(f"concat({assign}, {access}, {plain})", KINDS)


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _upper_tail(z: str) -> str:
    """P(Z >= z) of a standard normal, by its logistic approximation."""
    return f"(1 / (1 + exp(least(greatest(1.5976 * {z} + 0.070566 * pow({z}, 3), -700D), 700D))))"


def _poisson_tail(k: str, mean: str) -> str:
    """P(N >= k) of a Poisson variable: that of a gamma variable of shape k below the mean."""
    return f"(case when {k} <= 0 then 1D else {_upper_tail(f'(-((cbrt({mean} / {k}) - 1 + 1 / (9 * {k})) * 3 * sqrt({k})))')} end)"


def candidates(text: str) -> str:
    """array<struct<s, e, v, stratum, p>> of the candidate strings of a text."""
    pick = "case " + " ".join(f"when rlike(x.b, '^{p}$') then '{n}'" for n, p, _ in ENCODINGS) + " end"
    symbols = "case e.enc " + " ".join(f"when '{n}' then '{a}'" for n, _, a in ENCODINGS) + " end"
    raw = matches(text, CANDIDATE, "random", f"rlike({text}, '{CANDIDATE}')")
    step1 = f"transform({raw}, x -> named_struct('s', x.s, 'e', x.e, 'v', x.v, 'b', rtrim('=', x.v)))"
    step2 = f"transform(filter({step1}, x -> length(x.b) >= 20), x -> named_struct('s', x.s, 'e', x.e, 'v', x.v, 'b', x.b, 'enc', {pick}))"
    enough = "length(e.b) >= case when e.enc in ('lower', 'upper') then 48 when e.enc = 'decimal' then 40 when not rlike(e.b, '[0-9]') then 32 else 20 end"
    step3 = f"""transform(filter({step2}, e -> e.enc is not null and {enough}), e -> named_struct('s', e.s, 'e', e.e, 'v', e.v, 'enc', e.enc, 'n', length(e.b),
        'a', cast(length({symbols}) as double),
        'x', transform(split(e.b, ''), c -> cast(instr({symbols}, translate(c, '-_', '+/')) - 1 as double))))"""
    stats = f"""transform({step3}, t -> named_struct('s', t.s, 'e', t.e, 'v', t.v, 'enc', t.enc, 'n', t.n,
        'equal', aggregate(transform(array_distinct(t.x), d -> size(filter(t.x, y -> y = d))), 0D, (q, c) -> q + c * (c - 1) / 2),
        'mean', t.n * (t.n - 1) / (2 * t.a),
        'high', cast(size(filter(t.x, y -> y >= t.a / 2)) as double),
        'runs', 1D + aggregate(sequence(1, t.n - 1), 0, (q, i) -> q + if((t.x[i] >= t.a / 2) <> (t.x[i - 1] >= t.a / 2), 1, 0)),
        'serial', aggregate(sequence(1, t.n - 1), 0D, (q, i) -> q + (t.x[i] - (t.a - 1) / 2) * (t.x[i - 1] - (t.a - 1) / 2)) / ((t.a * t.a - 1) / 12) / sqrt(t.n - 1)))"""
    chi = f"(({_poisson_tail('t.equal', 't.mean')} + {_poisson_tail('(t.equal + 1)', 't.mean')}) / 2)"
    low = "(t.n - t.high)"
    mean = f"(1 + 2 * t.high * {low} / t.n)"
    var = f"(2 * t.high * {low} * (2 * t.high * {low} - t.n) / (t.n * t.n * (t.n - 1D)))"
    z_runs = f"if({var} > 0, abs(t.runs - {mean}) / sqrt({var}), 9D)"
    two = lambda z: f"least(1D, 2 * {_upper_tail(z)})"
    fisher = f"(-ln(greatest({chi}, 1e-300D)) - ln(greatest({two(z_runs)}, 1e-300D)) - ln(greatest({two('abs(t.serial)')}, 1e-300D)))"
    return f"""transform(transform({stats}, t -> named_struct('s', t.s, 'e', t.e, 'v', t.v, 'stratum', concat(t.enc, ':', cast(floor(log2(t.n)) as int)), 'h', {fisher})),
        t -> named_struct('s', t.s, 'e', t.e, 'v', t.v, 'stratum', t.stratum, 'p', exp(-t.h) * (1 + t.h + t.h * t.h / 2)))"""


def thresholds(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Smallest p-value that each stratum accepts; strata without evidence of random strings are absent."""
    found = docs.select(F.explode(F.expr(candidates(f"coalesce({text_col}, '')"))).alias("c"))
    bins = found.groupBy(F.col("c.stratum").alias("stratum"), F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    seen: dict[str, list[int]] = {}
    for row in bins.collect():
        seen.setdefault(row["stratum"], [0] * BINS)[row["bin"]] += row["count"]
    out = {}
    for stratum, counts in seen.items():
        random_bin = sum(counts[BINS // 2 :]) / (BINS - BINS // 2)
        for at in range(BINS):
            above = sum(counts[at:])
            if above and random_bin * (BINS - BINS // 2) >= 1 and above - random_bin * (BINS - at) <= FALSE_SHARE * above:
                out[stratum] = at / BINS
                break
    return out


def with_spans(docs: DataFrame, levels: dict[str, float], text_col: str = "text") -> DataFrame:
    """All columns of docs, and base and spans (arrays of SPAN, in order).  Spans of the battery that touch a base span are left out."""
    text = f"coalesce(`{text_col}`, '')"
    out = docs.withColumn("__base", F.expr(base_spans(text)))
    if levels:
        accept = "map(" + ", ".join(f"'{k}', {v}D" for k, v in sorted(levels.items())) + ")"
        extra = f"""transform(filter({candidates(text)}, c -> c.p >= coalesce(try_element_at({accept}, c.stratum), 2D)
            and not exists(__base, b -> b.s < c.e and c.s < b.e)), c -> cast(named_struct('s', c.s, 'e', c.e, 'k', 'random', 'v', c.v, 'b', '', 'a', '') as {SPAN}))"""
        return out.withColumn("__spans", F.expr(ordered(f"concat(__base, {extra})", KINDS)))
    return out.withColumn("__spans", F.col("__base"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, spans for each document."""
    docs = texts(docs, id_col, text_col)
    return with_spans(docs, thresholds(docs)).select("doc_id", F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret replaced by a mark."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).cast("string").alias("text"))
    found = with_spans(whole, thresholds(whole))
    new = F.expr(f"if(size(__spans) = 0, text, {masked('text', '__spans', mark)})")
    return found.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.expr(f"cast(size(filter(base, x -> x.k = '{kind}')) as bigint)").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"),
    )


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE_SQL: dict[str, str] = {}
