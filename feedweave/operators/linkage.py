"""Scoring of (reference, download) pairs: features of each row, the score of given pairs, and of all pairs of all shows.

Rows are normalised once, before any pair is made.  ``score`` is the definition, column expressions over explicit pairs;
``align_scores`` gives the same result for all pairs of every show through blocks (operators.blocks), or equi-joins where only
equal ids and titles count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedweave.config import CERTAINTY, CONTAINMENT_BONUS, MONTHS, OVERLAP_BONUS, RESCUE, WEAK_ANCHOR, Alignment
from feedweave.functions import scalars, similarity, text
from feedweave.functions.text import TitleRules
from feedweave.operators import alike, blocks
from feedweave.operators.upsert import cut

#: Numbers that must agree, in order.
MARKERS = (r"\blistener\s+tales(?:\s+episode)?\s+(\d+)\b", r"\bpart\s+(\d+)\b", r"\b(?:volume|vol\.?)\s*(\d+)\b", r"\bepisode\s+(\d+)\b")
SEMANTICS = ("legacy", "kernel", "token_ratio", "exact")


def normalised(show: str, title: str, rules: dict[str, TitleRules]) -> Column:
    """The scoring form of a title; show-specific rules by exact name, no show ('') without slugging."""
    alike: dict[TitleRules, list[str]] = {}
    for name, r in sorted(rules.items()):
        alike.setdefault(r, []).append(text.SPARK.text(name))
    known = " ".join(f"when {show} in ({', '.join(names)}) then {text.alignment_title(title, r)}" for r, names in alike.items())
    return F.expr(f"case {known} when coalesce({show}, '') = '' then {text.alignment_title(title)} else {text.alignment_title(title, TitleRules())} end")


def features(episodes: DataFrame, alignment: Alignment | dict[str, Alignment] = Alignment(), rules: dict[str, TitleRules] | None = None) -> DataFrame:
    """show, idx, id, title_n, desc_n, pub_date, anchors, markers of rows (show, idx, id, title, description, pub_date)."""
    out = episodes.select(
        "show", "idx", F.coalesce("id", F.lit("")).alias("id"), "pub_date",
        normalised("show", "coalesce(title, '')", rules or {}).alias("title_n"),
        F.expr(text.normalize_text("coalesce(description, '')")).alias("desc_n"),
    )
    return with_tokens(out, by_show(alignment, lambda x: F.array(*[F.lit(w) for w in x.stopwords])))


def by_show(alignment: Alignment | dict[str, Alignment], value, show: str = "show") -> Column:
    """value(alignment) of each row's show; shows that a dict lacks have the default alignment's."""
    if isinstance(alignment, Alignment):
        return value(alignment)
    alike: dict[Alignment, list[str]] = {}
    for name, x in sorted(alignment.items()):
        alike.setdefault(x, []).append(name)
    out = value(Alignment())
    for x, names in alike.items():
        out = F.when(F.col(show).isin(names), value(x)).otherwise(out)
    return out


def with_tokens(df: DataFrame, stopwords: tuple[str, ...] | Column) -> DataFrame:
    stop = stopwords if isinstance(stopwords, Column) else F.array(*[F.lit(w) for w in stopwords])
    words = F.filter(F.split("title_n", r"\s+"), lambda t: t != "")
    marks = [F.expr(f"try_cast(nullif(regexp_extract(title_n, {text.SPARK.text(p)}, 1), '') as decimal(38,0))") for p in MARKERS]
    return df.withColumns({"anchors": F.array_except(F.array_distinct(words), stop), "markers": F.array(*marks)})


def sides(df: DataFrame, prefix: str, keep: tuple[str, ...] = ("show",)) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(f"{prefix}_{c}") for c in df.columns if c not in keep])


def all_pairs(refs: DataFrame, dls: DataFrame) -> DataFrame:
    """Every pair of a show, with the features of both sides; what score() takes."""
    return sides(refs, "a").join(sides(dls, "b"), "show")


def equal_pairs(refs: DataFrame, dls: DataFrame) -> DataFrame:
    """show, ref_idx, dl_idx, score 1 of the pairs with equal ids or titles, by two equi-joins."""
    keyed = lambda df, side, key: df.where(F.col(key) != "").select("show", F.col("idx").alias(side), key)
    found = [keyed(refs, "ref_idx", key).join(keyed(dls, "dl_idx", key), ["show", key]).select("show", "ref_idx", "dl_idx") for key in ("id", "title_n")]
    return found[0].union(found[1]).distinct().withColumn("score", F.lit(1.0))


def _overlap() -> Column:
    return F.array_intersect("a_anchors", "b_anchors")


def containment() -> Column:
    """The smaller anchor set, of two tokens or more, lies in the larger."""
    a, b = F.size("a_anchors"), F.size("b_anchors")
    inside = F.size(_overlap()) == F.least(a, b)
    return (F.least(a, b) >= 2) & inside


def subset_extra() -> Column:
    """Tokens that one set has beyond the other, where one lies in the other; null otherwise."""
    a_b, b_a = F.array_except("a_anchors", "b_anchors"), F.array_except("b_anchors", "a_anchors")
    either = (F.size("a_anchors") > 0) & (F.size("b_anchors") > 0)
    return F.when(either & (F.size(a_b) == 0), b_a).when(either & (F.size(b_a) == 0), a_b)


def discriminating_extra(tokens: Column) -> Column:
    months = F.array(*[F.lit(m) for m in MONTHS])
    return F.exists(tokens, lambda t: t.rlike("[A-Za-z]") & ~F.array_contains(months, t))


def discriminating_overlap(tokens: Column) -> Column:
    months = F.array(*[F.lit(m) for m in MONTHS])
    return F.exists(tokens, lambda t: ((t.rlike("[0-9]") & (F.length(t) >= 2)) | (t.rlike("[A-Za-z]") & (F.length(t) >= 4))) & ~F.array_contains(months, t))


def marker_mismatch() -> Column:
    return F.exists(F.zip_with("a_markers", "b_markers", lambda x, y: F.coalesce(x != y, F.lit(False))), lambda x: x)


def score(pairs: DataFrame, alignment: Alignment = Alignment(), semantics: str = "legacy") -> DataFrame:
    """show, ref_idx, dl_idx, score of candidate pairs.

    legacy: equal ids add a bonus after all rejects; kernel: equal ids score 1 at once, days are truncated, no overlap
    bonus; token_ratio: 0.8 title + 0.1 description + 0.1 id; exact: 1 for equal ids or titles, else 0.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"unknown semantics {semantics!r}; one of {', '.join(SEMANTICS)}")
    out = ["show", F.col("a_idx").alias("ref_idx"), F.col("b_idx").alias("dl_idx")]
    same = (F.col("a_id") != "") & (F.col("a_id") == F.col("b_id"))
    if semantics == "exact":
        equal = same | ((F.col("a_title_n") != "") & (F.col("a_title_n") == F.col("b_title_n")))
        return pairs.select(*out, F.when(equal, 1.0).otherwise(0.0).alias("score"))
    if semantics == "token_ratio":
        both = pairs.withColumns({"t": similarity.token_ratio("a_title_n", "b_title_n"), "d": similarity.token_ratio("a_desc_n", "b_desc_n")})
        return both.select(*out, F.least(F.lit(1.0), 0.8 * F.col("t") + 0.1 * F.col("d") + F.when(same, 0.1).otherwise(0.0)).alias("score"))

    kernel = semantics == "kernel"
    w = alignment.weights
    compare = similarity.kernel_similarity if kernel else similarity.similarity
    rows = pairs.withColumns({
        "same": same,
        "has_desc": (F.col("a_desc_n") != "") & (F.col("b_desc_n") != ""),
        "has_date": F.col("a_pub_date").isNotNull() & F.col("b_pub_date").isNotNull(),
        "t": compare("a_title_n", "b_title_n"),
        "overlap": _overlap(),
        "extra": subset_extra(),
    })
    sure = F.col("t") >= CERTAINTY
    weak = (F.size("overlap") == 0) & (F.col("t") < WEAK_ANCHOR)
    no_id = F.lit(True) if kernel else ~F.col("same")
    sparse = ~sure & no_id & ~F.col("has_desc") & (F.col("t") < alignment.sparse_title_min)
    rescue = ~sure & no_id & F.col("has_desc") & F.col("has_date") & F.coalesce(F.size("extra") == 1, F.lit(False)) & F.coalesce(discriminating_extra(F.col("extra")), F.lit(False)) & (F.col("t") >= RESCUE)
    reject = marker_mismatch() | weak | sparse | rescue
    if kernel:
        reject = reject & ~F.col("same")
    rows = rows.withColumn("reject", reject)
    kept = rows.where(~F.col("reject")).withColumn("d", compare("a_desc_n", "b_desc_n"))
    date = F.expr(scalars.date_similarity("a_pub_date", "b_pub_date", tiers=alignment.date_score_tiers, truncate=kernel))
    use_date = ~sure & F.col("has_date")
    desc = F.when(F.col("has_desc"), w.description * F.col("d")).otherwise(0.0)
    desc_weight = F.when(F.col("has_desc"), w.description).otherwise(0.0)
    base = (w.title * F.col("t") + desc + F.when(use_date, w.date * date).otherwise(0.0)) / (w.title + desc_weight + F.when(use_date, w.date).otherwise(0.0))
    bonus = F.when(~sure & containment(), CONTAINMENT_BONUS)
    if not kernel:
        bonus = bonus.when(~sure & discriminating_overlap(F.col("overlap")), OVERLAP_BONUS)
    total = base + bonus.otherwise(0.0)
    if kernel:
        final = F.when(F.col("same"), 1.0).otherwise(F.least(F.lit(1.0), total))
    else:
        final = F.least(F.lit(1.0), total + F.when(F.col("same"), w.id).otherwise(0.0))
    return kept.select(*out, final.alias("score"))


#: What a score reads of a row.
READ = ["id", "title", "description", "pub_date"]


def align_classes(refs: DataFrame, dls: DataFrame, alignment: Alignment | dict[str, Alignment] = Alignment(), rules: dict[str, TitleRules] | None = None, semantics: str = "legacy", least: float | None = 0.0) -> alike.Scored:
    """Scores above zero, and at least `least` (None: the show's tolerance), of the classes of two sets of rows.

    Rows that are equal in READ are one class: normalised once and scored once.  Features are materialised, because blocks
    read them several times.
    """
    if semantics not in SEMANTICS:
        raise ValueError(f"unknown semantics {semantics!r}; one of {', '.join(SEMANTICS)}")
    of_refs, of_dls = alike.classes(refs, READ), alike.classes(dls, READ)
    a, b = cut(features(of_refs.rows, alignment, rules)), cut(features(of_dls.rows, alignment, rules))
    found = equal_pairs(a, b) if semantics == "exact" else blocks.scores(a, b, alignment, semantics, least)
    return alike.Scored(cut(found), of_refs.members, of_dls.members)


def align_scores(refs: DataFrame, dls: DataFrame, alignment: Alignment | dict[str, Alignment] = Alignment(), rules: dict[str, TitleRules] | None = None, semantics: str = "legacy", least: float | None = 0.0) -> DataFrame:
    """Scores above zero, and at least `least` (None: the show's tolerance), of all pairs of two sets of rows (show, idx, id, title, description, pub_date)."""
    return align_classes(refs, dls, alignment, rules, semantics, least).pairs()
