"""Record linkage in the other engine's SQL, written out by hand: what the scoring queries of the catalogue are compared with.

The parts stand in for episodes of shows (their brands): short titles, some with a part number or one word more, ids that
collide, descriptions and dates that may be missing.
"""

from __future__ import annotations

#: Columns of an episode in terms of a part, understood by both engines.
EPISODE = {
    "show": "p_brand",
    "idx": "p_partkey",
    "id": "CASE WHEN p_partkey % 5 = 0 THEN concat('id', p_size) ELSE '' END",
    "title": "concat(p_name, CASE WHEN p_name LIKE 'red%' AND p_size % 3 = 0 THEN ' part 1' WHEN p_name LIKE 'red%' AND p_size % 3 = 1 THEN ' part 2' WHEN p_name LIKE 'blue%' AND p_size % 2 = 0 THEN ' deluxe' ELSE '' END)",
    "description": "CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(lower(p_type), ' item') END",
    "content": "concat('https://e/', p_partkey)",
    "image": "CASE WHEN p_partkey % 2 = 1 THEN 'https://cdn/hq.jpg' WHEN p_partkey % 4 = 0 THEN 'https://i.ytimg.com/vi/x/maxresdefault.jpg' END",
    "hours": "CASE WHEN p_size % 4 <> 0 THEN p_size * 13 END",
    "side": "p_partkey % 2",
}

# Fixed values.
_STOP = "'the a an and of with from for to in on at by episode part listener tales podcast mini special guest guests bonus volume vol'"
_MONTHS = "'january february march april may june july august september october november december'"

_BASE = f"""WITH RECURSIVE
e AS MATERIALIZED (SELECT {', '.join(f'{sql} AS "{c}"' for c, sql in EPISODE.items())} FROM part),
r AS (SELECT * FROM e WHERE side = 0), d AS (SELECT * FROM e WHERE side = 1),
strings AS MATERIALIZED (
  SELECT DISTINCT r.title AS a, d.title AS b FROM r JOIN d ON r."show" = d."show"
  UNION SELECT DISTINCT r.description, d.description FROM r JOIN d ON r."show" = d."show" WHERE r.description <> '' AND d.description <> ''),
tok AS MATERIALIZED (SELECT a, b, array_to_string(list_sort(string_split(a, ' ')), ' ') AS sa, array_to_string(list_sort(string_split(b, ' ')), ' ') AS sb,
  array_to_string(list_sort(list_filter(list_distinct(string_split(a, ' ')), lambda w: NOT list_contains(string_split(b, ' '), w))), ' ') AS da,
  array_to_string(list_sort(list_filter(list_distinct(string_split(b, ' ')), lambda w: NOT list_contains(string_split(a, ' '), w))), ' ') AS db,
  length(array_to_string(list_filter(list_distinct(string_split(a, ' ')), lambda w: list_contains(string_split(b, ' '), w)), ' ')) AS s FROM strings),
q AS MATERIALIZED (SELECT DISTINCT x, y FROM (SELECT a AS x, b AS y FROM tok UNION ALL SELECT sa, sb FROM tok UNION ALL SELECT da, db FROM tok)),
dp AS (
  SELECT x, y, 0 AS i, list_transform(range(0, length(y) + 1), lambda k: 0) AS cells FROM q
  UNION ALL
  SELECT x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda acc, j: list_append(acc,
    CASE WHEN substring(x, i + 1, 1) = substring(y, CAST(j AS BIGINT), 1) THEN cells[j] + 1 ELSE greatest(cells[j + 1], acc[j]) END), [0])
  FROM dp WHERE i < length(x)),
lcs AS MATERIALIZED (SELECT x, y, cells[length(y) + 1] AS l FROM dp WHERE i = length(x)),
parts AS (SELECT a, b, 2.0::DOUBLE * l0.l / (length(a) + length(b)) AS ratio, 2.0::DOUBLE * l1.l / (length(sa) + length(sb)) AS sorted,
  CASE WHEN s > 0 AND (da = '' OR db = '') THEN 1.0::DOUBLE
       WHEN s > 0 THEN greatest(2.0::DOUBLE * (s + 1 + l2.l) / (2 * s + 2 + length(da) + length(db)), 2.0::DOUBLE * s / (2 * s + 1 + length(da)), 2.0::DOUBLE * s / (2 * s + 1 + length(db)))
       ELSE 2.0::DOUBLE * l2.l / (length(da) + length(db)) END AS sets,
  s, length(da) AS p, length(db) AS q, (da <> '')::INT AS gp, (db <> '')::INT AS gq, l2.l AS l2
  FROM tok JOIN lcs l0 ON l0.x = a AND l0.y = b JOIN lcs l1 ON l1.x = sa AND l1.y = sb JOIN lcs l2 ON l2.x = da AND l2.y = db),
sim AS MATERIALIZED (SELECT a, b, 0.4::DOUBLE * ratio + 0.3::DOUBLE * sorted + 0.3::DOUBLE * sets AS legacy,
  0.4::DOUBLE * ratio + 0.3::DOUBLE * sorted + 0.3::DOUBLE * greatest(
    CASE WHEN 2 * s + gp + p + gq + q = 0 THEN 1.0 ELSE 2.0::DOUBLE * (s + least(gp, gq) + l2) / (2 * s + gp + p + gq + q) END,
    CASE WHEN 2 * s + gp + p = 0 THEN 1.0 ELSE 2.0::DOUBLE * s / (2 * s + gp + p) END, CASE WHEN 2 * s + gq + q = 0 THEN 1.0 ELSE 2.0::DOUBLE * s / (2 * s + gq + q) END) AS kernel FROM parts),
anchored AS (SELECT *, regexp_extract(title, 'part ([0-9]+)', 1) AS marker,
  list_filter(list_distinct(string_split(title, ' ')), lambda w: NOT list_contains(string_split({_STOP}, ' '), w)) AS anchors FROM e),
met AS (SELECT r."show", r.idx AS ref_idx, d.idx AS dl_idx, t.legacy AS t_legacy, t.kernel AS t_kernel, coalesce(x.legacy, 0) AS d_legacy, coalesce(x.kernel, 0) AS d_kernel,
  r.id <> '' AND r.id = d.id AS same, r.description <> '' AND d.description <> '' AS has_desc, r.hours IS NOT NULL AND d.hours IS NOT NULL AS has_date, (r.hours - d.hours) / 24.0::DOUBLE AS days,
  r.marker <> '' AND d.marker <> '' AND r.marker <> d.marker AS other_part, r.anchors AS x, d.anchors AS y,
  list_filter(r.anchors, lambda w: list_contains(d.anchors, w)) AS shared,
  list_filter(r.anchors, lambda w: NOT list_contains(d.anchors, w)) AS only_x, list_filter(d.anchors, lambda w: NOT list_contains(r.anchors, w)) AS only_y
  FROM anchored r JOIN anchored d ON r."show" = d."show" AND r.side = 0 AND d.side = 1 JOIN sim t ON t.a = r.title AND t.b = d.title
  LEFT JOIN sim x ON x.a = r.description AND x.b = d.description AND r.description <> '' AND d.description <> ''),
judged AS (SELECT *, CASE WHEN len(only_x) = 0 THEN only_y WHEN len(only_y) = 0 THEN only_x END AS extra,
  len(shared) = least(len(x), len(y)) AND least(len(x), len(y)) >= 2 AS contained,
  len(list_filter(shared, lambda w: ((regexp_matches(w, '[0-9]') AND length(w) >= 2) OR (regexp_matches(w, '[A-Za-z]') AND length(w) >= 4)) AND NOT list_contains(string_split({_MONTHS}, ' '), w))) > 0 AS telling FROM met),
rated AS (SELECT *, len(extra) = 1 AND regexp_matches(extra[1], '[A-Za-z]') AND NOT list_contains(string_split({_MONTHS}, ' '), extra[1]) AS one_extra FROM judged)"""


def _score(kernel: bool) -> str:
    t, d = ("t_kernel", "d_kernel") if kernel else ("t_legacy", "d_legacy")
    days = "floor(abs(days))" if kernel else "abs(floor(days))"
    date = f"CASE WHEN {days} <= 2 THEN 1.0::DOUBLE WHEN {days} <= 10 THEN 0.7::DOUBLE WHEN {days} <= 35 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END"
    use = f"({t} < 0.97 AND has_date)"
    base = f"""(0.5::DOUBLE * {t} + CASE WHEN has_desc THEN 0.1::DOUBLE * {d} ELSE 0.0::DOUBLE END + CASE WHEN {use} THEN 0.3::DOUBLE * {date} ELSE 0.0::DOUBLE END)
      / (0.5::DOUBLE + CASE WHEN has_desc THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN {use} THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END)"""
    overlap = "" if kernel else f"WHEN {t} < 0.97 AND telling THEN 0.03::DOUBLE"
    bonus = f"CASE WHEN {t} < 0.97 AND contained THEN 0.08::DOUBLE {overlap} ELSE 0.0::DOUBLE END"
    free = "" if kernel else "NOT same AND "
    total = f"{base} + {bonus}" if kernel else f"{base} + {bonus} + CASE WHEN same THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END"
    return f"""CASE {'WHEN same THEN 1.0::DOUBLE' if kernel else ''} WHEN other_part THEN 0.0::DOUBLE WHEN len(shared) = 0 AND {t} < 0.75 THEN 0.0::DOUBLE
      WHEN {t} < 0.97 AND {free}NOT has_desc AND {t} < 0.85 THEN 0.0::DOUBLE WHEN {t} < 0.97 AND {free}has_desc AND has_date AND coalesce(one_extra, false) AND {t} >= 0.78 THEN 0.0::DOUBLE
      ELSE least(1.0::DOUBLE, {total}) END"""


def scored(kernel: bool = False) -> str:
    return f'{_BASE},\nscored AS MATERIALIZED (SELECT * FROM (SELECT "show", ref_idx, dl_idx, {_score(kernel)} AS score FROM rated) WHERE score > 0)'


def assigned(scores: str = "scored") -> str:
    """pairs: the greedy assignment, one pair after the other inside each show."""
    taken = "list_contains(refs, o.ref_idx) OR list_contains(dls, o.dl_idx)"
    return f"""o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY "show" ORDER BY score DESC, ref_idx, dl_idx) AS k FROM {scores} WHERE score >= 0.75),
g AS (SELECT "show", 0::BIGINT AS k, []::BIGINT[] AS refs, []::BIGINT[] AS dls, NULL::BIGINT AS ref_idx, NULL::BIGINT AS dl_idx, NULL::DOUBLE AS score FROM (SELECT DISTINCT "show" FROM o)
  UNION ALL
  SELECT g."show", o.k, CASE WHEN {taken} THEN refs ELSE list_append(refs, o.ref_idx) END, CASE WHEN {taken} THEN dls ELSE list_append(dls, o.dl_idx) END,
    CASE WHEN {taken} THEN NULL ELSE o.ref_idx END, o.dl_idx, o.score FROM g JOIN o ON o."show" = g."show" AND o.k = g.k + 1),
pairs AS MATERIALIZED (SELECT "show", ref_idx, dl_idx, score, row_number() OVER (PARTITION BY "show" ORDER BY k) AS rank FROM g WHERE ref_idx IS NOT NULL)"""


FUSED = """fused AS (SELECT p."show", p.rank, p.ref_idx, p.dl_idx, p.score, b.id,
  CASE WHEN length(b.title) > length(a.title) THEN b.title ELSE a.title END AS title,
  CASE WHEN length(b.description) > length(a.description) THEN b.description ELSE a.description END AS description,
  [least(a.content, b.content), greatest(a.content, b.content)] AS source, coalesce(a.image, b.image) AS thumbnail,
  least(a.hours, b.hours) AS hours FROM pairs p JOIN e a ON a.idx = p.ref_idx JOIN e b ON b.idx = p.dl_idx)"""

PAIR_SCORES = {k: scored(k == "kernel") + ' SELECT "show", ref_idx, dl_idx, round(score, 6) AS score FROM scored' for k in ("legacy", "kernel")}
ALIGNMENT = f"{scored()},\n{assigned()} SELECT \"show\", ref_idx, dl_idx, round(score, 6) AS score, rank FROM pairs"
FOLD = f"""{scored()},\n{assigned()} SELECT "show", row_number() OVER (PARTITION BY "show" ORDER BY side, idx) - 1 AS idx, id, title
FROM e WHERE side = 0 OR idx NOT IN (SELECT dl_idx FROM pairs)"""
EPISODES = f"""{scored()},\n{assigned()},\n{FUSED} SELECT "show", rank, ref_idx, dl_idx, round(score, 6) AS score, id, title, description, array_to_string(source, ',') AS source, thumbnail,
CASE WHEN hours IS NOT NULL THEN 1704067200 + hours * 3600 END AS upload_seconds FROM fused"""
FILES = f"""{_BASE}, named AS (SELECT r."show", r.idx AS ref_idx, d.idx AS dl_idx, legacy AS score FROM r JOIN d ON r."show" = d."show" JOIN sim ON sim.a = r.title AND sim.b = d.title),
{assigned("named")} SELECT "show", ref_idx, dl_idx, round(score, 6) AS score, rank FROM pairs"""
PLAN = f"""{scored()},\n{assigned()},\n{FUSED}, todo AS (SELECT "show", dl_idx AS idx, title, hours FROM fused
  WHERE replace(title, ' ', '-') NOT IN (SELECT replace(title, ' ', '-') FROM e WHERE side = 1 AND idx % 3 = 0) AND source[-1] NOT IN (SELECT content FROM e WHERE side = 1 AND idx % 3 = 0))
SELECT "show", idx, title, row_number() OVER (ORDER BY "show", hours DESC NULLS LAST, title, idx) AS place FROM todo QUALIFY place <= 1000"""
EXACT = f"""{_BASE} SELECT DISTINCT r."show", r.idx AS ref_idx, d.idx AS dl_idx, 1.0::DOUBLE AS score FROM r JOIN d ON r."show" = d."show" AND (r.title = d.title OR (r.id <> '' AND r.id = d.id))"""
