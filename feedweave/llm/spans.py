"""Regular-expression spans as Spark SQL expressions: positions in code points, without Python on the executors."""

from __future__ import annotations

#: Start, end, kind, text, what precedes (up to BEFORE characters, back to the previous match) and the character that follows.
SPAN = "struct<s:int,e:int,k:string,v:string,b:string,a:string>"
BEFORE = 32
NONE = f"cast(array() as array<{SPAN}>)"
#: Elements that one step of a fold copies at most; keeps folds over long arrays close to linear.
BLOCK = 256


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fold(items: str, kind: str, at: str, emit: str) -> str:
    """Left fold over an array that carries a position: x is an item, acc.at the position so far.

    `at` is the position after x and `emit` the array (of `kind`) that x adds to the result.  Results are gathered in
    blocks, and the blocks joined once, so a text with n matches costs n * BLOCK copies and not n * n.
    """
    step = f"(acc, x) -> named_struct('at', {at}, 'out', concat(acc.out, {emit}))"
    inner = f"aggregate(slice(z, i * {BLOCK} + 1, {BLOCK}), named_struct('at', whole.at, 'out', cast(array() as array<{kind}>)), {step})"
    outer = f"(whole, i) -> element_at(transform(array({inner}), r -> named_struct('at', r.at, 'out', array_append(whole.out, r.out))), 1)"
    blocks = f"aggregate(sequence(0, greatest(size(z) - 1, 0) div {BLOCK}), named_struct('at', 0, 'out', cast(array() as array<array<{kind}>>)), {outer}, whole -> flatten(whole.out))"
    return f"element_at(transform(array({items}), z -> {blocks}), 1)"


def matches(text: str, pattern: str, kind: str, when: str = "true") -> str:
    """Leftmost non-overlapping matches of a pattern, as array<SPAN>, computed only where `when` holds.

    split() gives the text between the matches and regexp_extract_all() the matches; their lengths give positions.
    """
    p = literal(pattern)
    pairs = f"zip_with(gaps, regexp_extract_all({text}, {p}, 0), (g, h) -> named_struct('gap', g, 'hit', h))"
    items = f"""element_at(transform(array(split({text}, {p}, -1)), gaps -> zip_with({pairs}, slice(gaps, 2, size(gaps)),
        (y, n) -> named_struct('gap', y.gap, 'hit', y.hit, 'next', n))), 1)"""
    start, end = "acc.at + length(x.gap)", "acc.at + length(x.gap) + length(x.hit)"
    around = f"'b', right(x.gap, {BEFORE}), 'a', substring(x.next, 1, 1)"
    emit = f"if(x.hit is null, {NONE}, array(named_struct('s', {start}, 'e', {end}, 'k', '{kind}', 'v', x.hit, {around})))"
    return f"if({when}, {fold(items, SPAN, f'if(x.hit is null, acc.at, {end})', emit)}, {NONE})"


def ordered(spans: str, kinds: list[str]) -> str:
    """Spans by start, then by their kind's place in the list."""
    order = "array(" + ", ".join(f"'{k}'" for k in kinds) + ")"
    return f"""array_sort({spans}, (a, b) -> case
        when a.s <> b.s then a.s - b.s
        else cast(array_position({order}, a.k) - array_position({order}, b.k) as int) end)"""


def joined(spans: str) -> str:
    """kind:start:end of each span, comma-joined."""
    return f"array_join(transform({spans}, x -> concat(x.k, ':', x.s, ':', x.e)), ',')"


def masked(text: str, spans: str, mark: str) -> str:
    """The text with every span (they may overlap; in order of start) replaced by a mark.

    Cut from an array of characters: substring() counts from the start of the text each time.
    """
    cut = "array_join(slice(chars, acc.at + 1, x.s - acc.at), '')"
    emit = f"if(x.s >= acc.at, array({cut}, '{mark}'), cast(array() as array<string>))"
    pieces = fold(spans, "string", "greatest(acc.at, x.e)", emit)
    rest = f"array_join(slice(chars, coalesce(array_max(transform({spans}, x -> x.e)), 0) + 1, size(chars)), '')"
    return f"element_at(transform(array(split({text}, '')), chars -> concat(array_join({pieces}, ''), {rest})), 1)"
