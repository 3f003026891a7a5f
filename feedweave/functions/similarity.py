"""Fuzzy similarity of strings: normalised LCS ratios, vectorised over Arrow batches.

The longest common subsequences of a whole batch are found together: bit-parallel rows (one bit for each character of the
first string) held in numpy words, one step for each character position of the second strings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

BLEND = (0.4, 0.3, 0.3)
_BATCH = 4096
#: Characters of the longer string from which whole numbers beat rows of words.
_LONG = 400


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair; pairs that repeat are compared once."""
    number: dict[tuple[str, str], int] = {}
    back = np.fromiter((number.setdefault(p, len(number)) for p in zip(a, b, strict=True)), np.int64, len(a))
    pairs = list(number)
    out = np.zeros(len(pairs), np.int64)
    size = np.array([max(len(x), len(y)) for x, y in pairs], np.int64)
    masks: dict[str, dict[str, int]] = {}
    for i in np.flatnonzero(size > _LONG):
        x, y = sorted(pairs[i], key=len)
        if len(masks) > 64 and y not in masks:
            masks.clear()
        out[i] = _lcs_long(x, y, masks)
    short = np.flatnonzero(size <= _LONG)
    for at in range(0, len(order := short[np.argsort(size[short], kind="stable")]), _BATCH):
        part = order[at : at + _BATCH]
        out[part] = _lcs_block([pairs[i][0] for i in part], [pairs[i][1] for i in part])
    return out[back]


def _lcs_long(x: str, y: str, masks: dict[str, dict[str, int]]) -> int:
    """One pair, a bit for each character of y in one whole number, a step for each of x."""
    n = len(y)
    of = masks.get(y)
    if of is None:
        codes = np.frombuffer(y.encode("utf-32-le", "surrogatepass"), np.uint32)
        of = masks[y] = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes)}
    full = v = (1 << n) - 1
    for c in x:
        m = of.get(c)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def _codes(texts: list[str], alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts], np.int64)
    grid = np.zeros((len(texts), int(size.max(initial=0))), np.int64)
    for i, t in enumerate(texts):
        grid[i, : len(t)] = [alphabet.setdefault(c, len(alphabet) + 1) for c in t]
    return grid, size


def _lcs_block(a: list[str], b: list[str]) -> np.ndarray:
    alphabet: dict[str, int] = {}
    left: dict[str, int] = {}
    row = np.array([left.setdefault(x, len(left)) for x in a], np.int64)
    grid, size = _codes(list(left), alphabet)
    right: dict[str, int] = {}
    col = np.array([right.setdefault(x, len(right)) for x in b], np.int64)
    other, other_size = _codes(list(right), alphabet)
    words = max(1, -(-grid.shape[1] // 64))
    match = np.zeros((words, len(left), len(alphabet) + 1), np.uint64)
    rows = np.arange(len(left))
    for i in range(grid.shape[1]):
        match[i // 64, rows, grid[:, i]] |= np.uint64(1 << (i % 64))
    match[:, :, 0] = 0
    v = np.full((words, len(a)), np.uint64(0xFFFFFFFFFFFFFFFF))
    for step in range(other.shape[1]):
        code = other[col, step]
        carry = np.zeros(len(a), np.uint64)
        for w in range(words):
            m = match[w, row, code]
            u = v[w] & m
            total = v[w] + u
            over = total < u
            total2 = total + carry
            carry = (over | (total2 < total)).astype(np.uint64)
            v[w] = total2 | (v[w] & ~m)
    out = np.zeros(len(a), np.int64)
    for w in range(words):
        used = np.clip(size[row] - 64 * w, 0, 64)
        mask = np.where(used >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.minimum(used, 63).astype(np.uint64)) - np.uint64(1))
        out += np.bitwise_count(~v[w] & mask)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """2 * LCS / (length + length); 1 for two empty strings."""
    size = np.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], np.float64)
    return np.where(size > 0, 2.0 * lcs_lengths(a, b) / np.maximum(size, 1), 1.0)


def token_sort_ratios(a: list[str], b: list[str]) -> np.ndarray:
    tidy = {t: " ".join(sorted(t.split())) for t in {*a, *b}}
    return ratios([tidy[x] for x in a], [tidy[x] for x in b])


def token_set_ratios(a: list[str], b: list[str], leading_space: bool = False) -> np.ndarray:
    """Best ratio among the common tokens, and these with either side's other tokens.

    leading_space: the variant whose parts are joined with a space even where there are no common tokens, and which has
    no rule for empty strings.
    """
    left, right, common = [], [], []
    words: dict[str, tuple[frozenset, str]] = {}

    def of(x: str) -> tuple[frozenset, str]:
        known = words.get(x)
        if known is None:
            tokens = frozenset(x.split())
            known = words[x] = (tokens, " ".join(sorted(tokens)))
        return known

    for x, y in zip(a, b, strict=True):
        (p, px), (q, qx) = of(x), of(y)
        both = p & q
        common.append(" ".join(sorted(both)) if both else "")
        left.append(" ".join(sorted(p - both)) if both else px)
        right.append(" ".join(sorted(q - both)) if both else qx)
    s, p, q = (np.array([len(t) for t in part], np.float64) for part in (common, left, right))
    shared = lcs_lengths(left, right)
    gap_p = (p > 0) * 1.0 if leading_space else (s > 0) * 1.0
    gap_q = (q > 0) * 1.0 if leading_space else (s > 0) * 1.0
    whole_p, whole_q = s + gap_p + p, s + gap_q + q
    both = s + np.minimum(gap_p, gap_q) + shared
    safe = lambda num, den: np.where(den > 0, num / np.maximum(den, 1), 1.0)
    best = safe(2 * both, whole_p + whole_q)
    with_common = np.maximum(safe(2 * s, s + whole_p), safe(2 * s, s + whole_q))
    if leading_space:
        return np.maximum(best, with_common)
    best = np.where(s > 0, np.maximum(best, with_common), best)
    best = np.where((s > 0) & ((p == 0) | (q == 0)), 1.0, best)
    empty = np.array([not x.split() or not y.split() for x, y in zip(a, b, strict=True)])
    return np.where(empty, 0.0, best)


def blended(a: list[str], b: list[str], kernel: bool = False) -> np.ndarray:
    r, sort, sets = BLEND
    out = r * ratios(a, b) + sort * token_sort_ratios(a, b) + sets * token_set_ratios(a, b, kernel)
    if kernel:
        out = np.where([not x or not y for x, y in zip(a, b, strict=True)], 0.0, out)
    return out


def _udf(function):
    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(function(a.fillna("").tolist(), b.fillna("").tolist()))

    return run


ratio = _udf(ratios)
token_sort_ratio = _udf(token_sort_ratios)
token_set_ratio = _udf(token_set_ratios)
token_ratio = _udf(lambda a, b: np.maximum(token_sort_ratios(a, b), token_set_ratios(a, b)))
similarity = _udf(blended)
kernel_similarity = _udf(lambda a, b: blended(a, b, True))
