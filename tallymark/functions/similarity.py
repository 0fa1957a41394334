"""String similarity: trigram sets natively; the insertion-deletion family vectorised over the pairs of an Arrow batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def trigrams(c: Column) -> Column:
    """Distinct trigrams of each word, padded with two spaces in front and one behind."""
    padded = F.transform(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, 3)))
    return F.array_distinct(F.flatten(grams))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with rows as bits of one integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * _lcs(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer, windows over the ends included."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 0.0
    n = len(a)
    return max(ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str, score=ratio) -> float:
    x, y = set(a.split()), set(b.split())
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 100.0
    with_x, with_y = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max([score(with_x, with_y)] + ([score(both, with_x), score(both, with_y)] if both else []))


def weighted(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < 1.5:
        return max(ratio(a, b), 0.95 * max(token_set(a, b), token_sort(a, b)))
    part = 0.9 if longer <= 8 else 0.6
    partial_tokens = max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), token_set(a, b, partial_ratio))
    return max(ratio(a, b), part * partial_ratio(a, b), 0.95 * part * partial_tokens)


CAP, PREFIX_BONUS, ACRONYM = 0.94, 0.10, 0.86


def pair_score(q: str, c: str) -> tuple[float, str]:
    """Score in 0 to 1 and method of two normalised names."""
    if not q or not c:
        return 0.0, "empty"
    if q == c:
        return 1.0, "exact_normalized"
    score, method = 0.45 * max(token_set(q, c), weighted(q, c)) / 100 + 0.55 * token_sort(q, c) / 100, "fuzzy"
    x, y = q.split(), c.split()
    if len(x) != len(y) and x[: min(len(x), len(y))] == y[: min(len(x), len(y))]:
        score, method = score + PREFIX_BONUS, "token_prefix"
    initials = lambda w: "".join(t[0] for t in w) if len(w) > 1 else ""
    if any(len(s) >= 2 and s.replace(" ", "") == i for s, i in ((q, initials(y)), (c, initials(x)))):
        score, method = max(score, ACRONYM), "acronym"
    return min(score, CAP), method


def _lcs_of_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """`_lcs` of many pairs at once: one 64-bit row a pair, one step a character of the longest b."""
    out = np.zeros(len(a), np.int64)
    size = np.fromiter(map(len, a), np.int64, len(a))
    for i in np.flatnonzero(size > 64):  # names longer than a machine word
        out[i] = _lcs(a[i], b[i])
    short = np.flatnonzero((size > 0) & (size <= 64))
    if not len(short):
        return out
    points = lambda of: np.array([of[i] for i in short]).view(np.uint32).reshape(len(short), -1)
    x, y = points(a), points(b)
    x = np.where(np.arange(x.shape[1]) < size[short, None], x, np.uint32(0xFFFFFFFF))  # what pads a differs from what pads b
    row = np.full(len(short), ~np.uint64(0))
    same = np.zeros((len(short), 64), bool)
    for j in range(y.shape[1]):
        same[:, : x.shape[1]] = x == y[:, j : j + 1]
        hit = row & np.packbits(same, axis=1, bitorder="little").view("<u8")[:, 0]
        row = (row + hit) | (row - hit)
    out[short] = np.bitwise_count(~row)
    return out


def _ratios(a: list[str], b: list[str]) -> np.ndarray:
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    return np.where(total == 0, 100.0, 200.0 * _lcs_of_pairs(a, b) / np.maximum(total, 1))


def _partial_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """`partial_ratio` of many pairs; a window of the longer string is a pair of its own."""
    out = np.zeros(len(a))
    some, needle, window = [], [], []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = sorted((x, y), key=len)
        letters, n = set(x), len(x)
        # a window that neither begins nor ends with a letter of the shorter string is no better than one beside it
        parts = {y[max(0, k) : k + n] for k in range(1 - n, len(y))} if n else ()
        parts = [w for w in parts if w[-1] in letters or w[0] in letters]
        some += [i] * len(parts)
        needle += [x] * len(parts)
        window += parts
    if some:
        np.maximum.at(out, some, _ratios(needle, window))
    return out


def pair_scores(q: list[str], c: list[str], floor: float = 0.0) -> tuple[np.ndarray, list[str]]:
    """`pair_score` of many pairs. Scores below `floor` may be given lower than they are: windows are then not tried."""
    words = {n: n.split() for n in {*q, *c}}
    in_order = {n: " ".join(sorted(w)) for n, w in words.items()}
    by_sort = _ratios([in_order[x] for x in q], [in_order[x] for x in c])
    parts = []
    for x, y in zip(q, c, strict=True):
        x, y = set(words[x]), set(words[y])
        parts.append([" ".join(sorted(s)) for s in (x & y, x - y, y - x)])
    both, only_q, only_c = (list(x) for x in zip(*parts, strict=True)) if parts else ([], [], [])
    size = lambda of: np.fromiter(map(len, of), np.float64, len(of))
    shared, rest_q, rest_c = size(both), size(only_q), size(only_c)
    # what both have in common stands in front of either rest, so only the rests are compared
    joined = lambda rest: shared + rest + ((shared > 0) & (rest > 0))
    with_q, with_c = joined(rest_q), joined(rest_c)
    gap = (shared > 0) & (rest_q > 0) & (rest_c > 0)
    common = 200.0 * (shared + gap + _lcs_of_pairs(only_q, only_c)) / np.maximum(with_q + with_c, 1)
    part = lambda longer: np.where(shared > 0, 200.0 * shared / np.maximum(shared + longer, 1), 0.0)
    by_set = np.maximum(common, np.maximum(part(with_q), part(with_c)))
    by_set = np.where((shared > 0) & ((rest_q == 0) | (rest_c == 0)), 100.0, by_set)

    whole = _ratios(q, c)
    lengths = size(q), size(c)
    longer = np.maximum(*lengths) / np.maximum(np.minimum(*lengths), 1)
    weighted_score = np.maximum(whole, 0.95 * np.maximum(by_set, by_sort))
    scale = np.where(longer <= 8, 0.9, 0.6)
    far = longer >= 1.5
    weighted_score[far] = whole[far]
    prefix = np.array([len(words[x]) != len(words[y]) and all(i == j for i, j in zip(words[x], words[y], strict=False)) for x, y in zip(q, c, strict=True)], bool)
    most = 0.45 * np.maximum(by_set, np.maximum(whole, 100 * scale)) / 100 + 0.55 * by_sort / 100 + PREFIX_BONUS * prefix
    tried = np.flatnonzero(far & (by_set < 100 * scale) & (most >= floor - 1e-9))
    if len(tried):
        pick = lambda of: [of[i] for i in tried]
        straight = _partial_ratios(pick(q), pick(c))
        tokens = _partial_ratios([in_order[q[i]] for i in tried], [in_order[c[i]] for i in tried])
        sets = np.where(shared[tried] > 0, 100.0, _partial_ratios(pick(only_q), pick(only_c)))
        windows = np.maximum(scale[tried] * straight, 0.95 * scale[tried] * np.maximum(tokens, sets))
        weighted_score[tried] = np.maximum(weighted_score[tried], windows)

    score = 0.45 * np.maximum(by_set, weighted_score) / 100 + 0.55 * by_sort / 100 + PREFIX_BONUS * prefix
    initials = {n: "".join(t[0] for t in w) if len(w) > 1 else "" for n, w in words.items()}
    bare = {n: n.replace(" ", "") for n in words}
    short_form = np.array([(len(x) >= 2 and bare[x] == initials[y]) or (len(y) >= 2 and bare[y] == initials[x]) for x, y in zip(q, c, strict=True)], bool)
    score = np.minimum(np.where(short_form, np.maximum(score, ACRONYM), score), CAP)
    equal = np.array([x == y for x, y in zip(q, c, strict=True)], bool)
    empty = (lengths[0] == 0) | (lengths[1] == 0)
    score = np.where(empty, 0.0, np.where(equal, 1.0, score))
    method = np.select([empty, equal, short_form, prefix], ["empty", "exact_normalized", "acronym", "token_prefix"], "fuzzy")
    return score, method.tolist()


def score_pairs(q: Column | str, c: Column | str, floor: float = 0.0) -> Column:
    """struct<score, method> of two columns of normalised names; scores below `floor` may come out lower than they are."""

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        score, method = pair_scores([x or "" for x in a], [x or "" for x in b], floor)
        return pd.DataFrame({"score": score, "method": method})

    kind = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("method", T.StringType())])
    return F.pandas_udf(run, kind)(q, c)
