"""Benchmark decontamination: training passages query a BM25 inverted index of test items by block-max WAND.

A document's passages are windows of words, twice as long as the longest item of an index and half overlapping, so an item
that stands in a document stands whole in a passage. Items that are much longer than most have indexes of their own, so
that a long one does not make every passage long. The index holds, per term, a posting list of (item, weight) in the order
of items, the list's largest weight, and the largest weight in each block of BLOCK items. Weights of an item are divided by
its own total, so scores lie in 0 to 1. A passage's cursors stand in the lists of its terms; the pivot is the first cursor at
which the largest weights of the lists reach the least threshold. If the maxima of the pivot's block cannot reach the
block's least threshold, all cursors up to the pivot skip to the next block or cursor; else the item is scored.

Before the cursors are set, a passage is held against the rare terms of the items in one pass over the batch: an item is
possible only if the weights of its rare terms in the passage and all of its frequent terms reach its threshold. The
condition is necessary, so it loses nothing; passages without a possible item have nothing to retrieve.

A threshold loses nothing either: an item of n words of which 80 % of the five-word shingles occur leaves at most a fifth of
n - 4 words uncovered, and none if no shingle may be missing, so its score is at least 1 minus the sum of that many
largest weights. Retrieved pairs are
verified: 80 % of the item's shingles in the passage, and half of the words of its question and of its answer (the
last sentence, or the last quarter if there is one sentence only). A part shorter than a shingle is not tested by
itself, as one altered word would veto a pair that holds the item's shingles; its overlap is still reported.

Defined results: null and empty texts and items match nothing; items shorter than a shingle are one shingle; repeated
rows are judged alike; texts of any length are read whole; ties do not matter, as everything above a threshold is returned;
empty tables give no rows; columns other than the id and text are only passed on. Item counts, lengths and document
frequencies are of all items. Postings are dealt into indexes of at most PART_BYTES of text, so what is broadcast is
bounded; one index holds some 100,000 items, and the results do not depend on how many there are.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, slices, split_unique

SHINGLE, OVERLAP, PART_OVERLAP = 5, 0.8, 0.5
K1, B = 1.2, 0.75
#: Items of a block. Terms in no more items than RARE are rare.
BLOCK, RARE = 16, 32
PART_BYTES = 64_000_000
#: Items of more words than so many times the median have indexes of their own, by powers of it.
FAR = 8
#: Bytes of text that are looked up at once: bounds the arrays by word and by posting.
SLICE = 2_000_000


def tokens(text: str | None) -> list[str]:
    return [w for w in re.split(r"[ \t-\r]+", (text or "").translate(LOWER)) if w]


def shingles(words: list, width: int = SHINGLE) -> set[tuple]:
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def parts(words: list[str]) -> tuple[list[str], list[str]]:
    """Question and answer of an item."""
    ends = [i + 1 for i, w in enumerate(words[:-1]) if w[-1] in ".!?"]
    cut = ends[-1] if ends else len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


@dataclass
class Statistics:
    """Of all items, whatever their index."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]

    @classmethod
    def of(cls, items: list[list[str]]) -> Statistics:
        return cls(len(items), sum(map(len, items)) / max(1, len(items)), max(map(len, items), default=1), Counter(t for words in items for t in set(words)))


class ItemIndex:
    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        rows = sorted((i, tokens(t)) for i, t in items)
        rows = [(i, w) for i, w in rows if w]
        s = statistics or Statistics.of([w for _, w in rows])
        self.ids, self.longest = [i for i, _ in rows], s.longest
        self.terms: dict[str, int] = {}
        self.words, self.cut, thresholds, owner, term, weight, slack = [], [], [], [], [], [], []
        for k, (_, words) in enumerate(rows):
            tf = Counter(words)
            w = np.array([np.log1p((s.n - s.df[t] + 0.5) / (s.df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / s.mean)) for t, f in tf.items()])
            w = (w / w.sum()).astype(np.float32)
            lost = int((1 - OVERLAP) * len(shingles(words, min(SHINGLE, len(words)))) + 1e-9)
            if lost:  # by places; shingles that repeat can each lose up to four more words
                lost = min(lost + SHINGLE - 1, int((1 - OVERLAP) * (len(words) - SHINGLE + 1) + 1e-9))
            thresholds.append(1 - np.sort(w)[::-1][:lost].sum() - 1e-4)
            # rare terms of this item, and further ones while the frequent terms alone reach its threshold
            df = np.array([s.df[t] for t in tf])
            by = np.argsort(-df, kind="stable")
            frequent = by[(df[by] > RARE) & (np.cumsum(w[by]) < thresholds[-1])]
            slack.append(w[frequent].sum())
            rare = np.ones(len(w), dtype=bool)
            rare[frequent] = False
            owner += [k] * len(w)
            term += [self.terms.setdefault(t, len(self.terms)) for t in tf]
            weight += list(zip(w.tolist(), rare.tolist(), strict=True))
            self.words.append(np.array([self.terms[t] for t in words], dtype=np.int32))
            self.cut.append(len(parts(words)[0]))
        self.threshold = np.array(thresholds, dtype=np.float32)
        self.least = float(self.threshold.min()) if rows else 1.0
        self.floor = np.minimum.reduceat(self.threshold, np.arange(0, len(rows), BLOCK)) if rows else np.empty(0, np.float32)
        owner, term = np.array(owner, dtype=np.int32), np.array(term, dtype=np.int32)
        by = np.argsort(term, kind="stable")  # items stay in order
        self.item, self.weight = owner[by], np.array([w for w, _ in weight], dtype=np.float32)[by]
        rare = np.array([r for _, r in weight], dtype=bool)[by]
        self.at = np.searchsorted(term[by], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weight, self.at[:-1]) if rows else np.empty(0, np.float32)
        # the rare terms' postings by themselves
        self.rare_item, self.rare_weight = self.item[rare], self.weight[rare]
        self.rare_at = np.searchsorted(term[by][rare], np.arange(len(self.terms) + 2))
        self.needed = self.threshold - np.array(slack, dtype=np.float32) - np.float32(1e-5) if rows else self.threshold
        # block maxima, one behind the other as the postings are
        block = self.item // BLOCK
        new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (term[by][1:] != term[by][:-1])]) if rows else np.empty(0, np.int64)
        self.block, self.block_most = block[new], np.maximum.reduceat(self.weight, new) if rows else self.weight
        self.block_at = np.searchsorted(term[by][new], np.arange(len(self.terms) + 1))

    def retrieve(self, terms: np.ndarray, possible: list[int] | None = None) -> list[int]:
        """Items whose score for these distinct terms reaches their threshold: block-max WAND with a cursor per term.

        With a list of the possible items, cursors also skip whatever lies between them."""
        at, end = self.at[terms].tolist(), self.at[terms + 1].tolist()
        most = self.most[terms].tolist()
        live = sorted((int(self.item[p]), k) for k, p in enumerate(at))
        out = []

        def move(k: int, item: int) -> None:
            """Moves cursor k to the first posting of `item` or a later one, and its place among the cursors."""
            at[k] += int(np.searchsorted(self.item[at[k] : end[k]], item))
            if at[k] < end[k]:
                insort(live, (int(self.item[at[k]]), k))

        while live:
            total, pivot = 0.0, -1
            for x, (_, k) in enumerate(live):
                total += most[k]
                if total >= self.least:
                    pivot = x
                    break
            if pivot < 0:
                break
            item = live[pivot][0]
            if possible is not None:
                x = bisect_left(possible, item)
                if x == len(possible):
                    break
                if possible[x] > item:
                    behind = bisect_left(live, (possible[x], -1))
                    moved, live[:behind] = live[:behind], []
                    for _, k in moved:
                        move(k, possible[x])
                    continue
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            bound = 0.0
            for _, k in live[: pivot + 1]:
                i, j = self.block_at[terms[k]], self.block_at[terms[k] + 1]
                x = i + int(np.searchsorted(self.block[i:j], block))
                bound += float(self.block_most[x]) if x < j and self.block[x] == block else 0.0
            if bound < self.floor[block] - 1e-6:
                # nothing before the next block, or before a cursor that could add to this one
                to = (block + 1) * BLOCK
                if pivot + 1 < len(live):
                    to = min(to, live[pivot + 1][0])
                moved, live[: pivot + 1] = live[: pivot + 1], []
            elif live[0][0] == item:
                here = [k for x, k in live[: pivot + 1] if x == item]
                if sum(float(self.weight[at[k]]) for k in here) >= self.threshold[item] - 1e-6:
                    out.append(item)
                to, moved, live[: len(here)] = item + 1, live[: len(here)], []
            else:
                behind = next(x for x in range(pivot + 1) if live[x][0] == item)
                to, moved, live[:behind] = item, live[:behind], []
            for _, k in moved:
                move(k, to)
        return out

    def possible(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The (passage, item) pairs that can match, in order, from the rare terms' (passage, term) places."""
        place = np.unique(passage * (len(self.terms) + 1) + term)
        passage, term = place // (len(self.terms) + 1), place % (len(self.terms) + 1)
        first, many = self.rare_at[term], self.rare_at[term + 1] - self.rare_at[term]
        spot = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        pair = np.repeat(passage, many) * len(self.ids) + self.rare_item[spot]
        pair, code = np.unique(pair, return_inverse=True)
        got = np.bincount(code, self.rare_weight[spot], len(pair))
        pair = pair[got >= self.needed[pair % len(self.ids)]]
        return np.stack([pair // len(self.ids), pair % len(self.ids)])

    def verify(self, item: int, here: np.ndarray) -> tuple[float, float, float] | None:
        """The shares of an item's shingles, question and answer in a passage, if they make a leak."""
        words, cut = self.words[item], self.cut[item]
        held = set(here.tolist())
        width = min(SHINGLE, len(words))
        grams = shingles(here.tolist(), width) if len(here) >= width else set()
        want = shingles(words.tolist(), width)
        share = len(want & grams) / len(want)
        q, a = set(words[:cut].tolist()), set(words[cut:].tolist())
        in_q, in_a = (len(x & held) / max(1, len(x)) for x in (q, a))
        if share >= OVERLAP - 1e-9 and (in_a >= PART_OVERLAP or len(words) - cut < SHINGLE) and (in_q >= PART_OVERLAP or cut < SHINGLE):
            return share, in_q if q else 1.0, in_a
        return None

    def matches(self, texts: pa.Array) -> list[dict[int, tuple]]:
        """For each text, item place -> (shingle overlap, question overlap, answer overlap, first word of the passage)."""
        names, index, counts = split_unique(pc.ascii_lower(texts))
        out: list[dict[int, tuple]] = [{} for _ in counts]
        lost, half = len(self.terms), self.longest
        code = np.array([self.terms.get(w, lost) for w in names], dtype=np.int64)
        flat = code[index] if len(names) else np.empty(0, np.int64)
        if not len(flat) or not self.ids:
            return out
        # half windows: a passage is two neighbours, numbered as its first
        begins, pieces = np.cumsum(counts) - counts, -(-counts // half)
        of = np.repeat(np.arange(len(counts)), pieces)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = begins[of] + nth * half
        stop = np.minimum(begin + half, (begins + counts)[of])
        rare = np.flatnonzero((self.rare_at[1:] > self.rare_at[:-1])[flat])
        piece = np.searchsorted(begin, rare, side="right") - 1
        before = nth[piece] > 0  # the place is also in the passage that begins one piece earlier
        passage, item = self.possible(np.r_[piece, piece[before] - 1], np.r_[flat[rare], flat[rare[before]]])
        cuts = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1], True]) if len(passage) else []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            p = int(passage[x])
            a, b = begin[p], stop[p + 1] if p + 1 < len(of) and of[p + 1] == of[p] else stop[p]
            here = flat[a:b]
            known = np.unique(here)
            for i in self.retrieve(known[known < lost], item[x:y].tolist()):
                found = self.verify(i, here)
                best = out[of[p]].get(i)
                if found and (best is None or found[0] > best[0]):
                    out[of[p]][i] = (*found, int(a - begins[of[p]]))
        return out


def by_length(items: list[tuple[int, str]], statistics: Statistics, usual: float) -> Iterator[ItemIndex]:
    """Indexes of items of like lengths; `usual` is the median of all items' words."""
    groups: dict[int, list[tuple[int, str]]] = {}
    for i, text in items:
        n = len(tokens(text))
        k = 0 if n <= FAR * usual else int(np.log(n / usual) / np.log(FAR))
        groups.setdefault(k, []).append((i, text))
    for k, group in sorted(groups.items()) or [(0, [])]:
        # the most that an item of the group can have, so that passages do not depend on how items are dealt
        yield ItemIndex(group, replace(statistics, longest=min(statistics.longest, int(usual * FAR ** (k + 1)) + 1)))


def indexes(items: DataFrame, *, id_column: str = "item_id", text_column: str = "text") -> Iterator[ItemIndex]:
    """The indexes of the items, with the statistics of all: of each length, and more if their texts take over PART_BYTES."""
    rows = items.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t")).where("t is not null and i is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if total <= PART_BYTES:
        held = sorted((r.i, r.t) for r in rows.collect())
        words = [w for w in (tokens(t) for _, t in held) if w]
        yield from by_length(held, Statistics.of(words), float(np.median([len(w) for w in words])) if words else 1.0)
        return
    n = -(-2 * total // PART_BYTES)
    words = F.filter(F.split(F.translate("t", string.ascii_uppercase, string.ascii_lowercase), r"[ \t-\r]+"), lambda w: w != "")
    rows = rows.withColumn("words", words).where(F.size("words") > 0).withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(n)))
    count, mean, longest, usual = rows.agg(F.count("*"), F.avg(F.size("words")), F.max(F.size("words")), F.percentile_approx(F.size("words"), 0.5)).first()
    terms = rows.select("part", F.explode(F.array_distinct("words")).alias("w"))
    df = terms.groupBy("w").agg(F.count("*").alias("df"))
    for k in range(n):
        part = {r.w: r.df for r in df.join(terms.where(F.col("part") == k).select("w").distinct(), "w", "left_semi").collect()}  # the part's vocabulary
        held = sorted((r.i, r.t) for r in rows.where(F.col("part") == k).select("i", "t").collect())
        yield from by_length(held, Statistics(count, float(mean), longest, part), float(usual))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap, question_overlap, answer_overlap, first_word): a row per document and item in it."""
    out = None
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, limit=SLICE):
                found = shared.value.matches(b.column("text"))
                rows = [(d, shared.value.ids[i], *x) for d, m in zip(b.column("doc_id").to_pylist(), found, strict=True) for i, x in sorted(m.items())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "overlap", "question_overlap", "answer_overlap", "first_word"])

        one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            run, "doc_id long, item_id long, overlap double, question_overlap double, answer_overlap double, first_word long"
        )
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, in whose text no item stands. Rows are not shuffled."""
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, limit=SLICE):
                yield b.filter(pa.array([not m for m in shared.value.matches(b.column("text"))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
