"""Phrase collocations: n-grams per language, scored by their weakest cut, ranked.

The text is read twice. The first pass gives rows of all words and pairs, the second of all longer n-grams whose pairs
are all frequent, as an n-gram is never more frequent than a part of it. What tells the frequent pairs is a bit filter
of a fixed size: it may let a rare one pass, which costs a row, and never stops a frequent one, so counts are exact at
any size. Tasks add up equal n-grams of a slice before they emit rows; rows are summed per language and n-gram, so a hot
language or word is many partial sums. Parts are joined, extensions anti-joined, scores are decimals, and ranks are
taken within lots of a language before they meet.

Defined results: a null or empty text has no words; a null language is `und`; repeated rows count; an empty table gives
no rows; languages may hold any text; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, slices, small_batches

#: Longest phrase; occurrences of a candidate; per cent of its occurrences that a longer one may hold; rows a language.
MAX_N, LEAST, SHARE, TOP = 4, 30, 80, 2000
#: Bytes of the bit filter of frequent pairs and of its segments; lots of a language in which ranks are taken first.
FILTER, SEGMENT, LOTS = 1 << 23, 1 << 13, 64
#: Text bytes that a task counts at a time.
SLICE = 1_000_000

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[list(b" \t")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(31))


def _text_hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, from its bytes' polynomial."""
    data = texts.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    body = np.frombuffer(data.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    at = ends - ends[0]
    lengths = np.diff(at)
    power = np.r_[np.uint64(1), np.multiply.accumulate(np.full(int(lengths.max(initial=0)), _ODD))]
    place = np.arange(len(body)) - np.repeat(at[:-1], lengths)
    total = np.r_[np.uint64(0), np.add.accumulate((body.astype(np.uint64) + np.uint64(1)) * power[place])]
    return _mixed(total[at[1:]] - total[at[:-1]] + lengths.astype(np.uint64))


def _bits(langs: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a pair of words in the filter, from hashes of its language and words."""
    h = _mixed(_mixed(_mixed(langs) * _ODD + first) * _ODD + second)
    return (h & np.uint64(FILTER * 8 - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(FILTER * 8 - 1)).astype(np.int64)


def _passes(bits: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = ((bits[x >> 3] >> (x & 7).astype(np.uint8)) & 1 for x in at)
    return (a & b).astype(bool)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct lower-case words, and for each word of the texts its code, its text and its piece."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
    edge = np.zeros(len(body) + 1, bool)  # where a text begins
    edge[ends - ends[0]] = True
    broken = _BREAK[body]
    inside = ~(broken | _GAP[body])
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.r_[False, inside[:-1]]))
    stops = np.flatnonzero(inside & (edge[1:] | ~np.r_[inside[1:], False])) + 1
    offsets = np.r_[0, np.cumsum(stops - starts)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(body[inside].tobytes()))
    coded = words.cast(pa.string()).dictionary_encode()  # the words of a slice
    piece = np.cumsum(broken | edge[:-1])[starts]
    text = np.searchsorted(ends - ends[0], starts, side="right") - 1
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), text, piece


def _summed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of codes and their counts."""
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    key, base = codes[:, 0].copy(), 1
    for column in codes.T[1:]:  # one number a row; renumbered before it would pass 63 bits
        base = int(key.max()) + 1
        width = int(column.max()) + 1
        if base * width >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
        key = key * width + column
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return codes[first], n


def _grams(batches: Iterator[pa.RecordBatch], shortest: int, longest: int, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """Rows (lang, n, gram, a) of the n-grams of each slice; n 0 counts all words of a language."""
    for batch in slices(batches, limit=SLICE):
        lang_of = batch.column(batch.schema.get_field_index("lang")).dictionary_encode()
        langs, lang = lang_of.dictionary, lang_of.indices.to_numpy().astype(np.int64)
        words, code, text, piece = _words(batch.column(batch.schema.get_field_index("text")))
        if not len(code):
            continue
        lang = lang[text]
        if bits is not None:
            hashed = _text_hashes(words)[code]
            pair = np.zeros(len(code), bool)
            pair[:-1] = (piece[1:] == piece[:-1]) & _passes(bits, _bits(_text_hashes(langs)[lang[:-1]], hashed[:-1], hashed[1:]))
        out = []
        for n in range(shortest, min(longest, len(code)) + 1):
            at = np.flatnonzero(piece[n - 1 :] == piece[: len(piece) - n + 1])
            for k in range(n - 1) if bits is not None else ():
                at = at[pair[at + k]]
            rows, a = _summed(np.stack([lang[at], *[code[at + k] for k in range(n)]], axis=1))
            if len(rows):
                gram = words.take(pa.array(rows[:, 1])) if n == 1 else pc.binary_join_element_wise(*[words.take(pa.array(rows[:, k])) for k in range(1, n + 1)], pa.scalar(" ", words.type))
                out.append((langs.take(pa.array(rows[:, 0])), n, gram, a))
        if shortest == 1:
            n = np.bincount(lang, minlength=len(langs))
            out.append((langs, 0, pa.array([""] * len(langs), pa.large_string()), n))
        for names, n, gram, a in out:
            columns = [names.cast(pa.string()), pa.array(np.full(len(a), n, np.int32)), gram, pa.array(a.astype(np.int64))]
            table = pa.table(columns, names=["lang", "n", "gram", "a"]).cast(_ROWS)
            yield from table.to_batches(max_chunksize=50_000)


_ROWS = pa.schema([("lang", pa.string()), ("n", pa.int32()), ("gram", pa.string()), ("a", pa.int64())])


def _counts(rows: DataFrame, shortest: int, longest: int, bits=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _grams(batches, shortest, longest, bits.value if bits else None)

    each = rows.mapInArrow(run, "lang string, n int, gram string, a long")
    return each.groupBy("lang", "n", "gram").agg(F.sum("a").alias("a"))


def pair_filter(pairs: DataFrame) -> np.ndarray:
    """The bit filter of (lang, gram) rows of two words: `FILTER` bytes, whatever the number of pairs.

    Segments are or-ed where the bits are dealt to; the driver gets one row for each of them.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                both = pc.split_pattern(batch.column(1), " ")
                flat = _text_hashes(both.flatten()).reshape(-1, 2)
                found = np.unique(np.concatenate(_bits(_text_hashes(batch.column(0)), flat[:, 0], flat[:, 1])))
                yield pa.record_batch([pa.array(found // (SEGMENT * 8)), pa.array(found % (SEGMENT * 8))], names=["segment", "bit"])

    def segment(key: tuple, rows: pa.Table) -> pa.Table:
        out = np.zeros(SEGMENT * 8, np.uint8)
        out[rows.column("bit").to_numpy()] = 1
        return pa.table({"segment": [key[0].as_py()], "data": [np.packbits(out, bitorder="little").tobytes()]})

    # a segment has at most 8 * SEGMENT distinct bits
    dealt = pairs.select("lang", "gram").mapInArrow(bits, "segment long, bit long").distinct()
    made = dealt.groupBy("segment").applyInArrow(segment, "segment long, data binary")
    out = np.zeros(FILTER, np.uint8)
    for row in made.toLocalIterator():
        out[row.segment * SEGMENT : (row.segment + 1) * SEGMENT] = np.frombuffer(row.data, np.uint8)
    return out


def gram_counts(docs: DataFrame, scratch: Scratch, *, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """(lang, n, gram, a) of all n-grams with at least `least` occurrences; n 0 has a language's count of words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    with small_batches(docs.sparkSession):
        short = scratch.keep(_counts(rows, 1, min(2, max_n)).where((F.col("a") >= least) | (F.col("n") == 0)), "short")
    if max_n < 3:
        return short
    bits = docs.sparkSession.sparkContext.broadcast(pair_filter(short.where("n = 2")))
    with small_batches(docs.sparkSession):
        long = scratch.keep(_counts(rows, 3, max_n, bits).where(F.col("a") >= least), "long")
    return short.unionByName(long)


def collocations(docs: DataFrame, scratch: Scratch, *, max_n: int = MAX_N, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to max_n words.

    A phrase's score is that of its weakest cut into a first part (l occurrences) and the rest (r). Phrases of which a
    longer one holds `share` per cent of the occurrences are left out; it is enough to ask those that are longer by one
    word, as what a still longer one holds, the one in between holds too.
    """
    counts = gram_counts(docs, scratch, max_n=max_n, least=least)
    exact = "decimal(38,0)"
    phrases = counts.where("n >= 2").select("lang", F.col("gram").alias("phrase"), F.col("n").alias("size"), "a")
    part = counts.where("n >= 1").select("lang", "gram", "a")

    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("tail"))
    cuts = cuts.join(part.select("lang", F.col("gram").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(part.select("lang", F.col("gram").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    score = F.expr(f"(cast(2000000 as {exact}) * cast(a as decimal(19,0))) div cast(cast(l as {exact}) + cast(r as {exact}) as {exact})")
    weakest = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = phrases.where("size >= 3").select("lang", "a", words.alias("w"))
    shorter = F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))
    held = longer.select("lang", F.explode(shorter).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    covered = F.expr(f"cast(most as {exact}) * 100 >= cast(a as {exact}) * {share}")
    rest = weakest.join(held, ["lang", "phrase"], "left_anti") if max_n < 3 else weakest.alias("p").join(held.alias("h"), (F.col("p.lang") == F.col("h.lang")) & (F.col("p.phrase") == F.col("h.phrase")) & covered, "left_anti")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rest = rest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(LOTS)).alias("lot"))
    rest = rest.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lot").orderBy(*order))).where(F.col("rank") <= top)
    rest = rest.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("n = 0").select("lang", F.col("a").alias("n"))
    return rest.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
