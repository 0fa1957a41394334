"""Language identification by segmentation-marginalised unigrams.

Each language has one probability per piece of a fixed public vocabulary. The probability of a word is the sum,
over all its segmentations into pieces, of the product of piece probabilities; a forward pass computes it for a
block of words at once. A text's log probability is the sum over its words, so it takes every letter of the whole
text into account, and the score is the posterior under equal priors.

Piece probabilities are fitted by expectation maximisation (forward and backward passes) on a sample of labelled
rows: `per_language` rows of each language are expected, however large the corpus is. Words that fill the driver's
tables are counted on the executors first.

Defined results: null text and text without a letter give `und` with score 0; ties go to the language that sorts
first; words are scored whole, whatever their length (the forward pass is rescaled where they are long; in the fit a
word whose probability is below the smallest double, some hundred letters, adds nothing); rows that repeat are scored
alike; with no labelled row every text is `und`; an empty table gives no rows; columns other than the id, the text and,
in the fit, the label are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, split_unique

WORD = re.compile(r"[^\W\d_]+")
START = "▁"
#: Words of more letters are scored with a rescaled forward pass, as their probabilities may be below the smallest double.
LONG = 64
UNKNOWN = "und"


class Lattice:
    """The pieces that can spell lower-case words, as a dense trie over code points."""

    def __init__(self, pieces: list[str]):
        kept = [p for p in dict.fromkeys(pieces) if p == p.lower() and WORD.fullmatch(p.lstrip(START) or "a") and p.count(START) <= 1 and START not in p[1:]]
        self.size = 1
        alphabet = sorted({c for p in kept if len(p) > 1 for c in p})
        self.index = np.zeros(0x110000, dtype=np.int32)
        self.index[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        nodes: dict[tuple[int, str], int] = {}
        self.longest = max((len(p) for p in kept), default=1)
        ends = {}
        for p in kept:
            if any(self.index[ord(c)] == 0 for c in p):
                continue  # a single letter of no longer piece: the unknown letter stands for it
            at = 0
            for c in p:
                at = nodes.setdefault((at, c), len(nodes) + 1)
            ends[at] = self.size
            self.size += 1
        # node 0: start; the last node: no piece goes on
        dead = len(nodes) + 1
        self.next = np.full((dead + 1, len(alphabet) + 1), dead, dtype=np.int32)
        for (at, c), to in nodes.items():
            self.next[at, self.index[ord(c)]] = to
        self.ends = np.zeros(dead + 1, dtype=np.int32)
        for at, i in ends.items():
            self.ends[at] = i

    def paths(self, words: list[str]) -> np.ndarray:
        """Piece of every (word, start, length - 1), or -1. Piece 0 is the unknown letter; all words are of one length."""
        n = len(words[0])
        chars = self.index[np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), n)]
        out = np.full((len(words), n, min(self.longest, n)), -1, dtype=np.int32)
        state = np.zeros((len(words), n), dtype=np.int32)
        for k in range(out.shape[2]):
            state = self.next[state[:, : n - k], chars[:, k:]]
            piece = self.ends[state]
            out[:, : n - k, k] = np.where(piece > 0, piece, -1)
        out[:, :, 0] = np.maximum(out[:, :, 0], 0)  # any single letter can stand as itself, so every word has a path
        return out


def forward(paths: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """alpha[word, place, language]: the sum over segmentations of the first `place` letters. prob's last row is 0."""
    words, n, most = paths.shape
    alpha = np.zeros((words, n + 1, prob.shape[1]))
    alpha[:, 0] = 1
    for j in range(1, n + 1):
        for k in range(1, min(j, most) + 1):
            alpha[:, j] += alpha[:, j - k] * prob[paths[:, j - k, k - 1]]
    return alpha


def log_forward(paths: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Logarithms of the last alphas of forward(), for words of any length: the last few places are held, rescaled."""
    words, n, most = paths.shape
    held = np.zeros((most, words, prob.shape[1]))  # place j at j % most
    held[0], scale = 1, np.zeros((words, prob.shape[1]))
    for j in range(1, n + 1):
        now = sum(held[(j - k) % most] * prob[paths[:, j - k, k - 1]] for k in range(1, min(j, most) + 1))
        held[j % most] = now
        if j % 16 == 0:
            top = np.maximum(held.max(axis=0), 1e-300)
            held /= top
            scale += np.log(top)
    return np.log(np.maximum(held[n % most], 1e-300)) + scale


def backward(paths: np.ndarray, prob: np.ndarray) -> np.ndarray:
    words, n, most = paths.shape
    beta = np.zeros((words, n + 1, prob.shape[1]))
    beta[:, n] = 1
    for i in range(n - 1, -1, -1):
        for k in range(1, min(n - i, most) + 1):
            beta[:, i] += beta[:, i + k] * prob[paths[:, i, k - 1]]
    return beta


def of_length(words: list[str], letters: int = 1 << 17) -> Iterator[list[int]]:
    """Places of words in blocks of one length each, of about so many letters."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for n, group in by.items():
        block = max(1, letters // n)
        for i in range(0, len(group), block):
            yield group[i : i + block]


def words_of(text: str | None) -> list[str]:
    """Letter runs in lower case."""
    return [START + w for w in WORD.findall(text.lower())] if text else []


@dataclass
class LanguageModel:
    pieces: list[str]
    languages: list[str]
    prob: np.ndarray  # (pieces + 1, languages); the last row is 0
    #: Tokens kept with their scores in a worker.
    store: int = 300_000

    def __post_init__(self):
        self.lattice, self.known, self.scores = None, {}, None

    def __getstate__(self):
        return {"pieces": self.pieces, "languages": self.languages, "prob": self.prob, "store": self.store}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def word_scores(self, words: list[str]) -> np.ndarray:
        self.lattice = self.lattice or Lattice(self.pieces)
        out = np.empty((len(words), len(self.languages)))
        for block in of_length(words):
            paths = self.lattice.paths([words[i] for i in block])
            out[block] = log_forward(paths, self.prob) if paths.shape[1] > LONG else np.log(np.maximum(forward(paths, self.prob)[:, -1], 1e-300))
        return out

    def log_probs(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """log probability of each text under each language, and its count of words."""
        if len(self.known) > self.store or self.scores is None:
            self.known, self.scores = {}, np.empty((0, len(self.languages) + 1))
        tokens, index, per_text = split_unique(pa.array(texts, pa.string()))
        new = [t for t in tokens if t not in self.known]
        if new:
            # a token holds some words; its scores are their sums, and the last column counts them
            split = [words_of(t) for t in new]
            words = list(dict.fromkeys(w for ws in split for w in ws))
            at = {w: i for i, w in enumerate(words)}
            each = np.c_[self.word_scores(words), np.ones(len(words))]
            owner = np.repeat(np.arange(len(new)), [len(ws) for ws in split])
            order = np.array([at[w] for ws in split for w in ws], dtype=np.int64)
            sums = np.stack([np.bincount(owner, each[order, j], len(new)) for j in range(each.shape[1])], axis=1)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, sums])
        place = np.array([self.known[t] for t in tokens], dtype=np.int64)[index]
        out = np.zeros((len(per_text), len(self.languages) + 1))
        some = np.flatnonzero(per_text)
        if len(some):
            out[some] = np.add.reduceat(self.scores[place], (np.cumsum(per_text) - per_text)[some])
        return out[:, :-1], out[:, -1]

    def predict(self, texts: pa.Array | list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        logs, counts = self.log_probs(texts)
        best = logs.argmax(axis=1)
        post = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        known = (counts > 0).tolist()
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(p) if k else 0.0 for p, k in zip(post, known, strict=True)]


def fit_counts(rows: list[tuple[str, str, int]], pieces: list[str], rounds: int = 3, smooth: float = 0.02) -> LanguageModel:
    """Expectation maximisation over (language, word, count) rows."""
    lattice, languages = Lattice(pieces), sorted({r[0] for r in rows})
    prob = np.zeros((lattice.size + 1, max(1, len(languages))))
    for j, lang in enumerate(languages):
        words, counts = zip(*((w, n) for x, w, n in rows if x == lang), strict=True)
        weight = np.array(counts, dtype=float)
        p = np.full((lattice.size + 1, 1), 1 / lattice.size)
        p[-1] = 0
        for _ in range(rounds):
            got = np.full(lattice.size + 1, smooth)
            for block in of_length(list(words)):
                paths = lattice.paths([words[i] for i in block])
                a, b = forward(paths, p)[:, :, 0], backward(paths, p)[:, :, 0]
                scale = weight[block] / np.maximum(a[:, -1], 1e-300)
                for k in range(paths.shape[2]):
                    n = paths.shape[1] - k
                    piece = paths[:, :n, k]
                    use = a[:, :n] * b[:, k + 1 : k + 1 + n] * p[piece, 0] * scale[:, None]
                    got += np.bincount(np.where(piece < 0, lattice.size, piece).ravel(), use.ravel(), lattice.size + 1)
            got[-1] = 0
            p = (got / got.sum())[:, None]
        prob[:, j] = p[:, 0]
    return LanguageModel(pieces, languages, prob if languages else prob[:, :0])


def fit(docs: DataFrame, training: Column, pieces: list[str], *, label: str = "lang", per_language: int = 400) -> LanguageModel:
    """Fits on labelled rows for which `training` holds; about `per_language` rows of each language are read.

    The sample takes the rows of a language whose hash of doc_id is smallest, by a threshold that follows from its
    row count, so no sort is needed and neither words nor memory on the driver grow with the corpus.
    """
    rows = docs.where(training & F.col(label).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return fit_counts([], pieces)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    sample = rows.where(part < F.element_at(share, F.col(label))).select(F.col(label).cast("string").alias("lang"), "text")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
        flat = [(lang, w, n) for lang, c in seen.items() for w, n in c.items()]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*flat, strict=True)], ["lang", "word", "n"])

    tallied = sample.mapInArrow(tally, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = tallied.toArrow()
    rows_ = sorted(zip(*(got.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True))
    return fit_counts(rows_, pieces)


def predict(docs: DataFrame, model: LanguageModel, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; only the text is an input of the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = shared.value.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_column)


def identified(docs: DataFrame, model: LanguageModel, *, least: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose language is found with a score of at least `least`. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, score = shared.value.predict(b.column("text"))
            yield b.filter(pa.array([k != UNKNOWN and s >= least for k, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
