"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The words of a slice of texts lie one after another in flat numpy symbol arrays. In every round each word's
best pair is found with one segmented minimum over pair ranks, all its leftmost occurrences merge at once, and
the arrays are compacted; words without a pair left retire. Some vocabularies rank a longer piece above its own
part. A word that holds such a part twice merges only the leftmost one in that round, so that the result stays
that of the one-merge-at-a-time definition.

Defined results: null text encodes like empty text (the end id only); very long texts need no cut, as rounds run
over words; ties in rank go to the leftmost pair; characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, split_unique

SPACE = "▁"
NONE = np.iinfo(np.int64).max
CHARS = 0x110000


class PieceCodec:
    #: Words kept with their ids; beyond it the store starts anew, so memory stays bounded.
    STORE = 500_000

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_path)
        n = sp.vocab_size()
        self.size, self.end, self.unk = n, sp.eos_id(), sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        kinds = ["byte" if sp.is_byte(i) else "control" if sp.is_control(i) else "unk" if sp.is_unknown(i) else "unused" if sp.is_unused(i) else "" for i in range(n)]
        if "unused" in kinds:
            raise ValueError("vocabularies with unused pieces are not supported")
        score = {p: sp.get_score(i) for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if not k}
        self.normal = {p: i for i, p in enumerate(self.pieces) if not kinds[i]}
        order = {s: r for r, s in enumerate(sorted({score[p] for p in self.normal if len(p) > 1}, reverse=True))}
        # symbols: a piece's id, or for a character that is no piece the vocabulary size plus its code point
        self.chars = np.arange(CHARS, dtype=np.int64) + n
        for p, i in self.normal.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        symbol = lambda p: self.normal.get(p, n + ord(p) if len(p) == 1 else None)
        keys, ranks, merged, late = [], [], [], set()
        shared = {r for r, k in _counts(order[score[p]] for p in self.normal if len(p) > 1).items() if k > 1}
        for p, i in self.normal.items():
            for k in range(1, len(p)):
                u, v = symbol(p[:k]), symbol(p[k:])
                if u is not None and v is not None:
                    rank = order[score[p]]
                    keys.append(u * (n + CHARS) + v)
                    ranks.append(rank)
                    merged.append(i)
                    late.update(r for part in (p[:k], p[k:]) if len(part) > 1 and (r := order[score[part]]) >= rank)
        by = np.argsort(np.array(ranks, dtype=np.int64), kind="stable")
        self.keys, ranks, self.merged = (np.array(x, dtype=np.int64)[by] for x in (keys, ranks, merged))
        self.level = np.r_[ranks, NONE]  # rank of each pair in the table
        #: Ranks whose merges may open a better pair, or that two pieces share.
        self.single = np.zeros(len(order) + 1, dtype=bool)
        self.single[list(late | shared)] = True
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if kinds[i] == "byte"}
        inside = {a + b for p in self.normal for a, b in zip(p, p[1:], strict=False)}
        apart = not any(b[0] != SPACE and b[1] == SPACE or "\n" in b for b in inside)
        # no piece spans these cuts, so no merge does
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n" if apart else r"(?s).+")
        self.strings = [str(i) for i in range(n)]
        self.surface = [b"" if k == "control" else bytes([int(p[3:5], 16)]) if k == "byte" else " ⁇ ".encode() if k == "unk" else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.kinds, self.control = kinds, [i for i, k in enumerate(kinds) if k == "control"]
        self._slots()
        self._reset()

    def _reset(self) -> None:
        self.known = {}
        self.flat = np.array([self.end], dtype=np.int32)
        self.starts, self.lens = np.zeros(1, np.int64), np.ones(1, np.int64)

    def _slots(self) -> None:
        """Places every pair in an open hash table; a pair's entry lies within `probes` slots of its hash."""
        self.bits = max(4, int(np.ceil(np.log2(8 * max(1, len(self.keys))))))
        self.slot = np.full((1 << self.bits) + 64, -1, dtype=np.int32)
        home, self.probes, left = self._home(self.keys), 0, np.arange(len(self.keys))
        while len(left):
            at = home[left] + self.probes
            free = self.slot[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            put = first[free[first]]
            self.slot[at[put]] = left[put]
            left = np.delete(left, put)
            self.probes += 1

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table of pairs, or -1."""
        key = left * (self.size + CHARS) + right
        home = self._home(key)
        entry = self.slot[home]
        found = np.where((entry >= 0) & (self.keys[entry] == key), entry, -1)
        open_ = np.flatnonzero((entry >= 0) & (found < 0))
        for k in range(1, self.probes):
            if not len(open_):
                break
            entry = self.slot[home[open_] + k]
            hit = (entry >= 0) & (self.keys[entry] == key[open_])
            found[open_[hit]] = entry[hit]
            open_ = open_[(entry >= 0) & ~hit]
        return found

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the count for each word. Words are not empty."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sym = self.chars[points]
        owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
        # pairs are sorted by rank, so a pair's place in the table stands for its rank; `last` means no pair
        last = len(self.keys)
        pair = np.full(len(sym), last)
        inner = np.flatnonzero(owner[:-1] == owner[1:])
        found = self._pairs(sym[inner], sym[inner + 1])
        pair[inner] = np.where(found < 0, last, found)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[starts, len(sym)])
            best = self.level[np.minimum.reduceat(pair, starts)]
            live = best < NONE
            if not live.all():
                each = np.repeat(live, length)
                done.append((owner[~each], sym[~each]))
                sym, owner, pair = sym[each], owner[each], pair[each]
                best, length = best[live], length[live]
                if not len(sym):
                    break
            at = np.flatnonzero(self.level[pair] == np.repeat(best, length))
            new = owner[at]
            first = np.r_[True, new[1:] != new[:-1]]
            if not first.all():
                # a run of touching pairs (aaaa) merges every other one from its left end
                run = np.r_[True, (at[1:] != at[:-1] + 1) | first[1:]]
                place = np.arange(len(at))
                odd = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 1
                at = at[first | ~(odd | self.single[self.level[pair[at]]])]
            sym[at] = self.merged[pair[at]]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # one symbol went for each merge before it
            sym, owner, pair = sym[keep], owner[keep], pair[keep]
            stale = np.zeros(len(sym) + 1, dtype=bool)
            stale[now] = stale[now - 1] = True  # at the left end, the spare entry
            redo = np.flatnonzero(stale[:-1])
            pair[redo] = last
            redo = redo[redo < len(sym) - 1]
            redo = redo[owner[redo] == owner[redo + 1]]
            found = self._pairs(sym[redo], sym[redo + 1])
            pair[redo] = np.where(found < 0, last, found)
        owner, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.argsort(owner, kind="stable")
        return self._spell(owner[by], sym[by], len(words))

    def _spell(self, owner: np.ndarray, sym: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Writes characters that are no piece as byte pieces."""
        lost = np.flatnonzero(sym >= self.size)
        if len(lost):
            as_ids = {int(s): [self.bytes[b] for b in chr(int(s) - self.size).encode()] if self.bytes else [self.unk] for s in np.unique(sym[lost])}
            times = np.ones(len(sym), dtype=np.int64)
            times[lost] = [len(as_ids[int(s)]) for s in sym[lost]]
            place = np.cumsum(times) - times
            owner, spelt = np.repeat(owner, times), np.repeat(sym, times)
            for i in lost:
                spelt[place[i] : place[i] + times[i]] = as_ids[int(sym[i])]
            sym = spelt
        return sym.astype(np.int32), np.bincount(owner, minlength=n)

    def _learn(self, tokens: list[str]) -> np.ndarray:
        """Places in the store of tokens, which are cut where no merge can cross."""
        known = self.known
        place = np.array([known.get(t, -1) for t in tokens], dtype=np.int64)
        missing = np.flatnonzero(place < 0).tolist()
        if missing:
            new = list(dict.fromkeys([tokens[i] for i in missing]))
            split = [self.cut.findall(t) for t in new]
            if max(map(len, split)) <= 1 and all(split):  # no token is cut
                ids, lens = self.merge([ws[0] for ws in split])
                lens = lens.astype(np.int64)
            else:
                parts = {w: i for i, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
                ids, counts = self.merge(list(parts)) if parts else (np.empty(0, np.int32), np.empty(0, np.int64))
                order = np.array([parts[w] for ws in split for w in ws], dtype=np.int64)
                begin, lens = (np.cumsum(counts) - counts)[order], counts[order]
                ids = ids[_spans(begin, lens)]
                of_token = np.repeat(np.arange(len(new)), [len(ws) for ws in split])
                lens = np.bincount(of_token, lens, len(new)).astype(np.int64)
            known.update(zip(new, range(len(self.lens), len(self.lens) + len(new)), strict=True))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lens) - lens]
            self.lens = np.r_[self.lens, lens]
            self.flat = np.r_[self.flat, ids]
            place[missing] = [known[tokens[i]] for i in missing]
        return place

    def encode(self, texts: pa.Array | list[str | None], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin (one more entry than texts)."""
        if len(self.known) > self.STORE:
            self._reset()
        texts = pc.fill_null(pa.array(texts, pa.string()), "")
        # a space before each token but in front of runs of spaces, whose pieces may span several
        odd = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.or_(pc.ends_with(texts, " "), pc.match_substring(texts, SPACE))))
        odd = odd.to_numpy(zero_copy_only=False)
        if odd.any():
            whole = texts.to_pylist()
            rows = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if o else None for t, o in zip(whole, odd.tolist(), strict=True)]
            plain, counts = pa.array([t for t, o in zip(whole, odd.tolist(), strict=True) if not o], pa.string()), np.zeros(len(odd), np.int64)
            names, index, few = split_unique(plain, " ")
            counts[~odd], counts[odd] = few, [len(r) for r in rows if r is not None]
            more = list(dict.fromkeys(w for r in rows if r is not None for w in r))
            at = {w: len(names) + i for i, w in enumerate(more)}
            full = np.empty(counts.sum(), np.int64)
            owner = np.repeat(odd, counts)
            full[~owner], full[owner] = index, [at[w] for r in rows if r is not None for w in r]
            index, tokens = full, [SPACE + t for t in names] + more
        else:
            names, index, counts = split_unique(texts, " ")
            tokens = [SPACE + t for t in names]
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        if empty.any():  # these split into one empty token; they have no pieces
            at = np.cumsum(counts)[empty] - 1
            index, counts = np.delete(index, at), counts - empty
        place = self._learn(tokens)[index]
        if end:
            place = np.insert(place, np.cumsum(counts), 0)
            counts = counts + 1
        lens = self.lens[place]
        return self.flat[_spans(self.starts[place], lens)], np.r_[0, np.cumsum(lens)][np.r_[0, np.cumsum(counts)]]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces vanish, one leading space of the first piece goes, bytes become characters."""
        first = next((i for i in ids if self.kinds[i] != "control"), None)
        strip = first is not None and not self.kinds[first] and self.pieces[first].startswith(SPACE)
        try:
            if any(i in ids[:-1] for i in self.control):  # these part bytes that would make one character
                return self._careful(ids)[strip:]
            return b"".join(map(self.surface.__getitem__, ids))[strip:].decode()
        except UnicodeDecodeError:
            return self._careful(ids)[strip:]

    def _careful(self, ids: list[int]) -> str:
        """Each run of byte pieces becomes characters, and every byte that belongs to none the replacement character."""
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == "byte":
                run += self.surface[i]
                continue
            while run:
                for k in range(1, 5):
                    try:
                        out.append(bytes(run[:k]).decode())
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("\ufffd")
                    k = 1
                del run[:k]
            if i is not None:
                out.append(self.surface[i].decode())
        return "".join(out)


def _spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every span, one span after another."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


def _counts(values) -> dict:
    out: dict = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return out


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    """One codec for each Python worker."""
    return PieceCodec(model_path)


def encode(docs: DataFrame, model_path: str, *, id_column: str = "doc_id", text_column: str = "text", end: bool = True) -> DataFrame:
    """(id, ids array<int>) for each row. Other columns of `docs` are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in slices(batches):
            ids, at = c.encode(b.column("text"), end)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))], ["id", "ids"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, model_path: str, *, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text) for each row of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([c.decode(x or []) for x in b.column("ids").to_pylist()], pa.string())], ["id", "text"])

    rows = encoded.select(encoded[id_column].alias("id"), encoded[ids_column].alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Encodes and decodes every whole text; per document the count of ids and digests of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in slices(batches):
            flat, at = c.encode(b.column("text"))
            n, ids_sha, text_sha = [], [], []
            for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = flat[i:j].tolist()
                n.append(j - i)
                ids_sha.append(sha(" ".join(map(c.strings.__getitem__, ids))))
                text_sha.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
