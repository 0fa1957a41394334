"""Chat formatting over a prefix tree of conversations.

Conversations that share initial turns share the nodes of those turns. A node is one turn after one history, and its key
the hash of that history and turn; the keys along a conversation are its path. Sorted by path, conversations with a
common beginning are neighbours, so one pass over the sorted rows is a depth-first walk of the tree: each conversation
adds nodes only for the turns that it does not share with the one before it, and shared turns are emitted once. Nothing is
joined and no path is repeated per turn. The sort is cut into range partitions, equal paths among them (the row's hash is
the second sort key), so a common first turn or many copies of one conversation never meet in one task. Each partition
notes its first and last path in one row; the driver walks these rows to find what a partition shares with those before
it and where in the stream it begins.

Each node carries its tokens, its start in the stream, the position id of its first token (what its ancestors hold) and
the intervals of its ancestors, touching ones merged, which are what its tokens attend to besides themselves.

Template: `<|turn:ROLE|>TEXT</s>`. Control strings inside a role or text get a backslash, and backslashes in front of
a control string are doubled, so the text is found again exactly. Header, text and end are tokenised apart, and the
loss mask is the text of assistant turns.

Defined results: null texts and roles are empty; rows of one conversation and turn stand in the order of role and
text; equal rows stay separate turns; each row without a conversation id is a conversation of its own; an empty table
gives no rows; texts of any length are taken whole (a conversation, which is one row of the result, has to fit a task);
columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import base64
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# fixed values: the strings that the template and common chat templates use as control strings
CONTROL = r"<\|turn:|\|>|</?s>|\[/?INST\]|<</?SYS>>"
KEY = 16  # bytes of a node's key
HEAD, MID, END = "<|turn:", "|>", "</s>"
#: Rows handed on at once.
ROWS = 1024
_ESCAPE = re.compile(rf"(\\*)({CONTROL}|\Z)")
_REAL = re.compile(rf"(\\*)({CONTROL})")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[1] * 2 + ("\\" + m[2] if m[2] else ""), text)


def unescape(text: str) -> str:
    """The text that escape() was given."""
    return _ESCAPE.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], text)


def segments(role: str, text: str) -> tuple[str, str, str]:
    return HEAD + escape(role) + MID, escape(text), END


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    cuts = [(m.start(2), m.end(2)) for m in _REAL.finditer(formatted) if len(m[1]) % 2 == 0]
    turns, at = [], iter(cuts)
    for _, open_end in at:
        mid, close = next(at), next(at)
        turns.append((unescape(formatted[open_end : mid[0]]), unescape(formatted[mid[1] : close[0]])))
    return turns


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """A byte-level vocabulary: decoding gives every text back exactly."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Stream:
    """The formatted tree. `nodes`: key, depth, role, ids, loss_from, loss_to (places in ids; equal if nothing is learnt),
    start, position, intervals (array of start, stop in stream order, without the node itself), part. `leaves`: conv_id,
    n_turns, start (of the node that ends the conversation), part. `carried`: part, start of the nodes before a part that
    its conversations go on from."""

    nodes: DataFrame
    leaves: DataFrame
    carried: DataFrame


def _paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path, turns): the keys of a conversation's nodes, one behind the other."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths = []
            for turns in b.column("turns").to_pylist():
                key, path = b"", []
                for t in turns:
                    key = xxhash.xxh3_128_digest(key + f"{len(t['role'])}:{t['role']}{t['text']}".encode("utf-8", "surrogatepass"))
                    path.append(key)
                paths.append(b"".join(path))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(paths, pa.binary()), b.column("turns")], ["conv_id", "path", "turns"])

    return rows.mapInArrow(chain, "conv_id long, path binary, turns array<struct<turn: long, role: string, text: string>>")


def joined(intervals: list, more: tuple[int, int]) -> list:
    """Intervals with one more behind them; touching ones become one."""
    if intervals and intervals[-1][1] == more[0]:
        return [*intervals[:-1], (intervals[-1][0], more[1])]
    return [*intervals, more]


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_WALK = {"kind": pa.int32(), "part": pa.int32(), "conv_id": pa.int64(), "n_turns": pa.int64(), "key": pa.binary(), "depth": pa.int32(), "role": pa.string(), "ids": pa.list_(pa.int32()), "loss_from": pa.int32(), "loss_to": pa.int32(), "start": pa.int64(), "intervals": _SPAN, "note": pa.string()}
_WALK_SQL = "kind int, part int, conv_id long, n_turns long, key binary, depth int, role string, ids array<int>, loss_from int, loss_to int, start long, intervals array<struct<start: bigint, stop: bigint>>, note string"
_NODE, _LEAF, _NOTE = range(3)


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()], list(kinds))


def _spans(intervals: list) -> list[dict]:
    return [{"start": a, "stop": b} for a, b in intervals]


def _walk(batches: Iterator[pa.RecordBatch], vocabulary: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Nodes and leaves of one partition's conversations in the order of paths, in local places; then the partition's note."""
    enc = encoding(vocabulary, pattern)
    head = lru_cache(4096)(lambda role: enc.encode_ordinary(segments(role, "")[0]))
    end = enc.encode_ordinary(END)
    keys: list[bytes] = []
    spans: list[tuple[int, int]] = []
    above: list[list] = [[]]  # merged intervals of a node's ancestors, by depth
    total, part, note, rows = 0, 0, None, []
    for b in batches:
        for conv, path, turns, part in zip(*(b.column(c).to_pylist() for c in ("conv_id", "path", "turns", "part")), strict=True):  # noqa: B007
            own = [path[i : i + KEY] for i in range(0, len(path), KEY)]
            same = _shared(keys, own)
            del keys[same:], spans[same:], above[same + 1 :]
            for k in range(same, len(own)):
                role, text = turns[k]["role"], turns[k]["text"]
                first, inner = head(role), enc.encode_ordinary(escape(text))
                ids = [*first, *inner, *end]
                rows.append({"kind": _NODE, "part": part, "key": own[k], "depth": k + 1, "role": role, "ids": ids, "loss_from": len(first), "loss_to": len(first) + (len(inner) if role == "assistant" else 0), "start": total, "intervals": _spans(above[k])})
                spans.append((total, total + len(ids)))
                above.append(joined(above[k], spans[-1]))
                total += len(ids)
            keys = own
            rows.append({"kind": _LEAF, "part": part, "conv_id": conv, "n_turns": len(own), "start": spans[-1][0]})
            note = note or {"first": [k.hex() for k in own], "stops": [e for _, e in spans]}
            if len(rows) >= ROWS:
                yield _batch(rows, _WALK)
                rows = []
    if note:
        note |= {"size": total, "last": [k.hex() for k in keys], "spans": spans}
        yield _batch([*rows, {"kind": _NOTE, "part": part, "note": json.dumps(note)}], _WALK)


def _shared(a: list, b: list) -> int:
    """How many items two lists have in common at their beginning."""
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@dataclass
class Place:
    """Where a partition lies: local places from `repeated` on move by `shift`; before that stand nodes that earlier
    partitions have, which end at local `stops` and lie at `inherited` in the stream."""

    shift: int
    repeated: int
    stops: list[int]
    inherited: list[tuple[int, int]]

    def start(self, local: int) -> int:
        return local + self.shift if local >= self.repeated else self.inherited[bisect_right(self.stops, local)][0]

    def intervals(self, local: list) -> list:
        out: list = []
        for a, b in local:
            if a < self.repeated:  # the first interval, which begins at the root
                for span in self.inherited[: bisect_left(self.stops, min(b, self.repeated)) + 1]:
                    out = joined(out, span)
                a = self.repeated
            if a < b:
                out = joined(out, (a + self.shift, b + self.shift))
        return out


def places(notes: list[tuple[int, dict]]) -> dict[int, Place]:
    """The place of each partition, from their notes in order."""
    out, base, keys, spans = {}, 0, [], []
    for part, note in notes:
        same = _shared(keys, note["first"])
        repeated = note["stops"][same - 1] if same else 0
        out[part] = place = Place(base - repeated, repeated, note["stops"][:same], spans[:same])
        base += note["size"] - repeated
        spans = [place.inherited[k] if a < repeated else (a + place.shift, b + place.shift) for k, (a, b) in enumerate(note["spans"])]
        keys = note["last"]
    return out


def build(conversations: DataFrame, scratch: Scratch, vocabulary: str, pattern: str) -> Stream:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text")).alias("t"))
    rows = rows.withColumn("lone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    rows = rows.groupBy("conv_id", "lone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("lone")
    paths = scratch.keep(_paths(rows).withColumn("salt", F.xxhash64("conv_id")), "paths")
    walk = paths.repartitionByRange("path", "salt").sortWithinPartitions("path", "salt").withColumn("part", F.spark_partition_id())
    local = scratch.keep(walk.select("conv_id", "path", "turns", "part").mapInArrow(lambda batches: _walk(batches, vocabulary, pattern), _WALK_SQL), "local")
    # a row per partition: two paths and their places
    found = places([(r.part, json.loads(r.note)) for r in local.where(F.col("kind") == _NOTE).select("part", "note").orderBy("part").collect()])
    spark = conversations.sparkSession
    shared = spark.sparkContext.broadcast(found)

    def node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [shared.value[p] for p in b.column("part").to_pylist()]
            new = [s >= p.repeated for s, p in zip(b.column("start").to_pylist(), at, strict=True)]
            b, at = b.filter(pa.array(new, pa.bool_())), [p for p, n in zip(at, new, strict=True) if n]
            start = [p.start(s) for s, p in zip(b.column("start").to_pylist(), at, strict=True)]
            spans = [p.intervals([(x["start"], x["stop"]) for x in i]) for i, p in zip(b.column("intervals").to_pylist(), at, strict=True)]
            new = [pa.array(start, pa.int64()), pa.array([sum(y - x for x, y in i) for i in spans], pa.int64()), pa.array([_spans(i) for i in spans], _SPAN)]
            kept = ["key", "depth", "role", "ids", "loss_from", "loss_to", "part"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], [*kept, "start", "position", "intervals"])

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start = [shared.value[p].start(s) for s, p in zip(b.column("start").to_pylist(), b.column("part").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("n_turns"), b.column("part"), pa.array(start, pa.int64())], ["conv_id", "n_turns", "part", "start"])

    schema = "key binary, depth int, role string, ids array<int>, loss_from int, loss_to int, part int, start long, position long, intervals array<struct<start: bigint, stop: bigint>>"
    nodes = scratch.keep(local.where(F.col("kind") == _NODE).drop("note", "conv_id", "n_turns").mapInArrow(node, schema), "nodes")
    leaves = scratch.keep(local.where(F.col("kind") == _LEAF).select("conv_id", "n_turns", "part", "start").mapInArrow(leaf, "conv_id long, n_turns long, part int, start long"), "leaves")
    scratch.drop(local, paths)
    carried = spark.createDataFrame([(part, a) for part, p in found.items() for a, _ in p.inherited], "part int, start long")  # a path per partition
    return Stream(nodes, leaves, carried)


def read_back(stream: Stream, vocabulary: str, pattern: str) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_text, turns) of every conversation, read from the stream: a second depth-first
    walk, which holds the turns from the root to the node it is at."""
    nodes = stream.nodes.select("part", "start", F.lit(_NODE).alias("kind"), "depth", "ids", "loss_from", "loss_to")
    before = nodes.drop("part").join(stream.carried, "start")
    leaves = stream.leaves.withColumn("kind", F.lit(_LEAF))
    walk = nodes.unionByName(before).unionByName(leaves, allowMissingColumns=True)
    walk = walk.repartition("part").sortWithinPartitions("part", "start", "kind")
    turn = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "formatted": pa.string(), "loss_text": pa.string(), "turns": turn}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary, pattern)
        held: list[tuple[str, str]] = []
        last, done, rows, size = None, {}, [], 0
        for b in batches:
            for r in b.to_pylist():
                if r["kind"] == _NODE:
                    ids = r["ids"]
                    del held[r["depth"] - 1 :]
                    held.append((enc.decode(ids), unescape(enc.decode(ids[r["loss_from"] : r["loss_to"]]))))
                    continue
                if (r["part"], r["start"]) != last:  # else a copy of the conversation before it
                    last, whole = (r["part"], r["start"]), "".join(x for x, _ in held)
                    done = {"formatted": whole, "loss_text": "".join(x for _, x in held), "turns": [{"role": x, "text": y} for x, y in parse(whole)]}
                rows.append({"conv_id": r["conv_id"], "n_turns": r["n_turns"], **done})
                size += len(done["formatted"])
                if len(rows) >= ROWS or size > 1 << 22:
                    yield _batch(rows, kinds)
                    rows, size = [], 0
        yield _batch(rows, kinds)

    return walk.mapInArrow(read, "conv_id long, n_turns long, formatted string, loss_text string, turns array<struct<role: string, text: string>>")


def attention_mask(intervals: list[tuple[int, int]], start: int, count: int, size: int) -> np.ndarray:
    """The rows of a dense mask for one node; for tests and small packs."""
    mask = np.zeros((count, size), dtype=bool)
    for a, b in intervals:
        mask[:, a:b] = True
    mask[:, start : start + count] |= np.tril(np.ones((count, count), dtype=bool))
    return mask
