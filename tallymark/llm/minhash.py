"""Near-duplicate documents by b-bit MinHash.

A document's set holds the distinct word shingles of its whole text. HASHES minima are taken per set; the low BITS bits
of each are packed into a signature, and bands of full minima give candidates (`band_rows`: as many minima to a band as
the limit allows, so that texts well below it seldom meet). Bit counts of packed signatures estimate the similarity,
corrected for chance collisions of the low bits; what the estimate leaves is confirmed on full sets of 64-bit hashes.

Sets that are equal form one class first, so a group of copies costs one row from then on. Classes that share a bucket
are first held against the bucket's smallest one, the hub (for each class its smallest hub, then the other hubs that are
not connected to it yet). Where a bucket still holds several components, all pairs of different components are compared
in blocks of bounded size: first by signatures, which leaves clusters of possible links, then by full sets within each
cluster. A block hands out one row for each member (the smallest member that it reaches there), never its pairs, and two
blocks of one component do not meet. No partner is dropped.

Defined results: null and empty texts have no shingles and link with nothing, in batches and tables of nothing else too;
texts of fewer words than a shingle have one shingle, the whole sequence; very long texts are taken whole; repeated rows
of one text are one class; rows with a null id are returned unlinked; ties in minima do not matter; an empty table gives
an empty result; columns other than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, split_unique
from .components import components

HASHES, BITS = 280, 4
#: The chance that a pair just at the limit meets in no band is at most this.
MISSED = 2e-4
#: About five standard deviations of the estimate near the limit.
MARGIN = 0.13
#: Members of a block that are compared with another block at once, and bytes that count as so many members.
BLOCK, BLOCK_BYTES = 1024, 16_000_000
#: Columns of the dense part of a block that are multiplied at once.
COLUMNS = 4096
#: A hub's partners are dealt over so many blocks; its set goes to each block once.
HUB_BLOCKS = 64
#: Bits for each id of the filter that spares unneeded rows their sets, and most bits of it. A full filter spares fewer.
FILTER_BITS, MOST_BITS = 16, 1 << 29

_U = np.uint64
_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; words as the white-space contract has them, A-Z in lower case."""
    words, index, counts = split_unique(pc.ascii_lower(texts))
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=_U)[index]
    n = len(hashed)
    joined = np.zeros(n, dtype=_U)
    for k in range(min(width, n)):
        joined[: n - k] = _mix(joined[: n - k] + hashed[k:] + _U(k + 1))
    out, start = [], 0
    for c in counts.tolist():
        if c >= width:
            s = np.sort(joined[start : start + c - width + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif c:
            whole = np.full(1, c, dtype=_U)
            for h in hashed[start : start + c]:
                whole = _mix(whole * _U(31) + h)
            out.append(whole)
        else:
            out.append(np.empty(0, dtype=_U))
        start += c
    return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES minima of every set that is not empty."""
    out = np.empty((len(sets), HASHES), dtype=np.uint32)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 1 << 15):
            size += len(sets[j])
            j += 1
        x = (np.concatenate(sets[i:j]) >> _U(32)).astype(np.uint32)
        at = np.cumsum([0, *map(len, sets[i : j - 1])])
        for k in range(HASHES):
            out[i:j, k] = np.minimum.reduceat(x * _A[k] + _B[k], at)
        i = j
    return out


def band_rows(limit: float) -> int:
    """Minima to a band: the most that keep the chance of missing a pair at the limit within MISSED."""
    return max(r for r in range(1, HASHES) if r == 1 or (1 - limit**r) ** (HASHES // r) <= MISSED)


def pack(low: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, packed into whole 64-bit words: one row of bytes per set."""
    bits = (low[:, :, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)
    packed = np.packbits(bits.reshape(len(low), HASHES * BITS).astype(np.uint8), axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (rows of bytes, broadcast against each other), corrected for chance collisions."""
    differ = np.ascontiguousarray(a ^ b).view(np.uint64)
    # a minimum's four bits agree if none of them differs
    some = differ | (differ >> _U(1))
    some = (some | (some >> _U(2))) & _U(0x1111111111111111)
    same = 1 - np.bitwise_count(some).sum(axis=-1) / HASHES
    chance = 1 / (1 << BITS)
    return (same - chance) / (1 - chance)


def sketch(docs: DataFrame, width: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sig, bands): set_key is a 128-bit digest of the set; null sig for empty sets."""
    n_bands = HASHES // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=2_000_000):
            sets = shingle_sets(b.column("text"), width)
            low = minima([s for s in sets if len(s)])
            grouped = low[:, : n_bands * rows].astype(_U).reshape(len(low), n_bands, rows)
            key = np.broadcast_to(np.arange(n_bands, dtype=_U), grouped.shape[:2]).copy()
            for r in range(rows):
                key = _mix(key * _U(31) + grouped[:, :, r])
            at, sig, bands, digest = 0, [], [], []
            packed = pack(low)
            for s in sets:
                if len(s):
                    sig.append(packed[at].tobytes())
                    bands.append(key[at].view(np.int64))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    at += 1
                else:
                    sig.append(None), bands.append(None), digest.append(None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "sig", "bands"],
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set) of the documents in `ids` and of a few more that the filter lets through: one pass over the texts."""
    wanted = max(1 << 15, min(MOST_BITS, 1 << (FILTER_BITS * max(1, ids.count()) - 1).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(wanted))
    maps = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    size = len(maps[0].bits) if maps else 1
    flat = np.zeros((wanted // (8 * size) + 2, size) if maps else (1, 1), dtype=np.uint8)  # at most MOST_BITS
    for r in maps:
        flat[r.k] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(flat)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = shared.value
        for b in batches:
            k, at = b.column("bucket").to_numpy(zero_copy_only=False), b.column("bit").to_numpy(zero_copy_only=False)
            b = b.filter(pa.array((flags[k, at >> 3] >> (at & 7)) & 1 == 1))
            for part in slices(iter([b]), limit=2_000_000):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([s.tobytes() for s in shingle_sets(part.column("text"), width)], pa.binary())], ["id", "set"])

    if not maps:
        return docs.sparkSession.createDataFrame([], "id long, set binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null")
    return rows.select("id", "text", F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).mapInArrow(run, "id long, set binary")


@dataclass
class Limit:
    """A pair links if hundredths * union <= 100 * intersection."""

    hundredths: int

    @property
    def loose(self) -> float:
        return self.hundredths / 100 - MARGIN

    def links(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of intersection sizes and set sizes."""
        return 100 * both >= self.hundredths * (a + b - both)


def _near(pairs: DataFrame, classes: DataFrame, limit: Limit) -> DataFrame:
    """The pairs whose estimated similarity is not clearly below the limit."""
    loose = limit.loose

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
                near = pa.array(estimate(x, y) >= loose)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(near), b.column("b").filter(near)], ["a", "b"])

    sig = lambda c: classes.select(F.col("rep").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, limit: Limit) -> DataFrame:
    """The pairs (a, b) that link on full sets. A hub's partners are dealt over blocks, and its set goes to each block."""
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(HUB_BLOCKS)).alias("block"))
    left = dealt.select("a", "block").distinct().join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    right = dealt.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, (x, y) in enumerate(zip(batch.column("set_a"), batch.column("set_b"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), dtype=_U), np.frombuffer(y.as_buffer(), dtype=_U)
                if len(x) and len(y):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    keep[i] = limit.links(np.int64((y[at] == x).sum()), len(x), len(y))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return left.join(right, ["a", "block"]).select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def blocks(members: DataFrame, scratch: Scratch) -> DataFrame:
    """(m: members of two blocks that meet) of `members` (key, id, comp, data) whose key holds several components.

    A component that fills a block has blocks of its own, which meet the key's other blocks but not each other; the
    members of small components share blocks, which meet each other and themselves.
    """
    load = F.greatest(F.lit(1), F.length("data") * F.lit(BLOCK) / F.lit(BLOCK_BYTES))
    sizes = scratch.keep(members.groupBy("key", "comp").agg(F.sum(load).alias("w")), "sizes")
    shared = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.sum(F.when(F.col("w") < BLOCK, F.col("w"))).alias("w")).where("comps > 1")
    shared = scratch.keep(shared.select("key", F.ceil(F.coalesce("w", F.lit(0)) / BLOCK).alias("n_shared")), "shared")
    large = scratch.keep(sizes.where(F.col("w") >= BLOCK).join(shared.select("key"), "key", "left_semi").select("key", "comp", F.ceil(F.col("w") / BLOCK).alias("n_own")), "large")
    held = large.select("key", F.col("comp").cast("string").alias("own"), F.col("n_own").alias("n")).unionByName(shared.where("n_shared > 0").select("key", F.lit("").alias("own"), F.col("n_shared").alias("n")))
    block = held.select("key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda r: F.struct(F.col("own").alias("own"), r.alias("r")))).alias("at"))
    block = scratch.keep(block, "blocks")
    meet = block.withColumnRenamed("at", "i").join(block.withColumnRenamed("at", "j"), "key").where("i.own < j.own or (i.own = '' and j.own = '' and i.r <= j.r)")
    meet = scratch.keep(meet, "meet")
    mine = members.join(shared, "key").join(large, ["key", "comp"], "left")
    spot = F.struct(F.when(F.col("n_own").isNull(), "").otherwise(F.col("comp").cast("string")).alias("own"), F.pmod(F.xxhash64("id"), F.coalesce("n_own", "n_shared")).alias("r"))
    mine = mine.select("key", "id", "comp", "data", spot.alias("at"))
    side = lambda x, right, some: mine.join(some.withColumn("at", F.col(x)), ["key", "at"]).select("key", "i", "j", F.struct("id", "comp", F.lit(right).alias("right"), "data").alias("m"))
    placed = side("i", False, meet).unionByName(side("j", True, meet.where("i <> j")))
    return placed.groupBy("key", "i", "j").agg(F.collect_list("m").alias("m")).select("m")


def _reached(within: DataFrame, links) -> DataFrame:
    """(id, to) of the members of blocks that link there with other components: the smallest member that they reach.

    `links(data, left, right)` is the matrix of links between two lists of places in `data`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                flat = b.column("m")[k].values
                ids, comp, side = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("id", "comp", "right"))
                by = np.argsort(ids, kind="stable")  # places in the order of ids, so the least place is the least id
                ids, comp, side = ids[by], comp[by], side[by]
                data = [flat.field("data")[int(i)].as_py() for i in by]
                left = np.flatnonzero(~side)
                right = np.flatnonzero(side) if side.any() else left
                if not len(left):
                    continue
                found = links(data, left, right) & (comp[left][:, None] != comp[right][None])
                root, touched = np.arange(len(ids)), np.zeros(len(ids), dtype=bool)
                for x, row in zip(left[found.any(axis=1)], found[found.any(axis=1)], strict=True):
                    y = np.r_[x, right[row]]
                    touched[y] = True
                    roots = np.unique(root[y])
                    root[np.isin(root, roots)] = roots[0]
                yield pa.RecordBatch.from_arrays([pa.array(ids[touched]), pa.array(ids[root[touched]])], ["id", "to"])

    return within.mapInArrow(run, "id long, to long")


def _alike(loose: float):
    """Links by the estimate from signatures."""

    def links(data: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        sig = np.frombuffer(b"".join(data), dtype=np.uint8).reshape(len(data), -1)
        return np.stack([estimate(sig[x][None], sig[right]) >= loose for x in left])

    return links


def _exact(limit: Limit):
    """Links by full sets: shingles that only one member holds add to no intersection, the others are multiplied."""

    def links(data: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
        sizes = np.array([len(d) // 8 for d in data])
        owner = np.repeat(np.arange(len(data)), sizes)
        _, code, times = np.unique(np.frombuffer(b"".join(data), dtype=_U), return_inverse=True, return_counts=True)
        often = times > 1
        column = (np.cumsum(often) - 1)[code]
        keep = often[code]
        owner, column = owner[keep], column[keep]
        by = np.argsort(column, kind="stable")
        owner, column = owner[by], column[by]
        both = np.zeros((len(left), len(right)), dtype=np.float64)
        n = int(often.sum())
        for c in range(0, n, COLUMNS):
            i, j = np.searchsorted(column, [c, c + COLUMNS])
            x = np.zeros((len(data), min(COLUMNS, n - c)), dtype=np.float32)
            x[owner[i:j], column[i:j] - c] = 1
            both += x[left] @ x[right].T
        return limit.links(both, sizes[left][:, None], sizes[right][None]) & (both > 0)

    return links


def near_duplicates(docs: DataFrame, scratch: Scratch, *, width: int = 5, hundredths: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `docs`, by the links of the module's definition."""
    limit = Limit(hundredths)
    rows = scratch.keep(sketch(docs, width, band_rows(hundredths / 100)), "sketch")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    whole = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("sig", "bands"), "doc_id").alias("s"))
    classes = scratch.keep(whole.select("set_key", "rep", "s.sig", "s.bands"), "classes")
    placed = classes.select("rep", F.explode("bands").alias("key"))
    hubs = scratch.keep(placed.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1").select("key", "hub"), "hubs")
    buckets = scratch.keep(placed.join(hubs, "key"), "buckets")
    sigs = scratch.keep(classes.select("rep", "sig").join(buckets.select("rep").distinct(), "rep", "left_semi"), "sigs")
    ids = scratch.keep(buckets.select(F.col("rep").alias("id")).distinct(), "ids")
    sets = scratch.keep(full_sets(docs, ids, width).join(ids, "id", "left_semi").distinct(), "sets")
    stars = scratch.keep(buckets.where("hub <> rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    first = scratch.keep(_near(stars.groupBy("b").agg(F.min("a").alias("a")), sigs, limit), "first")
    links = scratch.keep(_confirm(first, sets, limit), "links")
    labels = components(links, scratch)
    label = lambda c: labels.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    apart = stars.join(label("a"), "a", "left").join(label("b"), "b", "left").where("coalesce(of_a, a) <> coalesce(of_b, b)")
    second = scratch.keep(_near(apart.select("a", "b"), sigs, limit), "second")
    links = links.unionByName(scratch.keep(_confirm(second, sets, limit), "links"))
    named = scratch.keep(components(links, scratch).select("id", F.col("component").alias("comp")), "labels")
    members = buckets.select("key", F.col("rep").alias("id")).join(named, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    members = scratch.keep(members, "members")
    open_ = members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    members = scratch.keep(members.join(open_, "key").join(sigs.select(F.col("rep").alias("id"), F.col("sig").alias("data")), "id"), "open")
    possible = scratch.keep(_reached(blocks(members, scratch), _alike(limit.loose)), "possible")
    clusters = scratch.keep(components(possible.select(F.col("id").alias("a"), F.col("to").alias("b")), scratch), "clusters")
    members = clusters.select(F.col("component").alias("key"), "id").join(named, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    members = scratch.keep(members.join(sets.withColumnRenamed("set", "data"), "id"), "clustered")
    more = scratch.keep(_reached(blocks(members, scratch), _exact(limit)), "more")
    labels = components(links.unionByName(more.select(F.col("id").alias("a"), F.col("to").alias("b"))), scratch)
    named = classes.select("set_key", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = scratch.keep(named.select("set_key", F.coalesce("component", "rep").alias("component")), "named")
    out = rows.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
