"""SimHash near-dedup with vantage-point trees.

A fingerprint takes bit i if more than half of the shingle hashes have it.
Different fingerprints (copies count once) are dealt to shards by a
vantage-point tree: each inner node has a fingerprint and a radius that
halves a bounded sample by Hamming distance. A fingerprint lives in one
shard, and is sent as a query to every shard that its ball of ``max_bits``
touches by the triangle bounds. Inside a shard the same kind of tree is
searched for all queries at once. A shard returns a star for each group it
finds, never all pairs, and the stars are joined by connected components.

Defined cases: a null or blank text has fingerprint zero and is linked like
any other; fewer words than a shingle: the whole sequence is the shingle; repeated
rows share a component; an empty table gives an empty result; a component's
id is its smallest doc_id (null only if it has no other); extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import row_key, text_slices, texts_of, whole_row
from .components import connected_components

SHINGLE, MAX_BITS = 4, 4
#: Fingerprints that shape the shard tree, at most about; points of a shard
#: at which the tree starts to grow; points of a leaf inside a shard.
SAMPLE, SHARD, LEAF = 20_000, 8_192, 96
#: Shingle hashes whose bits are counted at once.
HASH_BLOCK = 1 << 17


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of every run of ``size`` words, A-Z in lower case."""
    from xxhash import xxh64_intdigest as h
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [h(joined, 42)]
    ends = list(accumulate(map(len, words)))
    stops = [e + i for i, e in enumerate(ends)]
    starts = [0] + [s + 1 for s in stops[: len(words) - size]]
    return [h(joined[a:b], 42) for a, b in zip(starts, stops[size - 1:])]


def fingerprints_of(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    hashes = [shingle_hashes(t, size) for t in texts]
    n = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if len(some) == 0:
        return out
    flat = np.array([x for h in hashes for x in h], np.uint64)
    first = (np.cumsum(n) - n)[some]
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    set_bits = np.zeros((len(some), 64), np.int64)
    for a in range(0, len(flat), HASH_BLOCK):  # bounded bit matrices, also inside one long text
        bits = np.unpackbits(flat[a: a + HASH_BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(first, a, side="right") - 1, np.searchsorted(first, a + len(bits))
        set_bits[lo:hi] += np.add.reduceat(bits, np.maximum(first[lo:hi] - a, 0), axis=0, dtype=np.int64)
    out[some] = ((set_bits * 2 > n[some, None]) * weight).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, _k1, _k2, fp) for every row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text"):
            fp = fingerprints_of(texts_of(b, "text"), size).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(fp)], ["doc_id", "_k1", "_k2", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_key(F.col("doc_id"), F.col("text")), "text").mapInArrow(
        run, "doc_id long, _k1 long, _k2 long, fp long")


def distance(x: np.ndarray, y) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int16)


def shard_tree(sample: np.ndarray, depth: int, seed: int = 0) -> list[tuple[int, int]]:
    """(vantage point, radius) of the 2**depth - 1 inner nodes in heap order.
    The vantage point is the one of a few whose distances spread the most."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple[int, int]] = []
    level = [sample]
    for _ in range(depth):
        below = []
        for own in level:
            if len(own) < 2:
                nodes.append((int(own[0]) if len(own) else 0, 64))
                below += [own, own[:0]]
                continue
            tries = own[rng.integers(0, len(own), 8)]
            spread = [distance(own[:2000], t).std() for t in tries]
            point = tries[int(np.argmax(spread))]
            d = distance(own, point)
            radius = int(np.median(d))
            nodes.append((int(point), radius))
            below += [own[d <= radius], own[d > radius]]
        level = below
    return nodes


def visits(fps: np.ndarray, nodes: list[tuple[int, int]], depth: int, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, shard, home?) of every shard that each fingerprint must see."""
    index, at, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool)
    for _ in range(depth):
        points = np.array([nodes[k][0] for k in range(len(nodes))], np.uint64)[at]
        radius = np.array([nodes[k][1] for k in range(len(nodes))])[at]
        d = distance(fps[index], points)
        inner, outer = d - max_bits <= radius, d + max_bits > radius
        index = np.concatenate([index[inner], index[outer]])
        home = np.concatenate([(home & (d <= radius))[inner], (home & (d > radius))[outer]])
        at = np.concatenate([2 * at[inner] + 1, 2 * at[outer] + 2])
    return index, at - (2 ** depth - 1), home


class Groups:
    """Union-find over 0..n-1 with whole-array finds."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            nxt = self.up[r]
            if np.array_equal(nxt, r):
                self.up[x] = r
                return r
            r = nxt

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
            open_ = lo != hi
            if not open_.any():
                return
            a, b, lo, hi = a[open_], b[open_], lo[open_], hi[open_]
            np.minimum.at(self.up, hi, lo)


def link_near(points: np.ndarray, queries: np.ndarray, max_bits: int = MAX_BITS, leaf: int = LEAF) -> Groups:
    """Groups over points + queries (queries numbered after the points) from
    all (point, query) pairs within ``max_bits``, by a vantage-point tree
    over the points that all queries go down together."""
    fps = np.concatenate([points, queries])
    groups = Groups(len(fps))
    work = [(np.arange(len(points)), np.arange(len(points), len(fps)))]
    while work:
        p, q = work.pop()
        if len(p) == 0 or len(q) == 0:
            continue
        roots = groups.roots(p)
        if (roots == roots[0]).all():  # these points are one group: its members have nothing to add
            q = q[groups.roots(q) != roots[0]]
            if len(q) == 0:
                continue
        if len(p) > leaf:
            point = fps[p[len(p) // 2]]
            d = distance(fps[p], point)
            radius = int(np.median(d))
            far = d > radius
            if not far.any():
                radius = int(d.max()) - 1
                far = d > radius
            if far.any() and not far.all():
                dq = distance(fps[q], point)
                work.append((p[~far], q[dq - max_bits <= radius]))
                work.append((p[far], q[dq + max_bits > radius]))
                continue
        for lo in range(0, len(q), 1 << 14):  # bounded distance blocks
            part = q[lo: lo + (1 << 14)]
            hit = np.bitwise_count(fps[part][:, None] ^ fps[p][None, :]) <= max_bits
            i, j = np.nonzero(hit)
            if len(i):
                groups.join(part[i], p[j])
    return groups


def near_links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Stars (a, b) that connect all different fingerprints within ``max_bits``."""
    spark = classes.sparkSession
    n = classes.count()
    # shards grow with the square root of the input, as every level of the
    # tree sends most fingerprints to both sides
    depth = max(0, int(np.ceil(np.log2(max(n, 1) / SHARD) / 2 + 1))) if n > SHARD else 0
    share = int(min(1.0, SAMPLE / max(n, 1)) * 2 ** 30)
    sample = np.array([r[0] for r in classes.where(F.expr(f"pmod(xxhash64(fp), {2 ** 30}) < {share}")).select("fp").collect()] or [0], np.int64)
    nodes = shard_tree(np.sort(sample).view(np.uint64), depth)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), 4096):
                part = fps[lo: lo + 4096]
                index, shard, home = visits(part, nodes, depth, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(part[index].view(np.int64)), pa.array(home)],
                                                 ["shard", "fp", "home"])

    def link(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        points = np.unique(fps[table.column("home").to_numpy().astype(bool)])
        queries = np.unique(fps)
        groups = link_near(points, queries, max_bits)
        both = np.concatenate([points, queries])
        # a point and its own query are the same fingerprint
        groups.join(np.arange(len(points)), len(points) + np.searchsorted(queries, points))
        root = groups.roots(np.arange(len(both)))
        a, b = both, both[root]
        keep = a != b
        return pa.table({"a": a[keep].view(np.int64), "b": b[keep].view(np.int64)})

    return (classes.select("fp").mapInArrow(send, "shard long, fp long, home boolean")
            .groupBy("shard").applyInArrow(link, "a long, b long"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, _k1, _k2, fp, component_id, _first): one row per row of ``docs``;
    _first is the (doc_id, _k1, _k2) of the component's first document."""
    base = stage_table(fingerprints(docs, size), "simhash-fp")
    classes = stage_table(base.groupBy("fp").agg(
        F.min("doc_id").alias("_min"), F.min(F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_k1", "_k2")).alias("_f")), "simhash-classes")
    roots = connected_components(near_links(classes, max_bits)).select(F.col("node").alias("fp"), "root")
    whole = classes.join(roots, "fp", "left").withColumn("_root", F.coalesce("root", "fp"))
    ids = whole.groupBy("_root").agg(F.min("_min").alias("component_id"), F.min("_f").alias("_first"))
    member = whole.select("fp", "_root").join(ids, "_root").select("fp", "component_id", "_first")
    return base.join(member, "fp")


def keep_first(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, once each."""
    near = stage_table(near_duplicates(docs, size, max_bits), "simhash-members")
    here = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_k1", "_k2")
    first = near.where(here.eqNullSafe(F.col("_first"))).groupBy("_k1", "_k2").agg(F.count(F.lit(1)).alias("_n"))
    first = stage_table(first, "simhash-first")
    rows = docs.select(whole_row(docs.columns).alias("_row"), *row_key(F.col("doc_id"), F.col("text"))).join(first, ["_k1", "_k2"])
    once = rows.where(F.col("_n") == 1).select("_row.*")
    if first.where(F.col("_n") > 1).isEmpty():
        return once
    # rows of one doc_id and text: the one whose other columns come first as JSON, in any run
    repeated = rows.where(F.col("_n") > 1).groupBy("_k1", "_k2").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return once.union(repeated.select("_row.*"))
