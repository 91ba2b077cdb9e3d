"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by pseudo-rotations (random signs and a fast Hadamard
transform, three times) and hashed to its nearest signed axis. ``tables``
independent rotations make the tables; a query looks into the ``probes``
signed axes nearest to it in every table, by default into one of PROBE_SHARE
per dimension, so that recall holds for wider vectors. Candidates are ranked
exactly in double precision where they lie; each bucket returns its best ``k``
only. A query that found fewer than ``k`` others looks into all axes of the
first table, which holds every vector once.

A bucket that holds many vectors is split into blocks of ``block`` vectors
from counted sizes, and queries go to every block of a bucket they probe.

Defined cases: vectors that are null, zero or hold null or non-finite
components take no part; vectors of another dimension are never compared;
ties go to the smaller id; only fewer candidates give fewer rows; equal rows are
taken together before hashing, and an id with several vectors takes one place,
with its nearest; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stage_table

TABLES, PROBES, PROBE_SHARE, BLOCK, SEED = 10, 10, 4, 20_000, 5


def rotations(dim: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Random signs: tables x 3 x the next power of two of ``dim``."""
    width = 1 << max(0, int(dim - 1).bit_length())
    return np.random.default_rng([seed, dim]).choice(np.array([-1.0, 1.0]), (tables, 3, width))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of signs and fast Hadamard transform (rows of x)."""
    width = signs.shape[1]
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    for s in signs:
        y *= s
        h = 1
        while h < width:
            z = y.reshape(len(y), width // (2 * h), 2, h)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(len(y), width)
            h *= 2
    return y


def axes(y: np.ndarray, probes: int = 1) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: axis, or axis + width for its negative."""
    both = np.concatenate([y, -y], axis=1)
    probes = min(probes, both.shape[1])
    part = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, part, axis=1), axis=1, kind="stable")
    return np.take_along_axis(part, order, axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v): vectors that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.select(F.col("vec_id").cast("long").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0)).dropDuplicates())


def probed(dim: int) -> int:
    """Signed axes that a query of this dimension looks into."""
    return max(PROBES, (1 << max(0, int(dim - 1).bit_length())) // PROBE_SHARE)


def _hashes(tables: int, probes: int | None, seed: int):
    """Buckets of each vector: ``probes`` of them in every table (None: as many
    as its dimension asks for; 0: all)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
                size = lists.value_lengths().to_numpy(zero_copy_only=False)
                for dim in np.unique(size):
                    mine = np.flatnonzero(size == dim)
                    x = lists.take(pa.array(mine)).flatten().to_numpy().reshape(len(mine), dim)
                    for t, signs in enumerate(rotations(int(dim), tables, seed)):
                        y = rotate(x, signs)
                        near = axes(y, probed(int(dim)) if probes is None else probes or 2 * y.shape[1])
                        n = near.shape[1]
                        code = (np.int64(t) << 40) | (np.int64(dim) << 20) | near.astype(np.int64).ravel()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(code), pa.array(np.repeat(ids[mine], n)), lists.take(pa.array(np.repeat(mine, n)))], ["bucket", "id", "v"])
    return run


def search(vectors: DataFrame, queries: Column, k: int = 10, tables: int = TABLES, probes: int | None = None,
           block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score for each vector of ``vectors`` (vec_id,
    embedding) that fulfils ``queries``: its nearest others by Euclidean distance."""
    base = usable(vectors)
    asked = usable(vectors.where(queries))
    schema = "bucket long, id long, v array<double>"
    index = base.mapInArrow(_hashes(tables, 1, seed), schema)
    sizes = stage_table(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "lsh-sizes").select(
        F.col("bucket").alias("_sb"), F.ceil(F.col("n") / block).cast("int").alias("_blocks"))
    stored = index.join(sizes, F.col("bucket") == F.col("_sb")).select(
        "bucket", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int").alias("block"), "id", "v", F.lit(False).alias("asks"))

    def sent(asking: DataFrame, tables: int, probes: int | None) -> DataFrame:
        return asking.mapInArrow(_hashes(tables, probes, seed), schema).join(sizes, F.col("bucket") == F.col("_sb")).select(
            "bucket", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"), "id", "v", F.lit(True).alias("asks"))

    def rank(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False).astype(bool), table.column("id").to_numpy()
        lists = table.column("v")
        dim = len(lists[0])
        x = lists.combine_chunks().flatten().to_numpy().reshape(len(ids), dim)
        ids_p, p = ids[~asks], x[~asks]
        order = np.argsort(ids_p, kind="stable")
        ids_p, p = ids_p[order], p[order]
        out_q, out_p, out_d = [], [], []
        step = max(1, (4 << 20) // max(1, len(p)))  # bounded distance blocks
        norm = (p * p).sum(axis=1)
        firsts = np.flatnonzero(np.concatenate([[True], ids_p[1:] != ids_p[:-1]])) if len(p) else np.zeros(0, np.int64)
        for q_id, q in ((ids[asks][i: i + step], x[asks][i: i + step]) for i in range(0, int(asks.sum()), step)):
            if not len(p):
                break
            # squared distances by one product choose the best; exact ones rank them
            rough = norm[None, :] - 2 * (q @ p.T) + (q * q).sum(axis=1)[:, None]
            slack = 1e-9 * (norm.max() + (q * q).sum(axis=1).max() + 1)
            least = np.minimum.reduceat(rough, firsts, axis=1) if len(firsts) < len(p) else rough  # one place an id
            for qi, vec, row, near in zip(q_id, q, rough, least):
                if len(near) > k + 1:
                    few = np.flatnonzero(row <= np.partition(near, k)[k] + slack)
                else:
                    few = np.arange(len(row))
                few = few[ids_p[few] != qi]
                d = np.sqrt(((p[few] - vec) ** 2).sum(axis=1))
                best = np.lexsort((ids_p[few], d))
                if len(firsts) < len(p):
                    best = best[np.sort(np.unique(ids_p[few][best], return_index=True)[1])]
                best = best[:k]
                out_q.append(np.full(len(best), qi))
                out_p.append(ids_p[few][best])
                out_d.append(d[best])
        cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
        return pa.table({"query_id": cat(out_q, pa.int64()), "vec_id": cat(out_p, pa.int64()), "score": cat(out_d, pa.float64())})

    def ranked(stored: DataFrame, sent: DataFrame) -> DataFrame:
        found = stored.union(sent).groupBy("bucket", "block").applyInArrow(rank, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    best = stage_table(ranked(stored, sent(asked, tables, probes)), "lsh-found")
    full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = stage_table(asked.join(full, "id", "left_anti"), "lsh-short")
    if not short.isEmpty():
        first = stored.where(F.shiftright("bucket", 40) == 0)  # one table holds every vector once
        best = best.union(ranked(first, sent(short, 1, 0))).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
