"""Helpers shared by the corpus operators: Arrow text access in bounded
slices, and broadcast of frames whose size was measured."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every contract: runs of anything but blanks and the five control
#: blanks (the same set that ``bytes.split()`` splits on).
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
#: A per-group side table (sources, buckets) of at most so many counted rows
#: is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as the small side of a join: broadcast when its counted rows
    are few, left to the planner otherwise."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for (doc_id, text): rows that agree in
    both are one document."""
    none = doc_id.isNull()
    return [F.xxhash64(none, doc_id, text).alias("_k1"), F.xxhash64(F.lit(71), text, none, doc_id).alias("_k2")]


def whole_row(names: list[str]) -> Column:
    """The named columns as one struct, whatever characters the names hold."""
    return F.struct(*[F.col(f"`{c}`") for c in names])


def numbered(names: list[str]) -> list[Column]:
    """The named columns as c0, c1, ... and ``text``: Arrow steps look up
    their input columns by plain names."""
    return [F.col(f"`{c}`").alias("text" if c == "text" else f"c{i}") for i, c in enumerate(names)]


def text_view(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (nulls as empty) without copying:
    the values buffer and the n + 1 offsets into it."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bufs = arr.buffers()
    off = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` text bytes, one row at
    least, so a task's working memory does not follow the batch size. What a
    slice's work has freed goes back to the system: workers are reused, so it
    would add to the memory of the other workers and of later stages."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = text_view(batch.column(batch.schema.get_field_index(column)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
            release_memory()
        del batch
    release_memory()


def release_memory() -> None:
    """Free memory that Arrow's pool and the C library hold is given back."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def byte_strings(arr: pa.Array) -> list[bytes]:
    data, off = text_view(arr)
    raw, bounds = data.tobytes(), off.tolist()
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return byte_strings(batch.column(batch.schema.get_field_index(column)))
