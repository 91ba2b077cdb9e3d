"""Removal of repeated byte strings with enhanced suffix arrays.

Every ``length``-byte string that also starts in a document with a smaller
id is removed, judged on the input. Equal strings have equal minimizers (the
smallest hash of their k-byte grams), so a corpus is cut into runs of string
starts with one minimizer, and the minimizer deals the runs to shards:

1. runs with a minimizer that occurs in more than one document are found
   from hashes alone;
2. only for those, the texts' fragments are sent to their shard (equal
   fragments of a bucket once);
3. a shard sorts the string starts of its fragments into a suffix array with
   longest common prefixes, skips starts whose whole group extends to the
   left, and scans the rest with a stack into the tree of common-prefix
   intervals. Each interval is a maximal repeat with all its occurrences:
   those in documents beyond the smallest are marked, for the repeat's length;
4. the marks are merged per document and cut out.

Texts are shuffled once (both uses share the exchange), by a hash of id and
text, so no group or passage gathers them. Defined cases: a null text is
empty; a null id is smaller than any other; rows with one id never remove
from each other, and rows that agree in id and text get equal results;
documents shorter than ``length`` are untouched; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, row_key, text_slices, text_view

LENGTH, GRAM, MAX_RUN = 50, 16, 64
#: A shard's fragments are sorted in so many parts, by minimizer, one at a time.
PARTS = 16
NO_ID = np.int64(-(2 ** 63))
#: Bytes of text that one bucket or one slice of work holds at a time.
SLICE = 2 << 20
#: Bytes of text that a group of rows has on average at most.
GROUP_BYTES = 32 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob, byte planes apart (high bytes are mostly zero)."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T) for a in arrays]
    return zstandard.compress(b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *[p.tobytes() for p in planes]]), 1)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    blob = zstandard.decompress(blob)
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(blob, "<i8", len(kinds)).tolist(), map(np.dtype, kinds)):
        planes = np.frombuffer(blob, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(-1))
        at += n * kind.itemsize
    return out


def unpack_all(blobs: list[bytes], *kinds: str) -> tuple[list[np.ndarray], list[list[int]]]:
    """All blobs' arrays one after the other, and each array's sizes."""
    parts = [unpack(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)], [
        [len(p[i]) for p in parts] for i in range(len(kinds))]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of the 16-byte grams that start at every byte."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(data)
    low = np.ndarray((n,), "<u8", raw, 0, (1,)).astype(np.uint64)
    high = np.ndarray((n,), "<u8", raw, 8, (1,)).astype(np.uint64)
    h = low * np.uint64(0x9E3779B97F4A7C15) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(7)) ^ (high * np.uint64(0x165667B19E3779F9))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    return h


def minimizers(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every start of a ``length``-byte string: the smallest gram hash in it."""
    m, width, want = gram_hashes(data), 1, length - GRAM + 1
    while 2 * width <= want:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < want:
        m = np.minimum(m[: len(m) - (want - width)], m[want - width:])
    return m


def runs(data: np.ndarray, off: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first start, number of starts, minimizer) of every run."""
    m = minimizers(data, length)
    last = off[1:] - length + 1  # one past the last start of a document
    ok = last > off[:-1]
    if not ok.any() or len(m) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    step = np.zeros(len(m) + 1, np.int64)
    np.add.at(step, off[:-1][ok], 1)
    np.add.at(step, last[ok], -1)
    valid = np.cumsum(step[:-1]) > 0
    new = valid.copy()
    new[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
    new[off[:-1][ok]] = True
    first = np.flatnonzero(new)
    doc = np.searchsorted(off, first, side="right") - 1
    end = np.minimum(np.concatenate([first[1:], [len(m)]]), last[doc])
    n = end - first
    many = np.maximum(1, -(-n // MAX_RUN))  # periodic text: long runs in parts
    part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(first, many) + part * MAX_RUN
    return (np.repeat(doc, many), at - off[np.repeat(doc, many)], np.minimum(np.repeat(end, many) - at, MAX_RUN), m[np.repeat(first, many)])


def _by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, positions) for every different key."""
    if len(keys) == 0:
        return
    order = np.argsort(keys, kind="stable")
    x = keys[order]
    cuts = np.flatnonzero(x[1:] != x[:-1]) + 1
    for part in np.split(order, cuts):
        yield int(keys[part[0]]), part


# --------------------------------------------------------------------------
# step 1: minimizers that occur in more than one document
# --------------------------------------------------------------------------
SENT = ("<i8", "<u4", "<u4", "<u4", "u1")  # document keys, runs of each, minimizer, start, starts


def _send_runs(shards: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "text", SLICE):
            data, off = text_view(b.column(b.schema.get_field_index("text")))
            keys = b.column(0).to_numpy(zero_copy_only=False)
            doc, start, n, m = runs(data, off, length)
            shard = (m % np.uint64(shards)).astype(np.int64)
            rest = (m // np.uint64(shards)).astype(np.uint32)
            names, blobs = [], []
            for s, i in _by(shard):
                d, count = np.unique(doc[i], return_counts=True)
                names.append(s)
                blobs.append(pack(keys[d], count.astype("<u4"), rest[i], start[i].astype("<u4"), n[i].astype("u1")))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])
    return run


FOUND = ("<i8", "<u4", "<i4", "u1", "<u4", "u1")  # document keys, runs of each, shard, part, start, starts


def _find_repeats(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        (keys, count, m, start, n), _ = unpack_all(table.column("blob").to_pylist(), *SENT)
        who = np.repeat(keys, count)
        order = np.argsort(m, kind="stable")
        x, y = m[order], who[order]
        begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        several = np.minimum.reduceat(y, begin) != np.maximum.reduceat(y, begin)
        i = order[np.repeat(several, np.diff(np.append(begin, len(x))))]
        names, blobs = [], []
        for bucket, j in _by(who[i] % buckets):
            k = i[j]
            k = k[np.lexsort((start[k], who[k]))]
            key, many = np.unique(who[k], return_counts=True)
            names.append(bucket)
            blobs.append(pack(key, many.astype("<u4"), np.full(len(k), shard, "<i4"), (m[k] % PARTS).astype("u1"), start[k], n[k]))
        return pa.table([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
    return run


# --------------------------------------------------------------------------
# step 2: their fragments
# --------------------------------------------------------------------------
def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] values, and so on."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


#: Fragments: size, part, bytes. Occurrences: fragment, doc_id, bucket, the key's rank in it, start.
CUT = ("<u2", "u1", "u1", "<u4", "<i8", "<i4", "<u4", "<u4")


def _documents(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, off = text_view(table.column("text"))
    ids = table.column("doc_id").combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
    return data, off, ids, table.column("key").to_numpy()


def _cut_fragments(length: int):
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        names, blobs = [], []
        if docs.num_rows and found.num_rows:
            data, off, ids, keys = _documents(docs)
            (key, many, shard, part, start, n), _ = unpack_all(found.column("blob").to_pylist(), *FOUND)
            bucket = found.column("bucket")[0].as_py()
            distinct, row = np.unique(keys, return_index=True)
            rank = np.repeat(np.searchsorted(distinct, key), many)
            doc = row[rank]
            from .quality import _spans_hash
            a = off[doc] + start
            size = n.astype(np.int64) + length - 1
            h = np.empty(len(a), np.uint64)
            by_place = np.argsort(a, kind="stable")
            lo = 0
            while lo < len(a):  # hash a bounded stretch of text at a time
                begin = a[by_place[lo]]
                hi = int(np.searchsorted(a[by_place], begin + SLICE, side="right"))
                own = by_place[lo:hi]
                stretch = data[begin: int((a[own] + size[own]).max())]
                h[own] = _spans_hash(stretch, a[own] - begin, a[own] + size[own] - begin)
                lo = hi
            for s, i in _by(shard):
                _, first, which = np.unique(h[i], return_index=True, return_inverse=True)
                f = i[first]
                names.append(s)
                blobs.append(pack(size[f].astype("<u2"), part[f], data[_ranges(a[f], size[f])], which.astype("<u4"), ids[doc[i]],
                                  np.full(len(i), bucket, "<i4"), rank[i].astype("<u4"), start[i]))
        return pa.table([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])
    return run


# --------------------------------------------------------------------------
# step 3: suffix array, common prefixes, interval tree
# --------------------------------------------------------------------------
def _words(data: np.ndarray, at: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 7 of strings that start at ``at``, zero past their size,
    as numbers in byte order. ``data`` has spare bytes at its end."""
    w = np.ndarray((len(data) - 7,), ">u8", data, 0, (1,))[at + 8 * k].astype(np.uint64)
    left = np.clip(size - 8 * k, 0, 8)
    drop = np.minimum((8 - left) * 8, 63).astype(np.uint64)
    w = (w >> drop) << drop
    return np.where(left == 0, np.uint64(0), w)


def interval_tree(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """Stack scan of the common prefixes lcp[i] of neighbours i, i + 1: every
    interval (first, last, length) of neighbours that share ``length`` bytes
    and no more, from ``least`` bytes on."""
    out, stack = [], []  # (length, first)
    for i, n in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > n:
            length, first = stack.pop()
            out.append((first, i, length))
        if n >= least and (not stack or stack[-1][0] < n):
            stack.append((n, first))
    return out


def maximal_repeats(data: np.ndarray, at: np.ndarray, size: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(member offsets, members, lengths) of the repeats among the strings
    that start at ``at`` with ``size`` bytes. left: the byte before each, or a
    value of its own where it isn't known. Strings whose group of equal
    ``length``-byte prefixes has one left byte are skipped: the group one byte
    to the left has the same members and covers them."""
    data = np.concatenate([data, np.zeros(MAX_RUN + length + 16, np.uint8)])
    head = np.minimum(size, length)
    words = [_words(data, at, head, k) for k in range(-(-length // 8))]
    order = np.lexsort(words[::-1])
    differ = np.ones(len(order), bool)
    differ[1:] = False
    for w in words:
        x = w[order]
        differ[1:] |= x[1:] != x[:-1]
    begin = np.flatnonzero(differ)
    count = np.diff(np.append(begin, len(order)))
    x = left[order]
    diverse = (count > 1) & (np.minimum.reduceat(x, begin) != np.maximum.reduceat(x, begin))
    group = np.repeat(np.cumsum(diverse) - 1, count)
    keep = np.repeat(diverse, count)
    own, group = order[keep], group[keep]
    if len(own) == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(1, np.int64), z, z
    # the same order beyond the first bytes, and the common prefixes
    longest = int(size[own].max())
    words = [_words(data, at[own], size[own], k) for k in range(-(-longest // 8))]
    order = np.lexsort([size[own], *words[::-1], group])
    own, group = own[order], group[order]
    common = np.zeros(len(own) - 1, np.int64)
    same = np.ones(len(own) - 1, bool)
    for w in words:
        w = w[order]
        diff = w[1:] ^ w[:-1]
        # equal leading bytes of a word
        lead = sum(((diff >> np.uint64(8 * (7 - k))) == 0).astype(np.int64) for k in range(8))
        common += np.where(same, lead, 0)
        same &= diff == 0
    common = np.minimum(common, np.minimum(size[own][1:], size[own][:-1]))
    common[group[1:] != group[:-1]] = 0
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    stop = np.append(begin[1:], len(own))
    firsts, lasts, lengths = [], [], []
    pairs = stop - begin == 2
    firsts.append(begin[pairs])
    lasts.append(begin[pairs] + 1)
    lengths.append(common[begin[pairs]])
    nodes = [(lo + f, lo + z, n) for lo, hi in zip(begin[~pairs].tolist(), stop[~pairs].tolist())
             for f, z, n in interval_tree(common[lo: hi - 1].tolist(), length)]
    if nodes:
        f, z, n = np.array(nodes, np.int64).T
        firsts.append(f)
        lasts.append(z)
        lengths.append(n)
    f, z, n = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(lengths)
    many = z - f + 1
    return np.concatenate([[0], np.cumsum(many)]), own[_ranges(f, many)], n


def _mark_repeats(length: int):
    def run(table: pa.Table) -> pa.Table:
        (size, part, data, which, ids, bucket, rank, start), sizes = unpack_all(table.column("blob").to_pylist(), *CUT)
        size = size.astype(np.int64)
        which = which.astype(np.int64) + np.repeat(np.cumsum([0, *sizes[0][:-1]]), sizes[3])
        place = np.cumsum(size) - size
        found: dict[int, list] = {}
        for _, own in _by(part):
            local = np.full(len(size), -1)
            local[own] = np.arange(len(own))
            occ = np.flatnonzero(local[which] >= 0)
            at, length_of = place[own], size[own]
            own_data = data[_ranges(at, length_of)]
            o, a, z = _marks_of(own_data, length_of, local[which[occ]], ids[occ], start[occ], length)
            o = occ[o]
            # a document's marks from one start: the longest is enough
            by = np.lexsort((-z, a, rank[o], bucket[o]))
            o, a, z = o[by], a[by], z[by]
            once = np.ones(len(o), bool)
            once[1:] = (bucket[o[1:]] != bucket[o[:-1]]) | (rank[o[1:]] != rank[o[:-1]]) | (a[1:] != a[:-1])
            o, a, z = o[once], a[once], z[once]
            for to, i in _by(bucket[o]):
                found.setdefault(to, []).append((rank[o[i]], a[i].astype("<u4"), (z - a)[i].astype("<u4")))
        names, blobs = list(found), [pack(*map(np.concatenate, zip(*x))) for x in found.values()]
        return pa.table([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])
    return run


def _marks_of(data: np.ndarray, size: np.ndarray, which: np.ndarray, ids: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(occurrence, first byte, end) of every repeat in an occurrence (of
    fragment ``which`` in document ``ids``) that is not in the smallest document."""
    from .quality import _spans_hash
    place = np.cumsum(size) - size
    # equal fragments of different buckets become one
    h = np.empty(len(size), np.uint64)
    lo = 0
    while lo < len(size):
        hi = int(np.searchsorted(place, place[lo] + SLICE, side="right"))
        h[lo:hi] = _spans_hash(data[place[lo]: place[hi - 1] + size[hi - 1]], place[lo:hi] - place[lo], place[lo:hi] - place[lo] + size[lo:hi])
        lo = hi
    _, first, one = np.unique(h, return_index=True, return_inverse=True)
    which, size, place = one[which], size[first], place[first]
    smallest = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, ids)
    starts = size - length + 1
    fragment = np.repeat(np.arange(len(size)), starts)
    shift = np.arange(len(fragment)) - np.repeat(np.cumsum(starts) - starts, starts)
    at = place[fragment] + shift
    left = np.where(shift > 0, data[np.maximum(at - 1, 0)].astype(np.int64), 256 + np.arange(len(at)))
    bounds, members, lengths = maximal_repeats(data, at, size[fragment] - shift, left, length)
    # a fragment that several documents have is a leaf of the tree: a repeat
    # of its whole length, which marks all but its smallest document's
    # occurrences; only those can still gain from the inner intervals
    whole = np.flatnonzero(ids > smallest[which])
    begin = start[whole].astype(np.int64)
    marks = [(whole, begin, begin + size[which[whole]])]
    if len(members):
        node = np.repeat(np.arange(len(lengths)), np.diff(bounds))
        f = fragment[members]
        late = smallest[f] > np.minimum.reduceat(smallest[f], bounds[:-1])[node]
        members, node, f = members[late], node[late], f[late]
        first = np.flatnonzero(ids == smallest[which])
        first = first[np.argsort(which[first], kind="stable")]
        many = np.bincount(which[first], minlength=len(size))
        occ = first[_ranges((np.cumsum(many) - many)[f], many[f])]
        back = np.repeat(np.arange(len(members)), many[f])
        begin = start[occ].astype(np.int64) + shift[members[back]]
        marks.append((occ, begin, begin + lengths[node[back]]))
    return tuple(np.concatenate(x) for x in zip(*marks))


# --------------------------------------------------------------------------
# step 4: cut
# --------------------------------------------------------------------------
RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_SPANS = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _cut_marks(docs: pa.Table, marks: pa.Table) -> pa.Table:
    docs = docs.combine_chunks()
    keys = docs.column("key").to_numpy()
    _, rank_of = np.unique(keys, return_inverse=True)  # rows that agree in id and text all get the marks
    if marks.num_rows:
        (rank, a, n), _ = unpack_all(marks.column("blob").to_pylist(), "<u4", "<u4", "<u4")
    else:
        rank = a = n = np.zeros(0, np.int64)
    order = np.argsort(rank, kind="stable")
    rank, a, n = rank[order].astype(np.int64), a[order].astype(np.int64), n[order].astype(np.int64)
    lo, hi = np.searchsorted(rank, rank_of), np.searchsorted(rank, rank_of, side="right")
    out, at = [], 0
    for batch in docs.to_batches():
        for part in text_slices(iter([batch]), "text", SLICE):
            i = np.arange(at, at + part.num_rows)
            at += part.num_rows
            mark = _ranges(lo[i], hi[i] - lo[i])
            data, off = text_view(part.column(part.schema.get_field_index("text")))
            begin = np.repeat(off[:-1], hi[i] - lo[i]) + a[mark]
            out.append(_cut(part.column(part.schema.get_field_index("doc_id")), data, off, begin, begin + n[mark]))
    return pa.Table.from_batches(out, out[0].schema) if out else pa.table([pa.array([], f.type) for f in _KEPT], schema=_KEPT)


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(_SPANS)), ("kept", pa.binary())])


def _cut(ids: pa.Array, data: np.ndarray, off: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, end, -1)
    gone = np.cumsum(step[:-1], dtype=np.int32) > 0
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    prev = np.concatenate([[False], gone[:-1]]) & ~edge[:-1]
    nxt = np.concatenate([gone[1:], [False]]) & ~edge[1:] if len(data) else gone
    first, last = np.flatnonzero(gone & ~prev), np.flatnonzero(gone & ~nxt) + 1
    begin = off[np.searchsorted(off, first, side="right") - 1]
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(first, off).astype(np.int32)), pa.StructArray.from_arrays(
        [pa.array(first - begin, pa.int64()), pa.array(last - begin, pa.int64())], fields=list(_SPANS)))
    total = np.concatenate([[0], np.cumsum(~gone)])
    kept = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(total[off].astype(np.int64)), pa.py_buffer(data[~gone])])
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(off)), spans, kept.cast(pa.binary())], schema=_KEPT)


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, spans (removed, in bytes) and kept (remaining bytes) of every row."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} bytes or more")
    # a group holds about GROUP_BYTES of text, however many shuffle partitions are set
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // GROUP_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).select(
        "doc_id", row_key(F.col("doc_id"), F.col("text"))[0].alias("key"), "text")
    rows = rows.withColumn("bucket", F.pmod("key", F.lit(n)).cast("int"))
    sent = rows.select("key", "text").mapInArrow(_send_runs(n, length), "shard int, blob binary")
    found = sent.groupBy("shard").applyInArrow(_find_repeats(n), "bucket int, blob binary")
    cut = rows.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_cut_fragments(length), "shard int, blob binary")
    marks = cut.groupBy("shard").applyInArrow(_mark_repeats(length), "bucket int, blob binary")
    return rows.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_cut_marks, RESULT)
