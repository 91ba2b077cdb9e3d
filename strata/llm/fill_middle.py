"""Fill-in-the-middle transformation with content-defined chunk memoization.

A text is cut into chunks where a rolling hash of its last 32 bytes has ten
zero bits, so a passage that many documents share gives the same chunks in
all of them wherever it starts. A chunk's summary is its number of code
points, whether a sentinel lies inside, and its first and last two bytes.
Summaries are kept in a cache of bounded bytes by the chunk's 64-bit hash; a
hit counts only if the kept bytes are equal. Summaries combine from left to
right: the counts add up to the length of the text, the two bytes on each
side of a border show a sentinel that straddles it, and the running counts
find the chunk in which a cut lies, so that only this chunk is scanned for
the cut's byte.

Where a document is cut, and its form, follow from the sha256 of
``seed:doc_id`` alone, so every run agrees.

Defined cases: a null text is the empty text; a text that is empty or holds a
sentinel stays plain; a null doc_id is hashed as the empty text; rows that
agree in doc_id and text give the same result, each row its own; an empty
table gives an empty result; extra columns pass through, columns of the
result replace equal names of the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices, text_view, whole_row

SEED, PLAIN_SHARE, SUFFIX_FIRST_SHARE = 1, 10, 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Rolling hash: window in bytes, zero bits at a border, least and largest chunk.
WINDOW, BORDER_BITS, LEAST, LARGEST = 32, 10, 64, 1 << 16
#: Bytes kept by a task's cache, chunks and their entries (about so many bytes
#: each beside the chunk); a full cache starts anew.
CACHE_BYTES, ENTRY_BYTES = 32 << 20, 400
#: Bytes of text that are hashed together: the hashes take twelve times as much.
HASH_SLICE = 1 << 20
CONTINUATION = bytes(range(0x80, 0xC0))
_GEAR = np.random.default_rng(13).integers(0, 1 << 32, 256, dtype=np.uint32)


def borders(data: np.ndarray) -> np.ndarray:
    """Ends of possible chunks: positions after a byte where the hash of the
    last WINDOW bytes has its low bits zero."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:  # h covers `step` bytes; twice as many after this
        wider = h.copy()
        wider[step:] += h[:-step] << np.uint32(step) if step < len(h) else 0
        h, step = wider, 2 * step
    return np.flatnonzero((h >> np.uint32(32 - BORDER_BITS)) == 0) + 1


def chunk_bounds(raw: bytes, start: int, end: int, candidates: list[int]) -> list[int]:
    """Bounds of the chunks of raw[start:end] from the candidates inside it.
    A border that would split a code point moves to the code point's end."""
    out = [start]
    for c in candidates:
        while c < end and 0x80 <= raw[c] < 0xC0:
            c += 1
        if c - out[-1] >= LEAST and c < end:
            out.append(c)
    out.append(end)
    if max(b - a for a, b in zip(out, out[1:])) <= LARGEST:
        return out
    wide, out = out, [start]
    for z in wide[1:]:
        while z - out[-1] > LARGEST:
            c = out[-1] + LARGEST
            while c < z and 0x80 <= raw[c] < 0xC0:
                c += 1
            if c == z:
                break
            out.append(c)
        out.append(z)
    return out


def summarise(chunk: bytes) -> tuple[int, bool, bytes, bytes]:
    """(code points, holds a sentinel, first two bytes, last two bytes)"""
    return len(chunk.translate(None, CONTINUATION)), any(s in chunk for s in SENTINELS), chunk[:2], chunk[-2:]


class ChunkCache:
    """Summaries of chunks by content."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.limit, self.used, self.hits, self.misses = limit, 0, 0, 0
        self.kept: dict[int, tuple[bytes, tuple]] = {}

    def summary(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        key = xxhash.xxh3_64_intdigest(chunk)
        found = self.kept.get(key)
        if found is not None and found[0] == chunk:
            self.hits += 1
            return found[1]
        self.misses += 1
        out = summarise(chunk)
        if found is None:  # a chunk that only shares another one's hash is not kept
            if self.used + len(chunk) + ENTRY_BYTES > self.limit:
                self.kept.clear()
                self.used = 0
            self.kept[key] = (chunk, out)
            self.used += len(chunk) + ENTRY_BYTES
        return out


class Combined:
    """A text's summary, from its chunks' ones."""

    def __init__(self, raw: bytes, bounds: list[int], cache: ChunkCache):
        self.raw, self.bounds, self.upto, self.sentinel = raw, bounds, [0], False
        tail = b""
        for a, b in zip(bounds, bounds[1:]):
            points, inside, head, last = cache.summary(raw[a:b])
            joint = tail + head
            self.sentinel = self.sentinel or inside or any(s in joint for s in SENTINELS)
            tail = (tail + last)[-2:]
            self.upto.append(self.upto[-1] + points)
        self.points = self.upto[-1]

    def byte_at(self, point: int) -> int:
        """The byte where code point number ``point`` starts."""
        if point >= self.points:
            return self.bounds[-1]
        i = int(np.searchsorted(self.upto, point, side="right")) - 1
        a, b = self.bounds[i], self.bounds[i + 1]
        if self.upto[i + 1] - self.upto[i] == b - a:  # one byte a code point
            return a + point - self.upto[i]
        starts = np.flatnonzero((np.frombuffer(self.raw, np.uint8, b - a, a) & 0xC0) != 0x80)
        return a + int(starts[point - self.upto[i]])


def choices(doc_id, n: int, seed: int) -> tuple[int, int, int, int]:
    """(first cut, second cut, plain draw, order draw) of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    h = [int.from_bytes(digest[i: i + 4]) for i in (0, 4, 8, 12)]
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    return min(one, two), max(one, two), h[2] % 100, h[3] % 100


def rearrange(doc_id, whole: Combined, seed: int = SEED) -> tuple[str, int | None, int | None, bytes]:
    """(form, prefix length, middle length, text) of a document."""
    raw = whole.raw[whole.bounds[0]: whole.bounds[-1]]
    first, second, plain, order = choices(doc_id, whole.points, seed)
    if not raw or whole.sentinel or plain >= 100 - PLAIN_SHARE:
        return "plain", None, None, raw
    a, b = whole.byte_at(first) - whole.bounds[0], whole.byte_at(second) - whole.bounds[0]
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    if order < SUFFIX_FIRST_SHARE:
        return "spm", first, second - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return "psm", first, second - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


RESULT = ["n", "form", "prefix_chars", "middle_chars", "output"]


def transform(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` (but text) with n (code points), form,
    prefix_chars, middle_chars and output. One pass without a shuffle; the
    cache is a task's own, so a task that is run again gives the same rows."""
    rest = [c for c in docs.columns if c != "text" and c not in RESULT]
    rows = docs.select(whole_row(rest).alias("row"), F.col("doc_id").cast("string").alias("id"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = ChunkCache()
        for b in text_slices(batches, "text", HASH_SLICE):
            data, off = text_view(b.column(2))
            raw, bounds, ends = data.tobytes(), off.tolist(), borders(data)
            at = np.searchsorted(ends, off + WINDOW).tolist()  # a window lies inside its text
            out = []
            for doc_id, i, j, s, e in zip(b.column(1).to_pylist(), at, np.searchsorted(ends, off).tolist()[1:], bounds, bounds[1:]):
                whole = Combined(raw, chunk_bounds(raw, s, e, ends[i:j].tolist()), cache)
                out.append((whole.points, *rearrange(doc_id, whole, seed)))
            n, form, prefix, middle, texts = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string(), safe=False)], ["row", *RESULT])

    schema = (T.StructType([rows.schema["row"]]).add("n", "long").add("form", "string")
              .add("prefix_chars", "long").add("middle_chars", "long").add("output", "string"))
    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], *RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. A rearranged text holds no
    sentinel of its own, so each sentinel is found once. The parts are cut as
    bytes, without a pattern and without decoding the text."""
    head, middle = F.substring_index(output, "<M>", 1), F.substring_index(output, "<M>", -1)

    def first(mark):  # from behind the first sentinel up to this one
        return F.substring(F.substring_index(head, mark, 1), len(PREFIX) + 1, 2 ** 31 - 1)
    return (F.when(form == "psm", F.concat(first("<S>"), middle, F.substring_index(head, "<S>", -1)))
            .when(form == "spm", F.concat(F.substring_index(head, "<P>", -1), middle, first("<P>"))).otherwise(output))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, length(t)::BIGINT AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2,
      ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
           WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
