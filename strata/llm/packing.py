"""Packing token ids into fixed-length sequences by cutting-stock column
generation.

Every document is tokenised once, ends with an end id and is cut at places
that depend on its length alone: whole sequences first, then one piece whose
length is a multiple of ``grain``, then a tail shorter than ``grain``. So the
pieces have at most capacity/grain + grain - 1 different lengths, and their
counts (one row a length) describe the whole corpus. A linear program over
patterns (how many pieces of each length share a sequence) is solved by
column generation: a knapsack by dynamic programming prices the next pattern.
The patterns are rounded down, the small rest is filled greedily, and every
piece finds its place from its rank among the pieces of its length.

Defined cases: a null or empty text has the end id alone; each row is a
document of its own, repeated rows included; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stage_table
from .common import byte_strings, sized, text_slices

CAPACITY, GRAIN, END_ID = 4096, 64, 2
#: Words and pieces of words kept with their ids in a worker, and the longest
#: ones kept; a full memory starts anew.
CACHE_WORDS, CACHE_PIECES, CACHE_WORD_BYTES = 500_000, 300_000, 64
#: Bytes of text whose words are told apart together.
TOKEN_SLICE = 4 << 20


# --------------------------------------------------------------------------
# tokens
# --------------------------------------------------------------------------
def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class PieceIds(dict):
    """Ids (little-endian, four bytes each) of the lower-case pieces that the
    tokenizer's pattern cuts words into."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model = tokenizer.model
        self.ids = [packed([i]) for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, piece: bytes) -> bytes:
        # bytes without a sign of their own have a stand-in in the vocabulary
        text = piece.decode() if piece.isalnum() else "".join(map(STAND_INS.__getitem__, piece))
        ids = self.ids
        ids = b"".join([ids[t.id] for t in self.model.tokenize(text)])
        if len(piece) <= CACHE_WORD_BYTES:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class WordIds(dict):
    """Ids of words by the words' bytes. The tokenizer drops white space and
    never joins across it, so the ids of a text are those of its words, and
    each different word is encoded once."""

    #: Fixed value: the tokenizer's own split pattern, for ASCII text.
    PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = PieceIds(self.tokenizer)
        self.end = packed([END_ID])

    def encode(self, word: bytes) -> bytes:
        if word.isascii() and b"<|" not in word:
            low, pieces = word.lower(), self.pieces
            if low.isalpha():  # a word of letters is one piece
                return pieces[low]
            if low[-1:] in b".,;:!?" and low[:-1].isalpha():
                return pieces[low[:-1]] + pieces[low[-1:]]
            return b"".join([pieces[p] for p in self.PIECES.findall(low)])
        text = word.decode("utf-8", "replace")
        if "<|" not in text and LATIN.match(text):
            return b"".join([self.pieces[p.encode()] for p in LATIN_PIECES.findall(unicodedata.normalize("NFC", text).lower())])
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encode(word)
        if len(word) <= CACHE_WORD_BYTES:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def documents(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, with the end id. Words are cut and told apart
        by Arrow; the ids of a slice's different words are looked up and then
        taken in the order of the words, which joins them."""
        texts = texts.fill_null("")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)  # the tokenizer does so; special tokens are as written
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        known = pa.array(list(map(self.__getitem__, byte_strings(words.dictionary))), pa.large_binary())
        taken = known.take(words.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset: taken.offset + len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
        bounds = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])].tolist()
        data = taken.buffers()[2].to_pybytes() if len(taken) and taken.buffers()[2] is not None else b""
        return [data[a:z] + self.end for a, z in zip(bounds, bounds[1:])]


#: Latin letters, marks and signs whose classes and lower case are the same everywhere.
LATIN = re.compile("[\x21-\x7e\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-įı-ž ]*$")
LATIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xc0-\xd6\xd8-\xf6\xf8-ž]+|[0-9]|[^\\s0-9a-z\xc0-\xd6\xd8-\xf6\xf8-ž]+", re.ASCII)


def _byte_chars() -> dict[int, int]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable
    bytes stand for themselves, the others for code points from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()
STAND_INS = [chr(BYTE_CHARS.get(b, b)) for b in range(256)]
_WORKER: dict[str, WordIds] = {}


def cut_points(tokens: np.ndarray, capacity: int = CAPACITY, grain: int = GRAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of every piece of documents of so many ids."""
    full, rest = tokens // capacity, tokens % capacity
    main, tail = rest // grain * grain, rest % grain
    n = full + (main > 0) + (tail > 0)
    doc = np.repeat(np.arange(len(tokens)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    f, m, t = full[doc], main[doc], tail[doc]
    length = np.where(k < f, capacity, np.where((k == f) & (m > 0), m, t))
    start = np.where(k <= f, k * capacity, f * capacity + m)
    return doc, start, length


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, _part long, _k long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece, with its number _k among this task's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORKER.get(tokenizer) or _WORKER.setdefault(tokenizer, WordIds(tokenizer))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in text_slices(batches, "text", TOKEN_SLICE):
            texts = words.documents(b.column(1))
            tokens = np.array([len(t) for t in texts], np.int64) // 4
            doc, start, length = cut_points(tokens, capacity, grain)
            order = np.argsort(length, kind="stable")
            sorted_len = length[order]
            first = np.searchsorted(sorted_len, sorted_len)
            k = np.empty(len(length), np.int64)
            k[order] = np.arange(len(length)) - first + seen[sorted_len]
            seen += np.bincount(length, minlength=capacity + 1)
            pieces = [texts[d][a:z] for d, a, z in zip(doc.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist())]
            crc = list(map(zlib.crc32, pieces))
            cols = [b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                    pa.array(tokens[doc]), pa.array(np.full(len(doc), part, np.int64)), pa.array(k)]
            names = [c.split()[0] for c in PIECES.split(", ")]
            if with_ids:
                flat = np.frombuffer(b"".join(pieces), "<u4").astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        run, PIECES + (", ids array<int>" if with_ids else ""))


# --------------------------------------------------------------------------
# patterns
# --------------------------------------------------------------------------
def best_pattern(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming over capacities."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        fits = lengths <= c
        gain = np.where(fits, best[np.where(fits, c - lengths, 0)] + value, -1.0)
        i = int(gain.argmax())
        if gain[i] > best[c - 1]:
            best[c], took[c] = gain[i], i
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(lengths), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= lengths[took[c]]
    return float(best[capacity]), pattern


def column_generation(lengths: list[int], demand: list[int], capacity: int) -> list[tuple[int, np.ndarray]]:
    """(times, pieces of each length) that use up the demand exactly: the
    linear program's patterns rounded down, then greedy ones for the rest."""
    ls, need = np.array(lengths, np.int64), np.array(demand, float)
    m = len(ls)
    if m == 0:
        return []
    basis = np.diag(capacity // ls).astype(float)
    x = need / np.diag(basis)
    for _ in range(40 * m + 100):
        value = np.linalg.solve(basis.T, np.ones(m))
        gain, pattern = best_pattern(ls, value, capacity)
        if gain <= 1 + 1e-9:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        usable = step > 1e-9
        ratio = np.where(usable, x / np.where(usable, step, 1.0), np.inf)
        leave = int(ratio.argmin())
        basis[:, leave] = pattern
        x = np.maximum(np.linalg.solve(basis, need), 0)
    times = np.floor(x + 1e-6).astype(np.int64)
    rest = np.array(demand, np.int64)
    plan = []
    for t, col in zip(times, basis.T.round().astype(np.int64)):
        while t > 0 and (rest < t * col).any():
            t -= 1
        if t > 0:
            plan.append((int(t), col))
            rest = rest - t * col
    order = np.argsort(-ls)
    while rest.sum():
        room, col = capacity, np.zeros(m, np.int64)
        for i in order:
            col[i] = min(rest[i], room // ls[i])
            room -= col[i] * ls[i]
        t = int(min(rest[i] // col[i] for i in range(m) if col[i]))
        plan.append((t, col))
        rest = rest - t * col
    return plan


def slots(histogram: dict[int, int], capacity: int = CAPACITY, grain: int = GRAIN) -> list[tuple]:
    """(length, from rank, to rank, pieces a sequence, first sequence, first
    offset): where the pieces of each length go."""
    out, taken, sequence = [], dict.fromkeys(histogram, 0), 0
    for group in ([n for n in histogram if n % grain == 0], [n for n in histogram if n % grain]):
        unit = grain if group and group[0] % grain == 0 else 1
        group = sorted(group, reverse=True)
        for times, pattern in column_generation([n // unit for n in group], [histogram[n] for n in group], capacity // unit):
            offset = 0
            for n, per in zip(group, pattern.tolist()):
                if per:
                    out.append((n, taken[n], taken[n] + times * per, per, sequence, offset))
                    taken[n] += times * per
                    offset += per * n
            sequence += times
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (and ids). The histogram that reaches the driver has
    at most capacity/grain + grain - 1 rows; pieces are ranked by (task, number in
    the task), with one offset row per task and length."""
    if capacity % grain:
        raise ValueError("capacity must be a multiple of grain")
    spark = docs.sparkSession
    pieces = stage_table(token_pieces(docs, tokenizer, capacity, grain, with_ids), "pack-pieces")
    counts = stage_table(pieces.groupBy(F.col("length").alias("_len"), F.col("_part").alias("_p"))
                         .agg(F.count(F.lit(1)).alias("_n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("_len").agg(F.sum("_n")).collect()}
    before = F.sum("_n").over(W.partitionBy("_len").orderBy("_p").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n")
    offsets = sized(counts.select("_len", "_p", before.alias("_before")), counts.count())
    plan = spark.createDataFrame(slots(histogram, capacity, grain),
                                 "_sl long, _from long, _to long, _per long, _seq long, _at long")
    ranked = pieces.join(offsets, (F.col("length") == F.col("_len")) & (F.col("_part") == F.col("_p"))).withColumn(
        "_rank", F.col("_before") + F.col("_k"))
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_sl")) & (F.col("_rank") >= F.col("_from"))
                         & (F.col("_rank") < F.col("_to")))
    j = F.col("_rank") - F.col("_from")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                         (F.col("_seq") + F.floor(j / F.col("_per"))).cast("long").alias("sequence_id"),
                         (F.col("_at") + j % F.col("_per") * F.col("length")).cast("long").alias("offset"),
                         *(["ids"] if with_ids else []))
