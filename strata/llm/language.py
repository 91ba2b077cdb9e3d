"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for every language. A text is
parsed greedily into the longest phrases that occur in a language's text;
the language that needs the fewest phrases, normalised by what a phrase
costs (log2 of the language's training length) and by the text's length, wins.

Training is bounded by four parameters: at most ``train_docs`` documents a
language (the first by a seeded hash of the id), of each a piece of
``train_piece`` characters from a seeded place in its whole text, at most
``train_bytes`` bytes of their normalised text a language (every document gives
an equal share), and ``max_langs`` labels (those with the most documents, ties
by name). More than MODEL_BYTES / train_bytes labels share MODEL_BYTES, so the
model's size does not grow with dirty labels; labels beyond ``max_langs`` are
never predicted. Scoring reads whole texts: long ones are parsed in segments of
SEGMENT bytes, all of them.

Defined cases: ``und`` with score 0 for a null text, one without a letter
(digits, fractions, circled and Roman numerals are none), or where nothing
could be learned; ties go to the smaller language name; rows with a null
language are not learned from; repeated rows get equal rows; extra columns
pass through.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import numbered, text_slices

TRAIN_DOCS, TRAIN_PIECE, TRAIN_BYTES, MAX_LANGS, SEGMENT = 200, 2_000, 40_000, 256, 2048
#: Training bytes of all languages together.
MODEL_BYTES = 400_000
#: Bits a byte by which one language must do better for odds of 2 to 1.
SOFTNESS = 0.08
_GAPS = re.compile(r"[\W\d_]+")
#: Numerals that are word characters but neither digits nor letters.
_NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


def normalise(text: str | None) -> bytes:
    """Lower case, with one blank for whatever is no letter."""
    if not text:
        return b""
    letters = _GAPS.sub(" ", text.lower())
    if not letters.isascii() and not _NUMERALS.isdisjoint(letters):
        letters = " ".join("".join(" " if c in _NUMERALS else c for c in letters).split())
    return letters.strip().encode()


class SuffixAutomaton:
    """Suffix automaton of a byte string: ``step`` of each state by byte."""

    def __init__(self, text: bytes):
        self.size = len(text)
        step, link, depth, last = [{}], [-1], [0], 0
        for c in text:
            new = len(step)
            step.append({})
            depth.append(depth[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                if depth[p] + 1 == depth[q]:
                    link[new] = q
                else:
                    twin = len(step)
                    step.append(dict(step[q]))
                    depth.append(depth[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(c) == q:
                        step[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.step = step


class CrossParser:
    """The automata of all languages in one table of state x byte class; a
    missing step leads on from the root with the sign bit set."""

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        autos = [SuffixAutomaton(texts[lang]) for lang in self.langs]
        used = sorted({c for t in texts.values() for c in t})
        self.width = len(used) + 1  # class 0: bytes no language has
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.cost = np.array([np.log2(max(a.size, 2)) for a in autos])
        self.starts, tables, base = [], [], 0
        for a in autos:
            # the last state is no phrase at all: the start, and what follows a byte of no phrase
            none = len(a.step)
            t = np.zeros((none + 1, self.width), np.int64)
            root = np.full(self.width, none, np.int64)
            for c, s in a.step[0].items():
                root[self.classes[c]] = s
            t[:] = root - 2 ** 40  # a phrase ends, the next one starts with this byte
            for s, moves in enumerate(a.step):
                for c, to in moves.items():
                    t[s, self.classes[c]] = to
            missing = t < 0
            t = (np.where(missing, t + 2 ** 40, t) + base) * self.width
            tables.append(np.where(missing, t - 2 ** 31, t).astype(np.int32).ravel())
            self.starts.append((base + none) * self.width)
            base += none + 1
        if base * self.width >= 2 ** 31:
            raise ValueError("train_bytes x languages is too large for one table")
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)

    def phrases(self, docs: list[bytes]) -> np.ndarray:
        """(documents, languages): phrases of each document in each language."""
        own = [(d, t[i: i + SEGMENT]) for d, t in enumerate(docs) for i in range(0, len(t), SEGMENT)]
        own.sort(key=lambda x: -len(x[1]))
        n, langs = len(own), len(self.langs)
        out = np.zeros((len(docs), langs), np.int64)
        if not n or not langs:
            return out
        lengths = np.array([len(t) for _, t in own])
        grid = np.zeros((n, lengths[0]), np.int32)
        for i, (_, t) in enumerate(own):
            grid[i, : len(t)] = self.classes[np.frombuffer(t, np.uint8)]
        grid = np.ascontiguousarray(grid.T)
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        state = np.repeat(np.array(self.starts, np.int32)[:, None], n, 1)
        count = np.zeros((langs, n), np.int32)
        for k in range(lengths[0]):
            m = alive[k]
            s = self.table[state[:, :m] + grid[k, :m]]
            count[:, :m] -= s >> 31
            state[:, :m] = s & 0x7FFFFFFF
        np.add.at(out, np.array([d for d, _ in own]), count.T)
        return out

    def predict(self, docs: list[bytes]) -> list[tuple[str, float]]:
        counts = self.phrases(docs)
        out = []
        for t, c in zip(docs, counts):
            if not t or not self.langs:
                out.append(("und", 0.0))
                continue
            bits = c * self.cost / len(t)
            best = int(bits.argmin())
            out.append((self.langs[best], float(1 / np.exp2((bits[best] - bits) / SOFTNESS).sum())))
        return out


def training_sample(docs: DataFrame, allowed: Column, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES,
                    train_piece: int = TRAIN_PIECE, max_langs: int = MAX_LANGS) -> dict[str, bytes]:
    """Bounded text per language: the window's limit is applied in every task
    before the shuffle, so a language sends train_docs pieces a task at most."""
    labelled = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.col("lang").cast("string").alias("lang"), "text")
    langs = [r["lang"] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).collect()]
    limit = min(train_bytes, max(1, MODEL_BYTES // max(1, len(langs))))
    spare = F.greatest(F.lit(1), F.length("text") - train_piece + 1)
    piece = F.substring("text", F.pmod(F.xxhash64(F.lit(47), "doc_id"), spare).cast("int") + 1, F.lit(train_piece))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64(F.lit(31), "doc_id"), "doc_id", "_t"))
    rows = (labelled.where(F.col("lang").isin(langs)).select("doc_id", "lang", piece.alias("_t"))
            .withColumn("_n", rank).where(F.col("_n") <= train_docs).select("lang", "_n", "_t")
            .groupBy("lang").applyInPandas(lambda pdf: _joined_text(pdf, limit), "lang string, text binary"))
    return {r["lang"]: bytes(r["text"]) for r in rows.collect() if r["text"]}


def _joined_text(pdf, limit: int):
    import pandas as pd
    pieces = [normalise(t) for t in pdf.sort_values("_n")["_t"]]
    pieces = [p for p in pieces if p]
    # an equal share of each document; what short ones leave goes to the others
    parts, left = [], limit
    for k, p in enumerate(sorted(pieces, key=len)):
        parts.append(p[: left // (len(pieces) - k)])
        left -= len(parts[-1]) + 1
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "text": [b" ".join(p for p in parts if p)[:limit]]})


def train(docs: DataFrame, allowed: Column | None = None, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES,
          train_piece: int = TRAIN_PIECE, max_langs: int = MAX_LANGS) -> CrossParser:
    return CrossParser(training_sample(docs, F.lit(True) if allowed is None else allowed, train_docs, train_bytes, train_piece, max_langs))


def identify(docs: DataFrame, model: CrossParser) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and lang_score. The
    model is sent once to each executor; its size is fixed by train_bytes."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = sent.value
        for b in text_slices(batches, "text"):
            found = parser.predict([normalise(t) for t in b.column(names.index("text")).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                [*names, "lang_pred", "lang_score"])

    from pyspark.sql import types as T
    schema = T.StructType([*[f for f in docs.schema.fields if f.name in names],
                           T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.select(*numbered(names)).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Documents kept from training: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))
