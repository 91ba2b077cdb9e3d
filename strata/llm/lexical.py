"""Ranked lexical search over a length-stratified index.

A document's length enters its score through the whole number
m = 50 + (50 * n * N) div L alone, so all documents of one m form a stratum
in which a term's impact, (1000000000 * tf) div (1000 * tf + 20 * m), depends
on tf alone. The index is a Parquet table of blocks. A block holds documents
of one stratum (a large stratum has many blocks) and its postings by term and
tf, so an impact is computed once per tf of a block, not per posting.

A search bounds every block for every item (weights times the impact of the
term's highest tf), visits the blocks in falling order of their bounds and
leaves a block alone where its bound is below the item's present k-th score.
Each task keeps the k best of its blocks; one window merges them.

Defined cases: a null or termless text has no score and doesn't count in N;
each row is a document of its own, repeated rows included; a null doc_id
ranks after all others of its score; rows that share an item_id are one item
with all their terms, a null item_id is one more; an item without a scoring
document has no rows; empty tables give an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import stage_path, stage_table
from .common import sized, text_slices, texts_of

K = 50
#: Bounds of a block (documents, postings) and of an index task (postings).
BLOCK_DOCS, BLOCK_POSTINGS, PART_POSTINGS = 2048, 1 << 17, 500_000
#: Items searched in one pass over the index; more items take more passes.
ITEM_BLOCK = 1000
#: A query vocabulary of at most so many terms travels with the tasks, and
#: the index then holds postings of these terms alone.
VOCABULARY = 500_000
#: Every byte of a term as itself (A-Z in lower case), every other as a blank.
TERM_BYTES = bytes(c if c >= 0x80 or chr(c).isalnum() and chr(c) == chr(c).lower() else c + 32 if chr(c).isalnum() else 32
                   for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _lists(values: pa.Array, lengths: list[int] | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), pa.int32()), values)


def _strings(raw: list[bytes]) -> pa.Array:
    return pa.array(raw, pa.binary()).cast(pa.string(), safe=False)


COUNTS = "id long, uid long, n long, terms array<string>, tfs array<int>"


def term_counts(docs: DataFrame, id_column: str, vocabulary: set[bytes] | None = None) -> DataFrame:
    """Per row: its number of terms and the terms (of ``vocabulary``, if
    given) with their counts. uid numbers the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for b in text_slices(batches, "text"):
            n, sizes, terms, tfs = [], [], [], []
            for raw in texts_of(b, "text"):
                words = terms_of(raw)
                count = Counter(words if vocabulary is None else filter(vocabulary.__contains__, words))
                n.append(len(words))
                sizes.append(len(count))
                terms += count.keys()
                tfs += count.values()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.arange(uid, uid + len(n))), pa.array(n, pa.int64()),
                 _lists(_strings(terms), sizes), _lists(pa.array(tfs, pa.int32()), sizes)], ["id", "uid", "n", "terms", "tfs"])
            uid += len(n)

    return docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col("text").alias("text")).mapInArrow(run, COUNTS)


BLOCKS = "m long, ids array<bigint>, terms array<string>, groups array<int>, tfs array<int>, sizes array<int>, docs array<int>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows that come sorted by m."""
    for b in batches:
        if b.num_rows == 0:
            continue
        m = b.column(1).to_numpy(zero_copy_only=False)
        lists = b.column(2)
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        tf = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))])
        i, out = 0, []
        while i < len(m):
            j = min(int(np.searchsorted(m, m[i], side="right")), i + BLOCK_DOCS)
            j = max(i + 1, min(j, int(np.searchsorted(upto, upto[i] + BLOCK_POSTINGS, side="right")) - 1))
            c, t = codes[upto[i]: upto[j]], tf[upto[i]: upto[j]]
            doc = np.repeat(np.arange(j - i), np.diff(upto[i: j + 1]))
            order = np.lexsort((t, c))
            c, t, doc = c[order], t[order], doc[order]
            new = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (t[1:] != t[:-1])]) if len(c) else np.zeros(0, np.int64)
            term, per_term = np.unique(c[new], return_counts=True)
            out.append((m[i], (i, j), term, per_term, t[new], np.diff(np.r_[new, len(c)]), doc))
            i = j
        ids = pa.concat_arrays([b.column(0).slice(r[1][0], r[1][1] - r[1][0]) for r in out])
        cols = [pa.array([r[0] for r in out], pa.int64()), _lists(ids, [r[1][1] - r[1][0] for r in out]),
                _lists(words.dictionary.take(pa.array(np.concatenate([r[2] for r in out]))), [len(r[2]) for r in out])]
        for k in (3, 4, 5, 6):
            cols.append(_lists(pa.array(np.concatenate([r[k] for r in out]), pa.int32()), [len(r[k]) for r in out]))
        yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in BLOCKS.split(", ")])


class Index:
    """blocks (Parquet), frequencies (term, df), the number of documents with
    a term, and their total length."""

    def __init__(self, blocks: DataFrame, frequencies: DataFrame, documents: int, length: int):
        self.blocks, self.frequencies, self.documents, self.length = blocks, frequencies, documents, length


def build_index(docs: DataFrame, path: str | None = None, vocabulary: set[bytes] | None = None) -> Index:
    """The index of all rows of ``docs``, written under ``path`` (default: a
    new table in the checkpoint folder). Each stratum is cut in as many pieces
    as its counted postings need and the pieces are dealt by hash, so that
    neither a large stratum nor the long documents meet in one task."""
    spark = docs.sparkSession
    counts = stage_table(term_counts(docs, "doc_id", vocabulary), "lexical-counts").where("n > 0")
    documents, length, postings = counts.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.size("terms").cast("long"))).first()
    frequencies = stage_table(counts.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")), "lexical-df")
    m = F.expr(f"50 + (50 * n * {documents}L) div {max(length or 0, 1)}L")
    rows = counts.select("id", m.alias("m"), "terms", "tfs", "uid")
    strata = rows.groupBy(F.col("m").alias("_m")).agg(F.sum(F.size("terms").cast("long")).alias("t")).select(
        "_m", F.greatest(F.lit(1), F.ceil(F.col("t") / BLOCK_POSTINGS)).alias("_pieces"))
    strata = stage_table(strata, "lexical-strata")  # one row a stratum
    pieces = rows.join(sized(strata, strata.count()), F.col("m") == F.col("_m")).withColumn("_p", F.pmod(F.xxhash64("uid"), F.col("_pieces")))
    dealt = pieces.repartition(max(1, math.ceil((postings or 0) / PART_POSTINGS)), "m", "_p")
    path = path or stage_path(spark, "lexical-index")
    dealt.sortWithinPartitions("m", "_p", "uid").select("id", "m", "terms", "tfs").mapInArrow(_blocks, BLOCKS).write.parquet(path)
    return Index(spark.read.schema(BLOCKS).parquet(path), frequencies, documents, length or 0)


class Block:
    """One block with its impacts."""

    def __init__(self, row: dict, wanted: dict[str, int]):
        self.ids, tfs = row["ids"], row["tfs"]
        distinct, which = np.unique(tfs, return_inverse=True)
        impact = 1_000_000_000 * distinct // (1000 * distinct + 20 * row["m"])  # once per tf
        ends = np.cumsum(row["groups"])
        which_term = [(wanted[t], i) for i, t in enumerate(row["terms"]) if t in wanted]
        self.terms = np.array([t for t, _ in which_term], np.int64)
        at = np.array([i for _, i in which_term], np.int64)
        self.highest = impact[which[ends[at] - 1]] if len(at) else np.zeros(0, np.int64)
        self.first, self.last, self.at = ends - row["groups"], ends, at
        self.upto, self.docs, self.sizes = np.concatenate([[0], np.cumsum(row["sizes"])]), row["docs"], row["sizes"]
        self.impact = impact[which]

    def postings(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, impacts) of the wanted term number k of the block."""
        a, b = self.first[self.at[k]], self.last[self.at[k]]
        return self.docs[self.upto[a]: self.upto[b]], np.repeat(self.impact[a:b], self.sizes[a:b])


class Items:
    """Terms and weights of a block of items."""

    def __init__(self, weights: list[tuple[int | None, str, int]]):
        self.ids = sorted({w[0] for w in weights}, key=lambda x: (x is None, x))
        number = {x: i for i, x in enumerate(self.ids)}
        by_term: dict[str, list[tuple[int, int]]] = {}
        for item, term, weight in weights:
            by_term.setdefault(term, []).append((number[item], weight))
        self.terms = {t: i for i, t in enumerate(by_term)}
        self.items = [np.array([i for i, _ in x], np.int64) for x in by_term.values()]
        self.weights = [np.array([w for _, w in x], np.int64) for x in by_term.values()]

    def bounds(self, block: Block) -> np.ndarray:
        out = np.zeros(len(self.ids), np.int64)
        for t, high in zip(block.terms.tolist(), block.highest.tolist()):
            out[self.items[t]] += self.weights[t] * high
        return out

    def scores(self, block: Block, rows: np.ndarray) -> np.ndarray:
        """Scores of the block's documents for the items ``rows``."""
        place = np.full(len(self.ids), -1)
        place[rows] = np.arange(len(rows))
        out = np.zeros((len(rows), len(block.ids)), np.int64)
        for k, t in enumerate(block.terms.tolist()):
            at = place[self.items[t]]
            use = at >= 0
            if use.any():
                docs, impacts = block.postings(k)
                if len(docs) == 1:
                    out[at[use], docs[0]] += self.weights[t][use] * impacts[0]
                else:
                    for r, w in zip(at[use].tolist(), self.weights[t][use].tolist()):
                        out[r, docs] += w * impacts
        return out


NO_ID = np.iinfo(np.int64).max
FOUND = "item_id long, doc_id long, no_id boolean, score long"


def _search(items: Items, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items.ids)
        floor = np.ones(len(items.ids), np.int64)  # an item's k-th score so far, 1 until it has k
        for b in batches:
            visits = []
            for i in range(b.num_rows):
                row = {name: b.column(c)[i].values if c else b.column(c)[i].as_py() for c, name in enumerate(b.schema.names)}
                row["terms"] = row["terms"].to_pylist()
                ids = row["ids"].fill_null(NO_ID)
                # positions stay views of the batch; the short lists become long integers
                row = {name: v if not isinstance(v, pa.Array) else v.to_numpy(zero_copy_only=False) if name == "docs"
                       else v.to_numpy(zero_copy_only=False).astype(np.int64) for name, v in (row | {"ids": ids}).items()}
                block = Block(row, items.terms)
                bound = items.bounds(block)
                if bound.any():
                    visits.append((int(bound.max()), block, bound))
            for _, block, bound in sorted(visits, key=lambda v: -v[0]):
                rows = np.flatnonzero(bound >= floor)
                if len(rows) == 0:
                    continue
                for item, score in zip(rows.tolist(), items.scores(block, rows)):
                    hit = np.flatnonzero(score >= floor[item])
                    if len(hit) == 0:
                        continue
                    s, d = np.concatenate([best[item][0], score[hit]]), np.concatenate([best[item][1], block.ids[hit]])
                    if len(s) > 4 * k:
                        top = s >= np.partition(s, len(s) - k)[len(s) - k]
                        s, d = s[top], d[top]
                    order = np.lexsort((d, -s))[:k]
                    best[item] = s[order], d[order]
                    if len(order) == k:
                        floor[item] = s[order[-1]]
        sizes = [len(s) for s, _ in best]
        if sum(sizes):
            which = np.repeat(np.arange(len(sizes)), sizes)
            doc = np.concatenate([d for _, d in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items.ids, pa.int64()).take(pa.array(which)), pa.array(doc, mask=doc == NO_ID), pa.array(doc == NO_ID),
                 pa.array(np.concatenate([s for s, _ in best]))], ["item_id", "doc_id", "no_id", "score"])
    return run


def search(index: Index, item_terms: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents.
    ``item_terms`` (item_id, term) is the stated query set; it is searched in
    blocks of ITEM_BLOCK items, whose terms and weights travel with the tasks."""
    spark = item_terms.sparkSession
    numerator = 2 * index.documents + 2
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(numerator)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weighted = stage_table(item_terms.distinct().join(index.frequencies, "term").select("item_id", "term", weight.alias("w"))
                           .where("w > 0"), "lexical-items")
    blocks = math.ceil(weighted.select("item_id").distinct().count() / ITEM_BLOCK)
    found = None
    for i in range(blocks):
        rows = weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()
        if rows:
            part = index.blocks.mapInArrow(_search(Items([tuple(r) for r in rows]), k), FOUND)
            found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), "no_id", "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents of ``docs`` (doc_id, text) for each of ``items``
    (item_id, text)."""
    counted = term_counts(items, "item_id").select(F.col("id").alias("item_id"), F.explode("terms").alias("term")).distinct()
    item_terms = stage_table(counted, "lexical-item-terms")
    terms = item_terms.select("term").distinct()
    small = terms.count() <= VOCABULARY
    vocabulary = {r[0].encode() for r in terms.collect()} if small else None
    return search(build_index(docs, vocabulary=vocabulary), item_terms, k)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM d GROUP BY doc_id, term),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM n),
m AS (SELECT doc_id, 50 + (50 * n * docs) // len AS m FROM n, s),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, s GROUP BY term, docs),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM i JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
      FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50
"""
