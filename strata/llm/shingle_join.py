"""Self-join of documents by the Jaccard similarity of their word shingles,
with a token-group matrix.

A document's set holds the 64-bit hashes of its distinct shingles; documents
with equal sets are one class, and only classes are compared. Classes are
partitioned into groups of similar sets: those of about one size that agree
in a minhash, a large group dealt further by a second minhash. A group's
token union bounds the overlap that a query can have with any of its members;
a query opens only groups whose union holds enough of its tokens.

Two sets at similarity p, of n and m shingles, have at least p n and p m in
common. So, in one order of all tokens, the first n - ceil(p n) + k of one and
the first m - ceil(p m) + k of the other share k tokens at least. The order is
by rarity (a count sketch of fixed size; a hash breaks ties). The matrix holds
the groups' tokens of these prefixes, rows (token, group, sets), with k a
32nd of the set. Joined with the queries' prefixes it counts how many tokens a
query can share with any set of a group; only groups with enough of them are
opened, a set's own group too. Enough are k, and more between sets of about
one size: what two sets share beyond the prefix that ends first is at most the
rest of its set. So documents that share a passage, but not most of their
text, and copies of one text with too many edits, are told apart without a
look at their sets. Of two groups only the one with the smaller number queries
the other, and numbers begin with the group's size. So the few copies of a
large family that fall into groups of their own query its group, and not all
of its sets each of these.

In an open group a set that is linked with another follows its leader, others
become leaders; a query reports one link to a leader with its followers. Each
set has a row of marks, the parity of its tokens in some thousand cells. The
marks in which two sets differ are at most the tokens that only one of them
has, so one pass over the rows leaves the sets that may be partners; the
nearest is compared token by token, and then the nearest of another leader.
Nearly equal sets thus cost one comparison, and many sets that are nearly, but
not enough, alike cost none.

Defined cases: an empty or null text has an empty set and is linked with
nothing; a text with fewer words than a shingle has its whole sequence as one
shingle; each row is a document of its own, and rows of one doc_id and
different texts stay apart; a null doc_id takes part and is never a
component_id while its component has another id; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import sized, text_slices, text_view
from .components import connected_components

SHINGLE, PERCENT = 3, 90
#: A group has at most about so many sets and tokens; a group's queries are
#: dealt to blocks of about so many.
GROUP_SETS, GROUP_TOKENS, QUERY_BLOCK = 1024, 1 << 18, 4096
#: Counters of the rarity sketch (the size is the same for every corpus).
SKETCH_BITS, SKETCH_PARTS = 20, 64
#: The prefixes of linked sets share one token in so many of the smaller set.
PREFIX_SHARE = 32
#: Marks of a group's sets: so many for each token that linked sets may differ
#: in, within these powers of two.
MARKS_EACH, MARK_BITS = 16, (8, 15)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NEXT, _LAST = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xFF51AFD7ED558CCD)
#: Bytes of texts whose words are hashed at once, and bytes of a word that is
#: hashed apart. Upper case letters and blanks are those of ``bytes.lower()``
#: and ``bytes.split()``.
HASH_BYTES, LONG_WORD = 1 << 20, 64
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_BLANK = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_LANES = np.array([(1 << 8 * i) - 1 for i in range(8)] + [(1 << 64) - 1], "<u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= _LAST
    x ^= x >> np.uint64(29)
    return x


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie one behind the other, and
    where each text's words begin. Eight bytes of every word are taken in at a
    time, so words of one length up to eight have different hashes."""
    word = ~_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True  # a word ends with its text
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1] | first[1:-1]
    end[:-1] &= ~word[1:] | first[1:-1]
    begin = np.flatnonzero(begin)
    size = np.flatnonzero(end) + 1 - begin
    lower = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.sliding_window_view(lower, 8)
    out, now, at = size.astype(np.uint64) * _MIX, np.flatnonzero(size <= LONG_WORD), 0
    while len(now):
        lane = np.ascontiguousarray(lanes[begin[now] + at]).view("<u8")[:, 0] & _LANES[np.minimum(size[now] - at, 8)]
        out[now] = _mixed((out[now] ^ lane) * _NEXT)
        at += 8
        now = now[size[now] > at]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(lower[begin[i]: begin[i] + size[i]].tobytes())
    return out, np.searchsorted(begin, off)


def _sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    h, at = word_hashes(data, off)
    s = h[: max(len(h) - k + 1, 0)].copy()
    for i in range(1, k):
        s *= _NEXT
        s += h[i: i + len(s)]
    s, out = _mixed(s), []
    for a, b in zip(at.tolist(), at[1:].tolist()):
        one = s[a: b - k + 1]
        if a < b < a + k:  # the whole sequence
            one = np.zeros(1, np.uint64)
            for i in range(a, b):
                one = _mixed(one * _NEXT + h[i: i + 1])
        one = np.sort(one[: max(b - a, 0)])
        new = np.ones(len(one), bool)
        new[1:] = one[1:] != one[:-1]
        out.append(one[new])
    return out


def sets_of(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles, made of the hashes of
    its words; a null has none."""
    data, off = text_view(texts)
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + HASH_BYTES, side="right")) - 1)
        out += _sets(data[off[i]: off[j]], off[i: j + 1] - off[i], k)
        i = j
    return out


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The set of one text."""
    return _sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), k)[0]


def text_key() -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(F.lit(seed), "text").alias(name) for name, seed in (("t1", 42), ("t2", 71))]


SETS = "doc_id long, t1 long, t2 long, n long, key binary, part int, counts binary"


def shingle_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Each row's text hashes, set size and the set's 128-bit key (null for an
    empty set); beside them rows with each task's part of the rarity sketch.
    Sets are eight bytes a shingle, more than the text, so they are made anew
    where they are needed and never written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        names = [c.split()[0] for c in SETS.split(", ")]
        for b in text_slices(batches, "text"):
            sets = sets_of(b.column("text"), k)
            every = np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)
            cells += np.bincount(every.astype(np.int64), minlength=len(cells))
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()),
                 pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], names)
        if cells.any():
            parts = [p.astype("<u2").tobytes() for p in np.split(np.minimum(cells, (1 << 16) - 1), SKETCH_PARTS)]
            none = [pa.nulls(SKETCH_PARTS, t) for t in (pa.int64(),) * 4 + (pa.binary(),)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(parts, pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.select("doc_id", *text_key(), "text").mapInArrow(run, SETS)


def rarity(sets: DataFrame) -> np.ndarray:
    """Eight times the log2 of the number of rows with a token of each sketch
    cell: where a cell holds many rare tokens, one that is not rare still
    raises it by some levels. What reaches the driver is one byte a cell,
    whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(raw, "<u2").astype(np.uint64)
        for part, total in sums.items():
            level = np.minimum(8 * np.log2(total.astype(float) + 1), 255).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([level], pa.binary())], ["part", "level"])

    parts = sets.where("part IS NOT NULL").select("part", "counts").repartition(8, "part")
    levels = dict(tuple(r) for r in parts.mapInArrow(add, "part int, level binary").collect())
    blank = bytes((1 << SKETCH_BITS) // SKETCH_PARTS)
    return np.frombuffer(b"".join(bytes(levels.get(i, blank)) for i in range(SKETCH_PARTS)), np.uint8)


def needed(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n that a partner must hold."""
    return -(-percent * n // 100)


def common(n: int, share: int) -> int:
    """Tokens that the prefixes of two linked sets share, for the smaller one."""
    return max(1, n // share)


KEYS = "key binary, n long, home long, deal long, prefix array<bigint>"
#: The low bits of a group's number hold the size band of its sets, those from
#: COUNT_BIT on the logarithm of how many there are, from CROWDED on.
BAND_MASK, COUNT_BIT, CROWDED = 255, 57, 8


def group_keys(docs: DataFrame, levels: np.ndarray, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Each class's group before large ones are dealt (home), the second
    minhash (deal) and the rarest tokens (prefix). Equal sets give equal rows
    and become one where they meet."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    shift, band, share = np.uint64(64 - SKETCH_BITS), math.log(100 / min(percent, 99)), PREFIX_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lv = shared.value
        for b in text_slices(batches, "text"):
            keys, sizes, home, deal, prefix = [], [], [], [], []
            for s in sets_of(b.column("text"), k):
                if len(s) == 0:
                    continue
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(len(s))
                size = int(math.log(len(s)) / band)
                home.append(xxhash.xxh3_64_intdigest(b"%d %d" % (size, s[0])) >> 1 & ~BAND_MASK | size)
                deal.append(int((s * _MIX).min() >> np.uint64(1)))
                order = (lv[s >> shift].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                prefix.append(s[np.argsort(order, kind="stable")[: len(s) - needed(len(s), percent) + common(len(s), share)]].view(np.int64))
            if keys:
                at = np.concatenate([[0], np.cumsum([len(p) for p in prefix])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(home, pa.int64()), pa.array(deal, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(prefix)))],
                    ["key", "n", "home", "deal", "prefix"])

    rows = docs.select(F.col("text").alias("text")).mapInArrow(run, KEYS)
    return rows.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "home", "deal", "prefix")])


def assign_groups(keys: DataFrame) -> DataFrame:
    """(key, id, n, group, prefix): large groups are dealt to as many as their
    counted sets and tokens need, and numbered by what they then hold. id stands for the key where rows are many;
    two keys with one id only look at each other's groups too."""
    large = stage_table(keys.groupBy("home").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t")).select(
        F.col("home").alias("_h"), F.greatest(F.ceil(F.col("c") / GROUP_SETS), F.ceil(F.col("t") / GROUP_TOKENS)).alias("pieces"))
        .where("pieces > 1"), "jaccard-large")
    dealt = keys.join(sized(large, large.count()), F.col("home") == F.col("_h"), "left")
    piece = F.shiftleft(F.shiftrightunsigned(F.xxhash64("home", F.col("deal") % F.col("pieces")), 9), 8).bitwiseOR(
        F.col("home").bitwiseAND(F.lit(BAND_MASK)))
    group = F.when(F.col("pieces").isNull(), F.col("home")).otherwise(piece).bitwiseAND(F.lit((1 << COUNT_BIT) - 1))
    members = dealt.select("key", F.xxhash64("key").alias("id"), "n", group.alias("group"), "prefix")
    crowded = stage_table(members.groupBy(F.col("group").alias("_g")).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= CROWDED).select(
        "_g", F.shiftleft(F.floor(F.log2("c")), COUNT_BIT).alias("_count")), "jaccard-crowded")
    numbered = members.join(sized(crowded, crowded.count()), F.col("group") == F.col("_g"), "left")
    return numbered.select("key", "id", "n", F.col("group").bitwiseOR(F.coalesce("_count", F.lit(0))).alias("group"), "prefix")


def least_shared(n: Column, low: Column, high: Column, percent: int = PERCENT, share: int | None = None) -> Column:
    """Tokens at least that the prefix of a set of n shares with that of a
    linked set of low to high tokens. Linked sets of n and m share
    percent (n + m) / (100 + percent); all of it but the tokens behind the
    prefix that ends first is in both prefixes. Of m that bound is below two
    straight lines, so it is taken at both ends."""
    share = share or PREFIX_SHARE
    low, high = F.greatest(low, percent * n / 100), F.least(high, 100 * n / percent)
    part = percent / (100 + percent)

    def behind(m: Column) -> Column:  # tokens behind a prefix, at most
        return percent * m / 100 - m / share + 2

    ends = [part * (n + m) - rest for m in (low, high) for rest in (behind(n), behind(m))]
    few = F.floor(F.ceil(percent * n / 100) / share)
    return F.when(low > high + 1e-6, n + 1).otherwise(F.greatest(F.lit(1), few, F.least(*ends) - 1e-6))


def groups_to_open(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(key, group, target): the groups that may hold a partner of a set, by
    the tokens of its prefix that the group's prefixes hold and the sizes of
    the sets that hold them. The set's own group counts with tokens that
    another of its sets has."""
    # rows and matrix are made of one shuffle: they ask for the same columns (so the matrix has an id of each row's sets) and the same rows
    whole = members.where("id IS NOT NULL AND n IS NOT NULL AND `group` IS NOT NULL")
    rows = whole.select("id", "group", "n", F.explode("prefix").alias("token")).repartition("token")
    matrix = rows.groupBy("token", "group").agg(F.count(F.lit(1)).alias("sets"), F.max("id").alias("last"), F.min("n").alias("low"), F.max("n").alias(
        "high")).select("token", F.col("group").alias("target"), "sets", "last", "low", "high")
    apart = F.abs(F.col("target").bitwiseAND(F.lit(BAND_MASK)) - F.col("group").bitwiseAND(F.lit(BAND_MASK)))
    another = (F.col("target") == F.col("group")) & ((F.col("sets") > 1) | (F.col("last") != F.col("id")))
    sized_so = (100 * F.col("high") >= percent * F.col("n")) & (percent * F.col("low") <= 100 * F.col("n"))
    met = rows.join(matrix, "token").where(((F.col("target") > F.col("group")) | another) & (apart <= 2) & sized_so)
    shared = met.groupBy("id", "n", "target").agg(F.count(F.lit(1)).alias("held"), F.min("low").alias("low"), F.max("high").alias("high"))
    enough = shared.where(F.col("held") >= least_shared(F.col("n"), F.col("low"), F.col("high"), percent)).select("id", "n", "target")
    return enough.join(members.select("id", "key", "n", "group"), ["id", "n"]).select("key", "group", "target")


def visits(members: DataFrame, queries: DataFrame) -> DataFrame:
    """(group, block, query, key): for each group that others query all its
    sets, once for each block of the queries, and the queries, each in one
    block; for any other group its sets that may have a partner there."""
    others = queries.where("target <> group").select("key", F.col("target").alias("group"))
    own = queries.where("target = group").select("key", "group")
    blocks = stage_table(others.groupBy(F.col("group").alias("_g")).agg(
        F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks")), "jaccard-groups")
    here = F.col("group") == F.col("_g")
    asked = members.select("key", "group").join(blocks, here).select(
        "group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("query"), "key")
    alone = own.join(blocks, here, "left_anti").select("group", F.lit(0).alias("block"), F.lit(False).alias("query"), "key")
    asking = others.join(blocks, here).select("group", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"),
                                              F.lit(True).alias("query"), "key")
    return asked.union(alone).union(asking)


class Group:
    """An open group: its token union, and its leaders with their followers."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.union = percent, set()
        self.leaders: list[bytes] = []
        self.keys: list[bytes] = []
        self.tokens: list[np.ndarray] = []
        self.bits, self.sizes, self.leader, self.rows = 0, *[np.zeros(0, np.int64)] * 2, np.zeros((0, 0), np.uint64)

    def marks(self, tokens: np.ndarray) -> np.ndarray:
        cells = (tokens * _MIX) >> np.uint64(64 - self.bits)
        return np.packbits(np.bincount(cells.astype(np.int64), minlength=1 << self.bits) & 1).view(np.uint64)

    def links(self, tokens: set) -> tuple[list[bytes], list[int]]:
        """Keys that a set is linked with, one for each leader with its
        followers, and the numbers of these leaders."""
        n = len(tokens)
        if len(self.union.intersection(tokens)) < needed(n, self.percent):  # no member can hold enough of the set
            return [], []
        here, most = len(self.keys), 100 - self.percent
        mine = np.fromiter(tokens, np.uint64, n)
        apart = np.bitwise_count(self.rows[:here] ^ self.marks(mine)).sum(axis=1, dtype=np.int64)
        near = np.flatnonzero((100 + self.percent) * apart <= most * (n + self.sizes[:here]))
        near = near[np.argsort(apart[near], kind="stable")]
        found, leaders = [], []
        while len(near):
            i = int(near[0])
            both = len(tokens.intersection(self.tokens[i].tolist()))
            if 100 * both >= self.percent * (n + int(self.sizes[i]) - both):
                found.append(self.keys[i])
                leaders.append(int(self.leader[i]))
                near = near[self.leader[near] != leaders[-1]]
            else:
                near = near[1:]
        return found, leaders

    def add(self, key: bytes, tokens: set) -> list[bytes]:
        mine = np.fromiter(tokens, np.uint64, len(tokens))
        if not self.keys:
            cells = MARKS_EACH * 2 * len(mine) * (100 - self.percent) // (100 + self.percent)
            self.bits = min(max(cells.bit_length(), MARK_BITS[0]), MARK_BITS[1])
            self.rows = np.zeros((0, (1 << self.bits) // 64), np.uint64)
        found, leaders = self.links(tokens)
        here = len(self.keys)
        if here == len(self.rows):  # twice the room
            self.sizes, self.leader, self.rows = [
                np.concatenate([x, np.zeros((max(here, 4), *x.shape[1:]), x.dtype)]) for x in (self.sizes, self.leader, self.rows)]
        if not leaders:
            leaders = [len(self.leaders)]
            self.leaders.append(key)
        for other in leaders[1:]:  # the set joins their followers
            self.leader[:here][self.leader[:here] == other] = leaders[0]
        self.sizes[here], self.leader[here], self.rows[here] = len(mine), leaders[0], self.marks(mine)
        self.keys.append(key)
        self.tokens.append(mine)
        self.union |= tokens
        return found


def _open(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, None
        for b in text_slices(batches, "text"):
            out = []
            for tokens, g, block, query, key in zip(sets_of(b.column("text"), k), *[b.column(c).to_pylist() for c in range(4)]):
                if (g, block) != now:
                    now, group = (g, block), Group(percent)
                tokens = set(tokens.tolist())
                found = group.links(tokens)[0] if query else group.add(key, tokens)
                out += [(key, other) for other in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out)], ["a", "b"])
    return run


def links(docs: DataFrame, sets: DataFrame, classes: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): links between keys whose components are those of all pairs at
    the similarity. Only texts of classes that visit a group are shuffled."""
    members = assign_groups(stage_table(group_keys(docs, rarity(sets), k, percent), "jaccard-keys"))
    queries = stage_table(groups_to_open(members, percent), "jaccard-queries")
    going = stage_table(visits(members, queries).join(classes.select("key", "t1", "t2"), "key"), "jaccard-visits")
    wanted = stage_table(going.select("t1", "t2").distinct(), "jaccard-wanted")
    texts = docs.select(*text_key(), "text").join(sized(wanted, wanted.count()), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(
        F.first("text").alias("text"))
    dealt = going.join(texts, ["t1", "t2"]).select("group", "block", "query", "key", "text").repartition("group", "block")
    return dealt.sortWithinPartitions("group", "block", "query", "key").mapInArrow(_open(k, percent), "a binary, b binary")


def similar_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row. Sets with 100 *
    intersection >= percent * union are linked."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    sets = stage_table(shingle_sets(docs, k), "jaccard-sets")
    rows = sets.where("part IS NULL").select("doc_id", "n", "key", "t1", "t2")
    text = F.min(F.struct("t1", "t2")).alias("text")
    classes = stage_table(rows.where("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), text).select(
        "key", "doc_id", "text.t1", "text.t2"), "jaccard-classes")
    labels = connected_components(stage_table(links(docs, sets, classes, k, percent), "jaccard-links"))
    linked = stage_table(labels.join(classes.select("key", "doc_id"), F.col("node") == F.col("key")).select("key", "root", "doc_id"), "jaccard-linked")
    least = linked.groupBy(F.col("root").alias("_r")).agg(F.min("doc_id").alias("component"))
    named = linked.join(least, F.col("root") == F.col("_r")).select(F.col("key").alias("_k"), "component")
    # one row a class, written first, so that the join below can split the rows of a hot class
    found = stage_table(classes.select("key", "doc_id").join(named, F.col("key") == F.col("_k"), "left").select(
        F.col("key").alias("_key"), F.coalesce("component", "doc_id").alias("component")), "jaccard-found")
    return rows.select("doc_id", "n", "key").join(found, F.col("key") == F.col("_key"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS s FROM w),
u AS (SELECT DISTINCT doc_id, s FROM g),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM u GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
