"""Quality rules with an n-gram language model: modified Kneser-Ney over byte
4-grams of the words, one model per language, and perplexity bands.

Spark counts the 4-grams of all documents (each task counts its own rows
first), so what is gathered grows with the input, while the model itself is
bounded by the gram space: keys are hashed one to one to 32 bits per order and
language and stored as sorted arrays with probabilities and back-off weights.
Texts are scored whole; the bands are spread around the median of the log
perplexity per byte of the documents of a language that pass the base rules.
Medians and quartiles are exact ranks of values on a grid of 1/GRID, so they are
the same however the rows are dealt.
The mean of a text with fewer words than the language's median scatters more,
by the square root of the ratio, and its band is wider by that.

Defined cases: a null text has no words; a null language is a language of
its own; a text without words has no perplexity and fails the base rules; a
language whose spread is zero has bands of the least width; an empty table
gives an empty result; repeated rows get equal rows and count each; extra
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import stage_table
from .common import numbered, text_slices, text_view

ORDER, HASH_BITS = 4, 32
#: Steps of a log perplexity, in parts of a nat.
GRID = 10_000
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5
#: A band reaches so many quartile distances from the median (4 are 2.7
#: standard deviations of a normal spread), and at least so far (in nats a byte).
BAND_SPREAD, BAND_LEAST = 4.0, 0.03

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The symbols of the contract.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BYTE_HASH = np.random.default_rng(11).integers(1, 2 ** 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[off[1:]] - total[off[:-1]]


def _inverse(x: int) -> int:
    return pow(x, -1, 2 ** 64)


def _spans_hash(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the byte spans [a, b)."""
    n = len(data)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_HASH[data] * power[:n], dtype=np.uint64)])
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_inverse(int(_BASE))), np.uint64)]))
    h = (total[b] - total[a]) * back[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _repeated(doc: np.ndarray, data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seen before in its document?, found twice or more there?) per byte
    span [a, b). Hashes bring equal spans together; spans of equal hashes are
    then compared byte by byte."""
    h = _spans_hash(data, a, b)
    order = np.lexsort((np.arange(len(h)), h, doc))
    d, x = doc[order], h[order]
    same = (d[1:] == d[:-1]) & (x[1:] == x[:-1])
    at, raw = np.flatnonzero(same), data.tobytes()
    spans = list(zip(a[order].tolist(), b[order].tolist()))
    unlike = [i for i in at.tolist() if raw[slice(*spans[i])] != raw[slice(*spans[i + 1])]]
    later, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    breaks = np.flatnonzero(~same)
    for i in {int(breaks[k - 1]) + 1 if (k := np.searchsorted(breaks, i)) else 0 for i in unlike}:
        run = [i]  # different spans of one hash: told apart by their bytes
        while run[-1] < len(same) and same[run[-1]]:
            run.append(run[-1] + 1)
        members: dict[bytes, list[int]] = {}
        for j in run:
            members.setdefault(raw[slice(*spans[j])], []).append(order[j])
        for found in members.values():
            later[found], later[found[0]], twice[found] = True, False, len(found) > 1
    return later, twice


def word_stream(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' words, each followed by one blank, and the n + 1 bounds."""
    space = _SPACE[data]
    starts = np.zeros(len(data), bool)
    starts[off[:-1][off[:-1] < off[1:]]] = True
    after_word = np.concatenate([[False], ~space[:-1]]) & ~starts
    keep = ~space | after_word
    # a word that ends its document gets its blank there
    ends = off[1:] - 1
    open_ = (off[1:] > off[:-1])
    open_[open_] = ~space[ends[open_]]
    kept = _per_doc(keep, off)
    stream = np.where(space, np.uint8(32), data)[keep]
    at = np.cumsum(kept)[open_]
    bounds = np.concatenate([[0], np.cumsum(kept + open_)])
    return np.insert(stream, at, 32), bounds


def base_stats(data: np.ndarray, off: np.ndarray, stream: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    n = len(off) - 1
    space = _SPACE[data]
    blank = stream == 32
    n_words = _per_doc(blank, bounds)
    word_ends = np.flatnonzero(blank)
    first = np.cumsum(n_words) - n_words
    # windows of words inside one document
    word_starts = np.concatenate([[0], word_ends[:-1] + 1]) if len(word_ends) else word_ends
    doc = np.repeat(np.arange(n), n_words)
    k = len(word_ends) - REPEAT_WINDOW + 1
    covered = np.zeros(len(word_ends), bool)
    if k > 0:
        i = np.flatnonzero(doc[:k] == doc[REPEAT_WINDOW - 1:])
        _, twice = _repeated(doc[i], stream, word_starts[i], word_ends[i + REPEAT_WINDOW - 1])
        step = np.zeros(len(word_ends) + 1, np.int64)
        np.add.at(step, i[twice], 1)
        np.add.at(step, i[twice] + REPEAT_WINDOW, -1)
        covered = np.cumsum(step[:-1]) > 0
    # lines with a word
    breaks = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([off[:-1], breaks + 1]))
    begins = begins[begins < len(data)]
    line_doc = np.searchsorted(off, begins, side="right") - 1
    after = np.append(breaks, len(data))[np.searchsorted(breaks, begins)]
    stops = np.minimum(after, off[line_doc + 1])
    ink = np.concatenate([[0], np.cumsum(~space)])
    wordy = ink[stops] > ink[begins]
    a, b = begins[wordy], stops[wordy]
    line_doc = line_doc[wordy]
    later, _ = _repeated(line_doc, data, a, b) if len(a) else (np.zeros(0, bool), None)
    return {"n_words": n_words,
            "word_chars": _per_doc(~space & ((data & 0xC0) != 0x80), off),
            "n_symbols": _per_doc(_SYMBOL[data], off),
            "n_dup_lines": np.bincount(line_doc[later], minlength=n).astype(np.int64) if len(a) else np.zeros(n, np.int64),
            "n_repeat_words": _per_doc(covered, np.concatenate([first, [len(word_ends)]]))}


# --------------------------------------------------------------------------
# the model
# --------------------------------------------------------------------------
def grams(stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """4-grams of lower-cased streams (three zero bytes before each) and bounds."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    padded = np.insert(_LOWER[stream], np.repeat(bounds[:-1], 3), 0).astype(np.uint32)
    if len(padded) < 4:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    codes = (padded[:-3] << 24) | (padded[1:-2] << 16) | (padded[2:-1] << 8) | padded[3:]
    keep = np.ones(len(codes), bool)
    edges = (bounds[1:-1] + 3 * np.arange(1, n)) - 3  # grams that reach into the next document's padding
    for j in range(3):
        keep[(edges + j)[(edges + j >= 0) & (edges + j < len(codes))]] = False
    return codes[keep], np.concatenate([[0], np.cumsum(size)])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}
        for b in text_slices(batches, "text"):
            langs = b.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                own = b.filter(pa.array([x == lang for x in langs])) if len(set(langs)) > 1 else b
                codes, _ = grams(*word_stream(*text_view(own.column(1))))
                new = np.unique(codes, return_counts=True)
                held.setdefault(lang, []).append(new)
                if len(held[lang]) > 8:
                    held[lang] = [_summed(held[lang])]
        for lang, parts in held.items():
            g, c = _summed(parts)
            for i in range(0, len(g), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[i: i + (1 << 16)]), pa.string()),
                                                  pa.array(g[i: i + (1 << 16)].astype(np.int64)), pa.array(c[i: i + (1 << 16)])], ["lang", "gram", "n"])

    return (docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").alias("text"))
            .mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    g, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return g, np.bincount(which, np.concatenate([p[1] for p in parts]), minlength=len(g)).astype(np.int64)


def _discounts(c: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more."""
    n = [int((c == k).sum()) for k in (1, 2, 3, 4)]
    if min(n[0], n[1]) == 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [0.0] + [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and k < 4 else 0.5 for k in (1, 2, 3)]
    return np.clip(d, 0.0, [0.0, 0.95, 1.95, 2.95])


def kneser_ney(gram: np.ndarray, count: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Per order from 1 to 4: sorted grams with interpolated probabilities, and
    sorted contexts with back-off weights. Lower orders count the different
    bytes that precede a gram."""
    levels, g, c = [], gram.astype(np.uint64), count
    for order in range(ORDER, 0, -1):
        levels.append((order, g, c))
        g, c = np.unique(g & np.uint64((1 << 8 * (order - 1)) - 1), return_counts=True) if order > 1 else (g, c)
    out: list[dict[str, np.ndarray]] = []
    for order, g, c in reversed(levels):
        d = _discounts(c)
        ctx, which = np.unique(g >> np.uint64(8), return_inverse=True)
        total = np.bincount(which, c)
        own = d[np.minimum(c, 3)]
        back = np.bincount(which, own) / total
        lower = np.full(len(g), 1 / 256.0) if order == 1 else out[-1]["p"][
            np.searchsorted(out[-1]["g"], g & np.uint64((1 << 8 * (order - 1)) - 1))]
        out.append({"g": g, "p": (c - own) / total[which] + back[which] * lower, "ctx": ctx, "back": back})
    return out


def _hashed(g: np.ndarray, width: int = 4) -> np.ndarray:
    """Of grams of ``width`` bytes. One to one: the multiplier is odd and a
    gram has at most 32 bits."""
    return (((g.astype(np.uint64) & np.uint64((1 << 8 * width) - 1)) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


MODEL = "lang string, orders int, kind string, keys binary, vals binary"


def train_models(counts: DataFrame) -> dict[str | None, "NgramModel"]:
    """One model per language, built where its counted grams are (at most one
    row a gram, whatever the input) and sent on as sorted hash arrays."""

    def build(table: pa.Table) -> pa.Table:
        g = table.column("gram").to_numpy().astype(np.uint64)
        order = np.argsort(g)
        rows = []
        for k, level in enumerate(kneser_ney(g[order], table.column("n").to_numpy()[order]), 1):
            for kind, key, val in (("p", level["g"], level["p"]), ("back", level["ctx"], level["back"])):
                h = _hashed(key)
                by = np.argsort(h)
                rows.append((table.column("lang")[0].as_py(), k, kind, h[by].tobytes(), np.log(np.maximum(val[by], 1e-12)).astype(np.float32).tobytes()))
        return pa.table(list(zip(*rows)) and [pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.binary()))], ["lang", "orders", "kind", "keys", "vals"])

    rows = counts.groupBy("lang").applyInArrow(build, MODEL).collect()
    models: dict[str | None, NgramModel] = {}
    for r in rows:
        models.setdefault(r["lang"], NgramModel()).add(r["orders"], r["kind"], bytes(r["keys"]), bytes(r["vals"]))
    return models


class NgramModel:
    """Sorted hash arrays with an index over the leading bits of the keys."""

    def __init__(self):
        self.arrays: dict[tuple[int, str], tuple] = {}

    def add(self, order: int, kind: str, keys: bytes, vals: bytes) -> None:
        k, v = np.frombuffer(keys, np.uint32), np.frombuffer(vals, np.float32)
        shift = HASH_BITS - 18
        index = np.searchsorted(k, np.arange((1 << 18) + 1, dtype=np.uint64) << np.uint64(shift)).astype(np.int32)
        self.arrays[order, kind] = (k, v, shift, index)

    def find(self, order: int, kind: str, g: np.ndarray) -> np.ndarray:
        """Values of the grams, nan where there is none."""
        keys, vals, shift, index = self.arrays[order, kind]
        h = _hashed(g)
        top = h >> np.uint32(shift)
        at, end = index[top], index[top + 1]
        out = np.full(len(h), np.nan, np.float32)
        live = np.flatnonzero(at < end)
        at, end, want = at[live], end[live], h[live]
        while len(live):
            hit = keys[at] == want
            out[live[hit]] = vals[at[hit]]
            go = ~hit & (at + 1 < end)
            live, at, end, want = live[go], at[go] + 1, end[go], want[go]
        return out

    def log_probability(self, gram: np.ndarray) -> np.ndarray:
        out = np.zeros(len(gram), np.float32)
        rest, g = np.arange(len(gram)), gram
        for order in range(ORDER, 0, -1):
            g = g & np.uint32((1 << 8 * order) - 1) if order < 4 else g
            p = self.find(order, "p", g)
            known = ~np.isnan(p)
            out[rest[known]] += p[known]
            rest, g = rest[~known], g[~known]
            if len(rest) == 0:
                return out
            back = self.find(order, "back", g >> np.uint32(8)) if order > 1 else self.arrays[1, "back"][1][:1].repeat(len(g))
            out[rest] += np.nan_to_num(back, nan=0.0)
        out[rest] += np.float32(np.log(1 / 256.0))
        return out


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*STATS, "log_ppl", "base_failed", "perplexity", "ppl_low", "ppl_high", "kept")


def score(docs: DataFrame, models: dict[str | None, NgramModel]) -> DataFrame:
    """All rows and columns of ``docs`` but the text, with the base statistics
    and log_ppl, the negative mean log probability per byte."""
    sent = docs.sparkSession.sparkContext.broadcast(models)
    names = [c for c in docs.columns if c != "text"]
    stats = list(STATS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in text_slices(batches, "text"):
            data, off = text_view(b.column(len(names)))
            stream, bounds = word_stream(data, off)
            out = base_stats(data, off, stream, bounds)
            codes, at = grams(stream, bounds)
            langs = b.column(len(names) + 1).to_pylist()
            logp = np.zeros(len(codes), np.float32)
            owner = np.repeat(np.arange(len(langs)), np.diff(at))
            number = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            of = np.array([number[x] for x in langs], np.int64)[owner]
            for lang, i in number.items():
                if lang in known:
                    mine = of == i
                    logp[mine] = known[lang].log_probability(codes[mine])
            size = np.diff(at)
            # a text's sum is its own, whatever texts stand beside it
            total = np.zeros(len(size))
            total[size > 0] = np.add.reduceat(logp.astype(np.float64), at[:-1][size > 0]) if len(logp) else 0.0
            mean = np.where(size > 0, -total / np.maximum(size, 1), np.nan)
            cols = b.columns[: len(names)]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(out[s].astype(np.int64)) for s in stats],
                                              pc.if_else(pa.array(size > 0), pa.array(mean), pa.scalar(None, pa.float64()))], [*names, *stats, "log_ppl"])

    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, *[T.StructField(s, T.LongType()) for s in stats], T.StructField("log_ppl", T.DoubleType())])
    rows = docs.select(*numbered(names), "text", F.col("lang").cast("string").alias("label"))
    return rows.mapInArrow(run, schema)


def _ranked(rows: DataFrame, value: Column, shares: list[float], name: str) -> DataFrame:
    """Exact quantiles of a whole-numbered value per language: the smallest
    value that at least so many of the rows reach up to. Rows of one value are
    one count before they meet, so a group holds different values, not rows."""
    lang = "_bl" if name == "_q" else "_bl_w"
    counts = rows.groupBy(F.col("lang").alias(lang), value.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.partitionBy(lang).orderBy("v"))
    total = F.sum("c").over(W.partitionBy(lang))
    at = counts.select(lang, "v", upto.alias("u"), total.alias("n"))
    return at.groupBy(lang).agg(F.array(*[F.min(F.when(F.col("u") >= F.lit(x) * F.col("n"), F.col("v"))) for x in shares]).alias(name))


def assess(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` but the text with base statistics,
    base_failed, perplexity (per byte), ppl_low, ppl_high and kept. Needs text
    and lang; columns named like a result are replaced."""
    docs = docs.drop(*RESULTS)
    counts = gram_counts(docs)
    scored = stage_table(score(docs, train_models(counts)), "quality-scores")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    passed = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull())
    bands = _ranked(passed, F.round(F.col("log_ppl") * GRID).cast("long"), [0.25, 0.5, 0.75], "_q").join(
        _ranked(passed, F.col("n_words"), [0.5], "_w"), F.col("_bl").eqNullSafe(F.col("_bl_w"))).select(
        "_bl", F.transform("_q", lambda q: q / F.lit(float(GRID))).alias("_q"), F.col("_w")[0].alias("_nw"))
    reach = lambda a, b: F.greatest(F.lit(BAND_LEAST), F.lit(BAND_SPREAD) * (F.col("_q")[b] - F.col("_q")[a]))
    bands = bands.select("_bl", "_nw", F.col("_q")[1].alias("_mid"), reach(0, 1).alias("_below"), reach(1, 2).alias("_above"))
    rows = scored.select(F.struct(*[F.col(f"`{c}`") for c in scored.columns]).alias("_row"))
    out = rows.join(bands, F.col("_row.lang").eqNullSafe(F.col("_bl")), "left")
    wider = F.sqrt(F.greatest(F.lit(1.0), F.col("_nw") / F.greatest(F.lit(1), F.col("_row.n_words"))))
    out = out.select("_row", (F.col("_mid") - F.col("_below") * wider).alias("_lo"), (F.col("_mid") + F.col("_above") * wider).alias("_hi"))
    inside = F.col("_row.log_ppl").between(F.col("_lo"), F.col("_hi"))
    return out.select("_row.*", F.exp("_row.log_ppl").alias("perplexity"), F.exp("_lo").alias("ppl_low"), F.exp("_hi").alias("ppl_high"),
                      (~F.col("_row.base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
