"""Ranked lexical search: brute force over whole small tables, strata, blocks and bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strata.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=50):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, ts in wanted.items():
        scores = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in ts if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.fixture(scope="module")
def random_tables():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["É", "naïve", "中文", "a-b", "X_Y", "\x7f", "don't"]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weight, k=rng.choice([0, 1, 5, 5, 5, 40, 300])))) for i in range(400)]
    docs += [(i, t) for i, t in docs[:30]] + [(None, docs[5][1]), (900, None), (901, " .,\x00!"), (902, "w1 " * 50_000)]
    items = [(i, " ".join(rng.choices(words, weight, k=8))) for i in range(20)] + [(3, "w40 w41"), (None, "w7 w8"), (50, None), (51, "unseen")]
    return docs, items


def test_against_brute_force(spark, random_tables):
    docs, items = random_tables
    assert found(lexical.rank_documents(*frames(spark, docs, items))) == brute(docs, items)


def test_small_blocks_and_item_blocks_change_nothing(spark, random_tables, monkeypatch):
    docs, items = random_tables
    for name, value in (("BLOCK_DOCS", 3), ("BLOCK_POSTINGS", 40), ("PART_POSTINGS", 500), ("ITEM_BLOCK", 4), ("VOCABULARY", 0)):
        monkeypatch.setattr(lexical, name, value)
    d, i = frames(spark, docs, items)
    assert found(lexical.rank_documents(d, i, k=7)) == brute(docs, items, 7)


def test_a_block_holds_one_stratum_and_all_rows_are_indexed(spark, random_tables):
    docs, items = random_tables
    index = lexical.build_index(frames(spark, docs, items)[0])
    rows = index.blocks.collect()
    kept = [t for _, t in docs if terms(t)]
    assert sum(len(r.ids) for r in rows) == len(kept) == index.documents
    assert sum(sum(r.sizes) for r in rows) == sum(len(set(terms(t))) for t in kept)
    assert index.length == sum(len(terms(t)) for t in kept)


def test_bounds_hold_and_skip(spark, random_tables):
    docs, items = random_tables
    index = lexical.build_index(frames(spark, docs, items)[0])
    q = lexical.Items([(0, "w3", 900), (0, "w20", 2500), (1, "w0", 40)])
    for r in index.blocks.collect():
        row = {c: np.array(r[c], np.int64) if isinstance(r[c], list) and c not in ("terms", "ids") else r[c] for c in r.__fields__}
        block = lexical.Block(row, q.terms)
        scores, bound = q.scores(block, np.array([0, 1])), q.bounds(block)
        assert (scores.max(axis=1) <= bound).all() and (scores[0].any() or not bound[0])


def test_empty_tables_and_clashing_columns(spark, odd, empty, clashing):
    items = spark.createDataFrame([(1, "the cat", 5, "x")], "item_id long, text string, m long, terms string")
    none = items.where("false")
    assert lexical.rank_documents(empty, items).count() == 0 == lexical.rank_documents(odd, none).count()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(lexical.rank_documents(clashing, items)) == brute(rows, [(1, "the cat")])
