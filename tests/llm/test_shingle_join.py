"""Jaccard self-join: brute force, group bounds, leaders, dealt groups."""

import random

import numpy as np
import pytest

from strata.llm import shingle_join as sj


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i: i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def components(sets, ids, percent=90):
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                label[root(i)] = root(j)
    out = []
    for i in range(len(sets)):
        known = [ids[j] for j in range(len(sets)) if root(j) == root(i) and ids[j] is not None]
        out.append(min(known) if known else None)
    return out


def brute(rows, percent=90):
    sets = [shingles(t) for _, t in rows]
    ids = [i for i, _ in rows]
    comp = components(sets, ids, percent)
    return sorted(((i, len(s), c if s else i) for i, s, c in zip(ids, sets, comp)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_texts(n=160, seed=1):
    """Families of texts at similarities around the threshold, over shared passages."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(500)]
    passage = rng.choices(words, k=30)
    out = []
    for _ in range(8):
        base = rng.choices(words, k=rng.choice([12, 40, 90, 200])) + passage
        for _ in range(n // 8):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                at = rng.randrange(len(t))
                t[at: at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(3)
            out.append(" ".join(t))
            base = t if rng.random() < 0.3 else base  # chains
    return out


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(near_texts()))
    return out + [(3, out[70][1]), (None, out[9][1]), (None, "alone here it stands"), (500, None), (501, "  \n"), (502, "one"), (503, "ONE"),
                  (504, "one two"), (505, "one  two\n"), (506, "word " * 30_000), (507, "É é"), (508, "é é")]


def test_brute_force(spark, rows):
    assert found(sj.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_small_groups_and_blocks_lose_no_link(spark, rows, monkeypatch):
    for name, value in (("GROUP_SETS", 2), ("GROUP_TOKENS", 60), ("QUERY_BLOCK", 2), ("PREFIX_SHARE", 8)):
        monkeypatch.setattr(sj, name, value)
    assert found(sj.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_other_thresholds(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (70, 100):
        assert found(sj.similar_documents(df, percent=percent)) == brute(rows, percent)
    with pytest.raises(ValueError):
        sj.similar_documents(df, percent=50)


def test_a_group_finds_the_same_components_as_all_pairs():
    texts = near_texts(240, seed=4)
    sets = [set(sj.shingle_set(t.encode()).tolist()) for t in texts]
    group, edges = sj.Group(), []
    for i, s in enumerate(sets):
        edges += [(i, j) for j in group.add(i, s)]
    label = list(range(len(sets)))
    for _ in sets:
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    assert label == components(sets, list(range(len(sets))))
    assert len(group.leaders) < 0.6 * len(sets) and len(edges) < 3 * len(sets)


def test_rarest_tokens_hold_a_common_one():
    rng = np.random.default_rng(3)
    for _ in range(600):
        a = rng.choice(10_000, rng.integers(1, 300), replace=False)
        b = np.unique(np.concatenate([a[: len(a) - rng.integers(0, 9)], rng.choice(10_000, rng.integers(0, 9))]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            front = [set(np.sort(x)[: len(x) - sj.needed(len(x)) + sj.common(len(x), 32)]) for x in (a, b)]
            assert len(front[0] & front[1]) >= max(sj.common(sj.needed(len(x)), 32) for x in (a, b))


def test_odd_tables(spark, odd, empty, clashing):
    assert sj.similar_documents(empty).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(sj.similar_documents(clashing)) == brute(rows)


def family(n, edits, words, seed=0):
    """Copies of one text, each with some words of its own."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        t = list(base)
        for at in rng.sample(range(words), rng.choice(edits)):
            t[at] = f"x{i}n{at}"
        out.append(" ".join(t))
    return out


def test_a_large_family_does_not_query_its_scattered_copies(spark):
    texts = family(600, [0, 1, 2, 3], words=150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    members = sj.assign_groups(sj.stage_table(sj.group_keys(docs, sj.rarity(sj.stage_table(sj.shingle_sets(docs))))))
    groups = members.select("group").distinct().count()
    assert groups > 5
    others = sj.groups_to_open(members).where("target <> group").count()
    assert others < len(texts), "the sets of the large group query the small ones"
    assert found(sj.similar_documents(docs)) == brute(list(enumerate(texts)))


def test_sets_not_alike_enough_are_told_apart_in_a_large_group():
    import time
    sets = [set(sj.shingle_set(t.encode()).tolist()) for t in family(1500, [9, 12, 15], words=400)]
    group, began = sj.Group(), time.process_time()
    assert not any(group.add(i, s) for i, s in enumerate(sets))
    assert time.process_time() - began < 6
    assert len(group.leaders) == len(sets)
    near = set(list(sets[700])[1:])
    assert group.links(near)[0] == [700]


def test_prefixes_of_linked_sets_share_what_is_asked_for(spark):
    from pyspark.sql import functions as F
    rng, rows = np.random.default_rng(5), []
    for percent in (60, 90, 95, 100):
        for _ in range(250):
            a = rng.choice(5_000, rng.integers(1, 260), replace=False)
            b = np.unique(np.concatenate([a[: len(a) - rng.integers(0, 14)], rng.choice(5_000, rng.integers(0, 14))]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                front = [set(np.sort(x)[: len(x) - sj.needed(len(x), percent) + sj.common(len(x), 32)].tolist()) for x in (a, b)]
                share = len(front[0] & front[1])
                rows += [(percent, len(a), len(b), share), (percent, len(b), len(a), share)]
    df = spark.createDataFrame(rows, "percent int, n long, m long, share long")
    for percent in (60, 90, 95, 100):
        some = df.where(F.col("percent") == percent)
        for low, high in ((F.col("m"), F.col("m")), (F.col("m") - 5, F.col("m") + 9), (F.lit(1), F.lit(400))):
            assert some.where(F.col("share") < sj.least_shared(F.col("n"), low, high, percent)).count() == 0
    assert len(rows) > 400
    exact = spark.range(1).select(sj.least_shared(F.lit(400), F.lit(400), F.lit(400)).alias("x")).first().x
    assert exact > 2 * sj.common(sj.needed(400), 32)


def test_sets_of_many_texts_are_those_of_each():
    import pyarrow as pa
    texts = [None, "", " \t", "one", "ONE", "one two", "one  two\n", "É é", "é é", "a b", "ab c", "a b c", "ab c d", "\x1c a b", "\x0b\x0c a",
             "a\0 b c", "a b c\0", "x" * 1000 + " y", "x" * 1001 + " y", "X" * 1000 + " Y", "end", "start a b c d", *near_texts(40)]
    sets = sj.sets_of(pa.array(texts))
    assert [s.tobytes() for s in sets] == [sj.shingle_set((t or "").encode()).tobytes() for t in texts]
    whole = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in whole]
    for s, w in zip(sets, whole):
        assert [len(np.intersect1d(s, x)) for x in sets] == [len(w & x) for x in whole]
    assert [s.tobytes() for s in sj.sets_of(pa.array(texts)[5:])] == [s.tobytes() for s in sets[5:]] and sj.sets_of(pa.array([], pa.string())) == []
