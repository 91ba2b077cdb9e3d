"""Fill-in-the-middle: round trip, brute force on code points, chunk cache."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from strata.llm import fill_middle as fm


def brute(doc_id, text):
    t = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i: 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (len(t), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (len(t), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def whole(text, cache):
    data = np.frombuffer(text.encode(), np.uint8)
    ends = fm.borders(data)
    bounds = fm.chunk_bounds(data.tobytes(), 0, len(data), ends[ends >= fm.WINDOW].tolist())
    return fm.Combined(data.tobytes(), bounds, cache)


def random_texts(n=300):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdé中\U0001f600 <PSM>") for _ in range(4000))
    out = []
    for _ in range(n):
        at, size = rng.randrange(3000), rng.randrange(1, 1000)
        out.append("".join(rng.choice("xyz<SPM>é ") for _ in range(rng.randrange(300))) + shared[at: at + size])
    return out


def test_combined_summaries_and_cuts():
    cache = fm.ChunkCache()
    for t in [*random_texts(), "", "a", "é" * 300_000, "<" * 5000, "x" * 200_000 + "<P>", "\0" * 90_000]:
        w = whole(t, cache)
        assert w.points == len(t) and w.sentinel == any(s in t for s in ("<P>", "<S>", "<M>"))
        assert b"".join(w.raw[a:b] for a, b in zip(w.bounds, w.bounds[1:])).decode() == t
        assert max(b - a for a, b in zip(w.bounds, w.bounds[1:])) <= fm.LARGEST + 4
        for k in {0, len(t) // 3, len(t) // 2, max(0, len(t) - 1), len(t)}:
            assert w.byte_at(k) == len(t[:k].encode())
    assert cache.hits


def test_sentinels_across_borders():
    cache = fm.ChunkCache()
    for raw in (b"ab<P>cd", b"<S>", b"<M", b"<<P><", b"<M<S"):
        for i in range(len(raw) + 1):
            for j in range(i, len(raw) + 1):
                w = fm.Combined(raw, [0, i, j, len(raw)], cache)
                assert w.sentinel == any(s in raw for s in fm.SENTINELS)


def test_shared_passages_share_chunks_and_hash_ties_do_not_matter(monkeypatch):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    one, two = fm.ChunkCache(), fm.ChunkCache()
    whole("12345" + passage, one)
    before = one.misses
    whole("another start" + passage, one)
    assert one.misses - before <= 2 < before
    monkeypatch.setattr(fm.xxhash, "xxh3_64_intdigest", lambda chunk: 7)
    assert whole("é" + passage, two).points == 40_001 and whole(passage, two).points == 40_000


def test_a_full_cache_starts_anew():
    cache = fm.ChunkCache(limit=5000)
    for t in random_texts(50):
        assert whole(t, cache).points == len(t) and cache.used <= 5000


def test_transform_against_brute_force(spark, odd):
    rows = [(i, t) for i, t in enumerate(random_texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    out = fm.transform(df).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect()
    expected = sorted(((r.doc_id, *brute(r.doc_id, r.text), r.text or "") for r in df.collect()), key=str)
    assert sorted((tuple(r) for r in out), key=str) == expected
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_odd_tables(odd, empty, clashing):
    assert fm.transform(empty).count() == 0
    out = fm.transform(clashing)
    assert len(out.collect()) == odd.count()
    assert set(out.columns) == (set(clashing.columns) - {"text"}) | set(fm.RESULT)


def test_cache_counts_its_entries():
    """Many short chunks: what an entry takes beside its bytes counts too."""
    cache = fm.ChunkCache(limit=20_000)
    for i in range(2_000):
        cache.summary(b"%064d" % i)
        assert len(cache.kept) * (64 + fm.ENTRY_BYTES) <= 20_000


def test_restored_without_patterns(spark):
    """Texts are put together again as bytes, whatever they hold around the
    sentinels, and no pattern is run over a decoded text."""
    rows = [(i, t) for t in ("", "a", "héé <S <P M> <> ñ", "\n\t<<>>", "日本語" * 40, "x" * 500) for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = fm.transform(df.withColumn("was", F.col("text"))).withColumn("back", fm.restored(F.col("output"), F.col("form")))
    got = out.select("was", "back", "form").collect()
    assert {r.form for r in got} == {"plain", "psm", "spm"} and all(r.was == r.back for r in got)
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_slices_give_memory_back(monkeypatch):
    import pyarrow as pa
    from strata.llm import common
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    batch = pa.record_batch({"text": pa.array(["x" * 100] * 50)})
    assert sum(b.num_rows for b in common.text_slices(iter([batch, batch]), "text", 1000)) == 100
    assert len(calls) >= 10
