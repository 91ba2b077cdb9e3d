import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from strata.llm import language, packing, registry, simhash, stages


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns, name
        if name == "language_id":
            assert docs.count() >= 0.99 * n
        if name == "simhash_near_dedup":
            near = simhash.near_duplicates(before)
            assert docs.count() == near.select("component_id").distinct().count()
    last = corpus_pipeline.STAGES[4][1](spark, docs, "")
    tokens = last.groupBy().sum("length").first()[0]
    assert tokens == sum(r.doc_tokens * k for r, k in Counter(last.where("start = 0").select("doc_tokens").collect()).items())


def test_pipeline_survives_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for name, df in (("odd", odd), ("empty", empty)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").count()
        assert rows > 0 if name == "odd" else rows == 0


def test_all_are_registered():
    assert sorted(int(x[2:].split("_")[0]) for x in registry.QUERIES) == list(range(1, 14))


def test_stages_leave_their_outputs_alone(spark, odd, tmp_path):
    from pathlib import Path
    from strata.session import ensure_checkpoint_dir
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    corpus_pipeline.run(spark, str(tmp_path)).count()
    left = sorted(p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before)
    assert left == sorted(f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES)


# -- every stage against a brute-force version of it, on what the stage before left -----------------
def brute_lines(rows):
    first = {}
    split = {(r["doc_id"], r["text"]): r["text"].split("\n") for r in rows}
    for key in sorted(split):
        ls = split[key]
        for i in range(len(ls) - 2):
            if any(x.strip(" ") for x in ls[i: i + 3]):
                first.setdefault(tuple(ls[i: i + 3]), (key[0], i))
    out = {}
    for key, ls in split.items():
        gone = {i + k for i in range(len(ls) - 2) if any(x.strip(" ") for x in ls[i: i + 3])
                and first[tuple(ls[i: i + 3])] != (key[0], i) for k in range(3)}
        out[key] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return Counter((r["doc_id"], out[r["doc_id"], r["text"]]) for r in rows)


def brute_near(rows):
    fps = np.array(simhash.fingerprints_of([(r["text"] or "").encode() for r in rows]), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= simhash.MAX_BITS
    label = np.arange(len(rows))
    while not np.array_equal(new := np.where(near, label[None], 1 << 60).min(1), label):
        label = new
    groups = defaultdict(list)
    for r, g in zip(rows, label.tolist()):
        groups[g].append(r["doc_id"])
    return sorted(min(ids) for ids in groups.values())


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, [r.asDict() for r in docs.collect()])
    # language ID: what is rejected has no letter or no clear language
    before, after = seen["language_id"]
    model = language.train(spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in before], "doc_id long, text string, lang string"))
    want = [r["doc_id"] for r, (lang, score) in zip(before, model.predict([language.normalise(r["text"]) for r in before]))
            if lang != "und" and score >= stages.MIN_LANG_SCORE]
    assert sorted(r["doc_id"] for r in after) == sorted(want)
    before, after = seen["line_dedup"]
    assert Counter((r["doc_id"], r["text"]) for r in after) == brute_lines(before)
    before, after = seen["simhash_near_dedup"]
    assert sorted(r["doc_id"] for r in after) == brute_near(before)
    # mixing: whole documents, at most three times, each source near its target
    before, after = seen["mixing"]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in before}
    source = {r["doc_id"]: r["source"] for r in before}
    copies = Counter(r["doc_id"] for r in after)
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    total, weight = Counter(), {}
    for d, n in size.items():
        total[source[d]] += n
    for i, s in enumerate(sorted(total, key=lambda s: (s is None, s))):
        weight[s] = i % 3 + 1
    target, open_, left = {}, set(total), sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 3 * total[s]]
        for s in over or list(open_):
            target[s] = 3 * total[s] if over else share[s]
            open_.discard(s)
            left -= target[s] if over else 0
    taken = Counter()
    for d, k in copies.items():
        taken[source[d]] += k * size[d]
    for s in total:
        assert taken[s] <= target[s] + 1e-6, s
        # what is left is less than any document that could still be added once
        whole = int(target[s] // total[s])
        rest = [n for d, n in size.items() if source[d] == s and copies[d] == whole < 3]
        assert not rest or target[s] - taken[s] < min(rest), s
    # packing: the ids of every document, each sequence without a gap
    before, after = seen["packing"]
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(registry.tokenizer_path())
    want = defaultdict(list)
    for r in before:
        want[r["doc_id"]].append(np.array(tokenizer.encode(r["text"], add_special_tokens=False).ids + [2], "<u4"))
    sequences = defaultdict(list)
    for p in after:
        crcs = {zlib.crc32(ids[p["start"]: p["start"] + p["length"]].tobytes()) for ids in want[p["doc_id"]] if len(ids) == p["doc_tokens"]}
        assert p["ids_crc32"] in crcs
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert sum(p["length"] for p in after) == sum(len(ids) for own in want.values() for ids in own)
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_stages_with_clashing_columns(spark, odd, empty, clashing):
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, clashing, "")
        assert out.columns == clashing.columns and (name == "mixing" or out.count() <= clashing.count()), name
        assert stage(spark, empty, "").columns == empty.columns
    assert corpus_pipeline.STAGES[4][1](spark, clashing, "").count() > 0


def test_kept_rows_do_not_depend_on_partitions(spark):
    rows = [(1, "a b c d e f", x) for x in "zxy"] + [(2, "other words stand here now", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    for n in (1, 2, 3, 7):
        assert sorted(r.extra for r in simhash.keep_first(df.repartition(n)).collect()) == ["q", "x"]
