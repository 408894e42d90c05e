"""Exact, near and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from residua.llm import common, exact_dedup, minhash_dedup, suffix_dedup

from .conftest import SF


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF)


def exact_expected(rows):
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(normal(r.text), []).append(r.doc_id)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted((str(r.doc_id), str(least[normal(r.text)]), len(groups[normal(r.text)]), hashlib.sha256(normal(r.text).encode()).hexdigest()) for r in rows)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, edge, weak):
    digest = (lambda t: F.unhex(F.substring(F.md5(t), 1, 2))) if weak else exact_dedup.sha256
    groups = exact_dedup.exact_groups(edge, digest=digest).collect()
    assert Counter((g.doc_id, g.keep_id, g.group_size) for g in groups) == Counter(
        (None if a == "None" else int(a), None if b == "None" else int(b), n) for a, b, n, _ in exact_expected(edge.collect())
    )
    assert sum(g.kept for g in groups) == len({normal(r.text) for r in edge.collect()})


def test_exact_stream_in_many_batches(docs):
    few, many = (sorted(map(str, exact_dedup.exact_groups(docs, max_bytes=m).select("doc_id", "keep_id", "group_size", "kept").collect())) for m in (8 << 30, 1))
    assert few == many


def test_exact_digest_collisions_over_documents(docs):
    weak = exact_dedup.exact_groups(docs, digest=lambda t: F.unhex(F.substring(F.md5(t), 1, 2))).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(map(str, weak.collect())) == sorted(map(str, exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept").collect()))


def test_exact_dedup_keeps_columns(edge, empty):
    out = exact_dedup.exact_dedup(edge)
    assert out.columns == edge.columns
    assert {(r._rsd_file, r._rsd_row, r._RSD_spans, r._rsd_toxicity) for r in out.collect()} == {(7, 8, 9, 10)}
    assert len({normal(r.text) for r in edge.collect()}) == out.count()
    assert exact_dedup.exact_report(empty).count() == 0


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near_expected(rows):
    sets = [shingle_set(r.text) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            n = len(a & b)
            if a and b and 100 * n >= 85 * (len(a) + len(b) - n):
                root[find(i)] = find(j)
    least: dict[int, list] = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r.doc_id)
    first = lambda ids: min((i for i in ids if i is not None), default=None)
    return Counter((r.doc_id, len(sets[i]), first(least[find(i)])) for i, r in enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"block": 5, "broadcast_rows": 1}])
def test_near_components(docs, edge, options):
    for frame in (docs, edge):
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(frame, **options).collect())
        assert got == near_expected(frame.collect())


def test_near_chain_is_one_component(spark):
    """Neighbours are linked, the ends are not; the centre alone can't join them."""
    words = [f"w{k}" for k in range(300)]
    texts = [(k, " ".join(words[k * 8 : k * 8 + 140])) for k in range(12)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(frame).collect())
    assert got == near_expected(frame.collect()) and {c for _, _, c in got} == {0}


def test_near_dedup_keeps_one(edge, empty):
    out = minhash_dedup.near_dedup(edge)
    assert out.columns == edge.columns and out.where("text like 'alpha0%'").count() == 1
    assert minhash_dedup.near_report(empty).count() == 0


def test_components(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, 90), (90, 95), (200, 201)]
    got = {r.id: r.root for r in minhash_dedup.components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    assert all(got[k] == 0 for k in range(1, 41)) and got[100] == got[95] == 90 and got[201] == 200 and 0 not in got


def removed(texts, gram):
    count = Counter(t[i : i + gram] for t in texts for i in range(len(t) - gram + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - gram + 1):
            if count[t[i : i + gram]] > 1:
                gone[i : i + gram] = [True] * gram
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out


def test_suffix_array():
    rng = np.random.default_rng(3)
    for _ in range(150):
        data = rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(1, 70))).astype(np.uint8)
        raw, order = data.tobytes(), suffix_dedup.suffix_array(data)
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert order.tolist() == want
        shared = suffix_dedup.permuted_prefixes(data, order)
        for a, b in zip(want, want[1:]):
            n = next((k for k in range(len(raw) - max(a, b)) if raw[a + k] != raw[b + k]), len(raw) - max(a, b))
            assert shared[b] == n


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 400}, {"shard_bytes": 3000, "broadcast_rows": 1}])
def test_suffix_report(docs, options):
    rows = docs.collect()
    want = sorted((r.doc_id, *x) for r, x in zip(rows, removed([(r.text or "").encode() for r in rows], 200)))
    assert sorted(tuple(r) for r in suffix_dedup.suffix_report(docs, **options).collect()) == want


def test_suffix_small_grams(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abé"), int(rng.integers(0, 60)))) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted((k, *x) for k, x in enumerate(removed([t.encode() for t in texts], 12)))
    for widths, size in (((3, 1), 24), ((1,), 24), ((3, 1), 1 << 20)):
        assert sorted(tuple(r) for r in suffix_dedup.suffix_report(frame, gram=12, anchor=5, widths=widths, shard_bytes=size).collect()) == want


def test_suffix_edges(edge, empty):
    rows = edge.collect()
    got = Counter(tuple(r)[1:] for r in suffix_dedup.suffix_report(edge).collect())
    assert got == Counter(removed([(r.text or "").encode() for r in rows], 200))
    out = suffix_dedup.suffix_dedup(edge)
    assert out.columns == edge.columns and out.count() == len(rows)
    assert {(r._rsd_file, r._rsd_row, r._RSD_spans) for r in out.collect()} == {(7, 8, 9)}
    assert suffix_dedup.suffix_report(empty).count() == 0


def test_heavy_keys_need_no_lookup_join(spark):
    """A split key's parts follow from the key, so a join with split keys is one join and makes each row once."""
    large = spark.range(4000).selectExpr("if(id < 3000, 7, id) as t1", "cast(id % 2 as int) as t2", "id as v")
    small = large.select("t1", "t2").distinct().withColumn("w", F.col("t1") * 2)
    heavy, total = common.heavy_keys(large.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("c")), ["t1", "t2"], "c")
    assert total == 4000 and len(heavy) == 2 and all(parts >= 375 for _, parts in heavy)
    out = common.spread_join(large, small, ["t1", "t2"], heavy)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
    assert sorted((r.v, r.w) for r in out.collect()) == [(v, 14 if v < 3000 else 2 * v) for v in range(4000)]
    with pytest.raises(TypeError):
        common.spread_join(large, small.withColumn("t2", F.col("t2").cast("long")), ["t1", "t2"], heavy)


def shuffled_bytes(spark):
    """Written by all stages so far."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_near_shuffles_stay_small(spark):
    """Templates with changed words meet in many tables without being linked: halves and full sets go through few shuffles."""
    rng = random.Random(3)
    base = [[f"t{k}w{n}" for n in range(120)] for k in range(60)]
    texts = [" ".join(w if rng.random() > 0.02 else f"x{rng.random()}" for w in base[k % 60]) for k in range(1200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_bytes(spark)
        assert minhash_dedup.near_report(docs).count() == len(texts)
        assert shuffled_bytes(spark) - before < 26 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("options", [{}, {"block": 150_000, "broadcast_rows": 1}])
def test_variants_of_one_text_list_few_pairs(spark, monkeypatch, options):
    """Variants of a text, most of which aren't linked with each other: what is listed doesn't grow with their square, and links among them are found."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(150)]

    def variant(places, tag):
        return " ".join(f"{tag}{k}" if k in places else w for k, w in enumerate(base))

    texts = [variant(set(rng.sample(range(150), rng.randint(2, 4))), f"x{n}y") for n in range(400)]
    # pairs far from the text and near each other, also over a chain of three
    for n in range(10):
        places = rng.sample(range(150), 7)
        texts += [variant(set(places[:k]), f"z{n}y") for k in (4, 5, 6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = []

    def settle(df, name):
        out = common.settle(df, name)
        if name == "near-pairs":
            listed.append(out[0].count())
        return out

    monkeypatch.setattr(minhash_dedup, "settle", settle)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_groups(docs, **options).collect())
    assert got == near_expected(docs.collect())
    assert sum(listed) < 30 * len(texts)


def test_work_of_a_task_is_bounded():
    """Contexts are cut a few MB at a time, and the state stores of an executor share one bound of native memory."""
    parts = list(suffix_dedup._parts_of(np.array([3, 4, 20, 1, 1, 9, 2]), 10))
    assert parts == [(0, 2), (2, 3), (3, 5), (5, 6), (6, 7)]
    assert list(suffix_dedup._parts_of(np.zeros(0, np.int64), 10)) == []
    assert suffix_dedup.BATCH_BYTES <= 16 << 20
    rocks = {k.rsplit(".", 1)[1]: v for k, v in exact_dedup.ROCKS_OPTIONS.items()}
    assert rocks["boundedMemoryUsage"] == "true" and int(rocks["maxMemoryUsageMB"]) <= 256
