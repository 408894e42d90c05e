"""Every query with an oracle gives DuckDB's rows on the smallest tables; the others keep their invariants."""

from __future__ import annotations

import os

import duckdb
import pytest

from residua.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    clean = lambda v: round(v, 6) if isinstance(v, float) else str(v) if v is not None and v == v else None
    return sorted([str([clean(v) for v in r]) for r in frame.where(frame.notna(), None).itertuples(index=False, name=None)])


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_oracle(spark, duck, name):
    mine, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    numbers = lambda rows: [r.replace(".0'", "'") for r in rows]
    assert numbers(rows_of(mine.astype(float, errors="ignore"))) == numbers(rows_of(theirs.astype(float, errors="ignore")))


def test_greedy_dedup_keeps_a_cover(spark):
    """What is kept is the pass's own result, by a plain loop over the same bands."""
    from residua.operators import dedup
    from residua.session import checkpointed
    from residua.sources import tables

    seqs = tables.sequences(checkpointed(spark), SF)
    members = dedup.band_members(seqs, 12, 2).cache()
    got = {r.id for r in dedup.greedy_retained(members).collect()}
    bands: dict[int, set] = {}
    length = {}
    for r in members.collect():
        bands.setdefault(r.id, set()).add((r.bucket, r.band))
        length[r.id] = r.len
    kept: list[int] = []
    for i in sorted(bands, key=lambda i: (-length[i], i)):
        near = [k for k in kept if bands[k] & bands[i]]
        if not near or not all(min(length[k], length[i]) / max(length[k], length[i]) >= 0.8 for k in near):
            kept.append(i)
    assert got == set(kept) and len(kept) < len(bands)


def test_graph_dedup_strikes_out_partners(spark):
    from pyspark.sql import functions as F

    from residua.operators import cluster
    from residua.session import checkpointed

    checkpointed(spark)
    pairs = [(1, 2), (2, 3), (3, 4), (5, 6), (1, 5)]
    items = spark.range(1, 8).withColumn("ord", F.struct("id"))
    both = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "i long, j long")
    assert {r.id for r in cluster.greedy_unmarked(items, both).collect()} == {1, 3, 6, 7}


def test_similar_pairs_are_all_pairs(spark):
    """Partners with far ids, and a group of more than 100, against a plain loop."""
    import numpy as np

    from residua import constants as C
    from residua.operators import cluster

    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 85))
    # partners of row k at 100,000 + k, at all distances about the threshold, and 130 near copies of row 0
    far = base + rng.normal(size=base.shape) * np.linspace(0.01, 1.2, 30)[:, None]
    vectors = {**dict(enumerate(base)), **{100_000 + k: v for k, v in enumerate(far)}, **{1000 + k: base[0] + rng.normal(size=85) * 0.01 for k in range(130)}}
    vectors[7] = vectors[7][:73]

    def sim(a, b):
        out = 0.0
        for _, start, n, scale, weight in C.VECTOR_SLICES:
            x, y = a[start : start + n], b[start : start + n]
            some = min(len(x), len(y))
            out += weight / (1 + (np.linalg.norm(x[:some] - y[:some]) if some else 1.0) / scale)
        return out

    want = {(i, j) for i, a in vectors.items() for j, b in vectors.items() if i != j and sim(a, b) > 0.85}
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "id long, v array<double>")
    got = cluster.similar_pairs(frame).select("i", "j").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert len(want) > 130 * 129 and any(abs(i - j) == 100_000 for i, j in want)


def test_graph_dedup_lists_no_pairs(spark):
    """The rounds keep what the pass over all listed pairs keeps, with vectors of two lengths and a dense group."""
    import numpy as np
    from pyspark.sql import functions as F

    from residua.operators import cluster
    from residua.session import checkpointed

    checkpointed(spark)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 85))
    vectors = [base[k % 12] + rng.normal(size=85) * rng.uniform(0, 0.9) for k in range(150)]
    vectors = [v[:73] if k % 7 == 0 else v for k, v in enumerate(vectors)] + [vectors[3]] * 20
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, v array<double>")
    items = frame.select("id", F.struct((-F.col("v")[0]).alias("c"), "id").alias("ord"), "v")
    want = sorted(r.id for r in cluster.greedy_unmarked(items, cluster.similar_pairs(frame)).collect())
    assert 12 < len(want) < 150
    for block, cells in ((4096, 1 << 21), (16, 50)):
        assert sorted(r.id for r in cluster.greedy_dissimilar(items, block=block, cells=cells).collect()) == want
    assert cluster.greedy_dissimilar(items.where("false")).count() == 0


def test_path_report(spark):
    from residua.operators import topology

    nodes = spark.createDataFrame([(1, i) for i in range(4)] + [(2, i) for i in range(3)], "graph_id long, idx int")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 1)], "graph_id long, src int, dst int")
    got = {r.graph_id: (r.n_components, r.sizes, r.diameter, r.mean_path) for r in topology.path_report(nodes, edges).collect()}
    assert got == {1: (1, "4", 3, round(20 / 12, 6)), 2: (2, "2,1", None, None)}


def test_packing_spreads_load(spark):
    from residua.operators import embed

    files = spark.createDataFrame([(f"f{k}", k) for k in (10, 9, 8, 7, 3, 3)], "file string, size long")
    rows = embed.lpt_packed(files, 2).collect()
    loads = {}
    for r in rows:
        loads[r.worker] = loads.get(r.worker, 0) + r.size
    assert sorted(loads.values()) == [20, 20]


def test_random_windows_cover(spark):
    rows = catalogue.q41_random_windows(spark, SF).collect()
    chains = {r.chain_id: r.n for r in catalogue._chains(spark, SF).collect()}
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.chain_id, r.start)):
        assert r.start == 0 or r.start <= ends[r.chain_id]
        ends[r.chain_id] = max(ends.get(r.chain_id, 0), r.end)
    assert ends == chains


def test_embedding_lengths(spark):
    seqs = {r.doc_id: r.len for r in __import__("residua.sources.tables", fromlist=["x"]).sequences(spark, SF).collect()}
    assert {r.doc_id: r.n for r in catalogue.q60_embedding_stub(spark, SF).collect()} == seqs


def test_kmeans_assigns_everything(spark):
    rows = catalogue.q27_kmeans(spark, SF).collect()
    assert len(rows) == 4 and sum(r.n for r in rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
