from __future__ import annotations

import corpus_pipeline
from residua.llm import common, minhash_dedup

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_whole_rows(spark):
    docs = common.documents(spark, SF)
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, _ = common.settle(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0] and counts[3] == counts[4]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    assert corpus_pipeline.run(spark, SF).count() == packed.count()


def test_near_stage_links_at_eighty_percent(spark):
    """Four scattered substitutions in 200 shingles: 180 of 220 are shared, 0.82. op2 keeps its own 0.85."""
    pairs = []
    for k in range(20):
        words = [f"w{k}x{n}" for n in range(204)]
        other = [f"new{k}x{n}" if n in (30, 80, 130, 180) else w for n, w in enumerate(words)]
        pairs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, SF).collect()) == list(range(0, 40, 2))
    assert {r.component_id for r in minhash_dedup.near_report(docs).collect()} == set(range(40))


def test_bands_keep_the_miss_chance():
    chance = lambda s, b: 1 - (1 - (1 - s**minhash_dedup.WIDTH) ** b) ** 2
    assert minhash_dedup.bands_for(85) == 12
    for percent in (60, 80, 85, 95):
        b = minhash_dedup.bands_for(percent)
        assert chance(percent / 100, b) < minhash_dedup.MISS <= chance(percent / 100, b - 1)
