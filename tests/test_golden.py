"""Hand-derived values of the descriptors and rules."""

from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from residua.functions import sequence as S
from residua.functions import vectors as V
from residua.operators import boundaries, curate, joins
from residua.sources import records, structures

GOLDEN = {
    "GIGKFLHSAKKFGKAFVGEIMNS": (0.082609, 3.1, 1.456712, 1.009565, 0.434783),
    "AAAA": (1.8, 0, 0.173997, 1.41, 1.0),
    "KKDDX": (-2.96, 0, 0.33677, 0.884, 0.0),
    "K": (-3.9, 1, 3.9, 1.23, 0.0),
    "GIGAVLKVLTTGLPALISWIKRKRQQ": (0.273077, 5, 1.291063, 1.011538, 0.461538),
}


def test_descriptors(spark):
    seq, n = F.col("seq"), F.greatest(F.length("seq"), F.lit(1))
    rows = spark.createDataFrame([(s,) for s in [*GOLDEN, "", None]], "seq string").withColumn("d", S.descriptors(seq))
    for r in rows.select("seq", F.col("d.hyd") / n, "d.chg", "d.moment", F.col("d.helix") / n, S.count_of(seq, "AFILMVWY") / n, "d").collect():
        if r.seq:
            assert tuple(r)[1:6] == pytest.approx(GOLDEN[r.seq], abs=1e-6)
        else:
            assert tuple(r.d) == (0.0, 0.0, 0.0, 0.0)


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_rules(spark):
    of = lambda *v: F.array(*(F.lit(float(x)) for x in v))
    assert one(spark, S.seq_hash(F.lit(""))) == ("a2e4822a98337283e39f7b60acf85ec9",)
    assert one(spark, *(S.length_range(F.lit(n)) for n in (10, 11, 50, 51, 501))) == ("0-10", "11-20", "41-50", "51-100", ">=501")
    fixed = one(spark, *(V.repaired_one_hot(v) for v in (of(0, 0, 0, 0), of(1, 1, 0, 0), of(0, 0.2, 0.9, 0), of(0.5, 0.5, 0, 0))))
    assert fixed == ([1, 0, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0.5, 0.5, 0, 0])
    v85, v73 = of(*range(85)), of(*range(73))
    assert one(spark, V.hybrid_similarity(v85, v85), V.hybrid_similarity(v73, v73)) == pytest.approx((1.0, 0.977778), abs=1e-6)
    assert one(spark, V.binned(F.lit(1.8), -4.5, 4.5)) == (0.6,)
    assert one(spark, S.kmers(F.lit("AB")), S.kmers(F.lit("ABCD"))) == ([], ["ABC", "BCD"])
    assert one(spark, S.tokens(F.lit("")), S.tokens(F.lit("LXA"))) == ([0, 5, 2], [0, 4, 5, 2])
    windows = one(spark, boundaries.windows(F.lit(120)))[0]
    assert [tuple(w) for w in windows] == [(0, 50), (25, 75), (50, 100), (75, 120)]
    assert one(spark, boundaries.min_gap(F.array(*map(F.lit, (1, 3, 6, 10, 12))), 5)) == ([1, 6, 12],)


@pytest.mark.parametrize(("n", "sizes"), [(10, (7, 2, 1)), (11, (7, 2, 2)), (1, (0, 0, 1))])
def test_split_sizes(spark, n, sizes):
    rows = curate.split(spark.range(n), F.md5(F.col("id").cast("string")), F.col("id")).groupBy("split").count().collect()
    got = {r["split"]: r["count"] for r in rows}
    assert tuple(got.get(s, 0) for s in ("train", "val", "test")) == sizes


def test_structures(spark, tmp_path):
    line = lambda n, atom, name, idx, x, b: f"ATOM  {n:5d}  {atom:<3s} {name:3s} A{idx:4d}    {x:8.3f}{0:8.3f}{0:8.3f}  1.00{b:6.2f}"
    text = "\n".join([line(1, "N", "GLY", 1, 0.0, 80), line(2, "CA", "GLY", 1, 1.5, 90), line(3, "N", "FOO", 2, 3.0, 60), "TER"])
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdb").write_text(text)
    with gzip.open(tmp_path / "sub" / "a.pdb.gz", "wt") as f:
        f.write(text)
    with gzip.open(tmp_path / "sub" / "b.pdb.gz", "wt") as f:
        f.write(text)
    assert sorted(r.stem for r in structures.structure_files(spark, str(tmp_path)).collect()) == ["a", "b"]
    rows = {r.res_idx: r for r in structures.residues_of(structures.atoms(spark, str(tmp_path)).where("protein_id = 'b'")).collect()}
    assert (rows[1].residue_code, rows[1].x, rows[1].plddt) == ("G", 1.5, 85.0)
    assert (rows[2].residue_code, rows[2].x, rows[2].plddt) == ("X", None, 60.0)


def test_records(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"p1": {"sequence": "ACD", "length": 3}, "p2": "GG"}))
    assert {r.seq_id: r.sequence for r in records.sequence_json(spark, str(tmp_path)).collect()} == {"p1": "ACD", "p2": "GG"}
    for k, shape in enumerate((["a", "b"], {"retained_ids": ["a", "b"]}, {"a": {"x": 1}, "b": {}})):
        (tmp_path / f"ids{k}.txt").write_text(json.dumps(shape))
        assert {r.retained_id for r in records.retained_ids(spark, str(tmp_path / f"ids{k}.txt")).collect()} == {"a", "b"}
    chunks = records.write_chunks(spark.range(10), str(tmp_path / "out"), per_file=2).collect()
    assert sum(r["rows"] for r in chunks) == 10 and max(r["rows"] for r in chunks) <= 2


def test_joins(spark):
    rows = lambda *v: spark.createDataFrame(list(v), "id long, v string")
    old, new = rows((1, "a"), (2, "b")), rows((2, "c"), (3, "d"))
    assert sorted(tuple(r) for r in joins.upsert(old, new, "id").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    got = joins.read_through(spark.createDataFrame([(1,), (3,)], "id long"), old, new, "id").collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", "cache"), (3, "d", "source")]
    assert [r.id for r in joins.resume(old, new, "id").collect()] == [1]
    assert joins.resume(old, new, "id", force=True).count() == 2
