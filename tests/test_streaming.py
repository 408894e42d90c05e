from __future__ import annotations

import json

from residua.streaming import resume


def test_ids_are_taken_once(spark, tmp_path):
    folder, target, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    folder.mkdir()

    def put(name, *ids):
        (folder / name).write_text("\n".join(json.dumps({"seq_id": i, "sequence": "ACDEF", "ts": "2024-01-01T00:00:00Z"}) for i in ids))

    put("1.json", "a", "b", "a")
    resume.write_new(resume.new_sequences(spark, str(folder)), target, at).awaitTermination()
    put("2.json", "b", "c")
    resume.write_new(resume.new_sequences(spark, str(folder)), target, at).awaitTermination()
    assert sorted(r.seq_id for r in spark.read.parquet(target).collect()) == ["a", "b", "c"]


def test_an_id_does_not_come_back_behind_the_watermark(spark, tmp_path):
    folder, target, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "at")
    folder.mkdir()
    for k, (day, ids) in enumerate((("01", "ab"), ("20", "c"), ("25", "ad"))):
        (folder / f"{k}.json").write_text("\n".join(json.dumps({"seq_id": i, "sequence": "ACDEF", "ts": f"2024-01-{day}T00:00:00Z"}) for i in ids))
        resume.write_new(resume.new_sequences(spark, str(folder)), target, at).awaitTermination()
    assert sorted(r.seq_id for r in spark.read.parquet(target).collect()) == ["a", "b", "c", "d"]
