"""Structure files to graphs, the older fragmenter, reports and layers against plain loops."""

from __future__ import annotations

import gzip
import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from residua import constants as C
from residua.operators import chains, curate, embed, extract, fragmenter, graphs, layers, reports, topology
from residua.plans import catalogue
from residua.sources import records, structures, tables

SF = "/root/testdata/sf0.001"
RESIDUES = "chain_id string, idx int, aa string, x double, y double, z double, plddt double"


def helix(name, letters, plddt=90.0):
    return [(name, i, a, float(2.3 * np.cos(np.radians(100 * i))), float(2.3 * np.sin(np.radians(100 * i))), 1.5 * i, float(plddt)) for i, a in enumerate(letters)]


def test_cell_contacts_are_all_contacts(spark):
    rng = np.random.default_rng(1)
    places = rng.uniform(-30, 30, (400, 3))
    rows = spark.createDataFrame([("a", i, "A", *map(float, p), 90.0) for i, p in enumerate(places)] + [("a", 400, "A", None, None, None, 90.0)], RESIDUES)
    got = fragmenter.cell_contacts(rows, 8.0, 2).collect()
    want = {(i, j) for i in range(400) for j in range(i + 2, 400) if np.linalg.norm(places[i] - places[j]) <= 8}
    assert len(got) == len(want) > 100 and {(r.i, r.j) for r in got} == want


def pdb_line(idx, atom, name, x, b=90.0, chain="A", kind="ATOM"):
    return f"{kind:<6s}{idx:5d}  {atom:<3s} {name:3s} {chain}{idx:4d}    {x:8.3f}{0:8.3f}{0:8.3f}  1.00{b:6.2f}"


def test_models_and_cif(spark, tmp_path):
    names = ["GLY", "ALA", "SER", "LYS", "LEU", "VAL"]
    model = lambda n: [f"MODEL     {n:4d}", *(pdb_line(i, "CA", a, 3.8 * i) for i, a in enumerate(names[: 4 + n], 1)), pdb_line(9, "CA", "HOH", 1.0, kind="HETATM"), "ENDMDL"]
    (tmp_path / "two.pdb").write_text("\n".join(["HEADER", *model(1), *model(2)]))
    head = ["data_x", "loop_", *(f"_atom_site.{c}" for c in ("group_PDB", "label_atom_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "B_iso_or_equiv", "pdbx_PDB_model_num"))]
    rows = [f"ATOM \"C1'\" GLY B 1 0.0 0.0 0.0 50.0 1", *(f"ATOM CA {a} B {i} {3.8 * i} 0.0 ? 80.0 1" if i == 6 else f"ATOM CA {a} B {i} {3.8 * i} 0.0 1.5 80.0 1" for i, a in enumerate(names, 1))]
    with gzip.open(tmp_path / "one.cif.gz", "wt") as f:
        f.write("\n".join([*head, *rows, "#"]))
    pdb = structures.atoms(spark, str(tmp_path))
    assert sorted((r.model, r["count"]) for r in pdb.groupBy("model").count().collect()) == [(1, 5), (2, 6)]
    assert [(r.chain_id, r.n_residues) for r in structures.chain_lengths(pdb).collect()] == [("A", 6)]
    cif = structures.cif_atoms(spark, str(tmp_path))
    got = sorted((r.res_idx, r.atom, r.residue_name, r.x, r.z, r.b_factor) for r in cif.collect())
    assert got[0] == (1, "C1'", "GLY", 0.0, 0.0, 50.0) and got[-1] == (6, "CA", "VAL", pytest.approx(22.8), None, 80.0) and len(got) == 7
    chains = structures.chain_residues(pdb.unionByName(cif))
    assert {r.chain_id: r["count"] for r in chains.groupBy("chain_id").count().collect()} == {"two_A_1": 5, "two_A_2": 6, "one_B_1": 6}
    assert structures.chain_residues(pdb, least=6).select("chain_id").distinct().count() == 1


def test_extraction_skips_and_fails(spark):
    far = [("far", i, "A", 100.0 * i, 0.0, 0.0, 90.0) for i in range(12)]
    rows = helix("good", "A" * 30) + helix("few", "AAXXXA") + helix("unsure", "A" * 30, 10) + far
    out = extract.extracted(spark.createDataFrame(rows, RESIDUES), by_structure=False)
    report = {r.chain_id: r for r in out.report.collect()}
    assert report["good"].successful == report["good"].fragments > 0 and report["good"].n_edges > 0
    assert report["far"].n_contacts == report["far"].fragments == report["few"].fragments == 0 and report["few"].known == 3
    assert report["unsure"].fragments == report["unsure"].failed > 0 and report["unsure"].n_nodes == 0
    held = {r.graph_id: (r.start, r.end) for r in out.fragments.collect()}
    assert all(5 <= e - s <= 50 for s, e in held.values())
    loose = extract.extracted(spark.createDataFrame(far, RESIDUES), by_structure=False, by_domain=False).report.first()
    assert loose.fragments > 0


def plain_older(name, letters):
    n, coded = len(letters), [0 if a in "AELMQKRH" else 1 if a in "VIYCWFT" else 2 for a in letters]
    if n <= 50:
        return {(0, n, "full")}
    named = lambda ps: {(a, b, f"{a + 1}-{b}") for a, b in ps}
    marks = [0] + [i for i in range(1, n) if coded[i] != coded[i - 1]] + [n]
    runs = [(marks[i], marks[j]) for i in range(len(marks)) for j in (i + 1, i + 2) if j < len(marks) and 10 <= marks[j] - marks[i] <= 50]
    if runs:
        return named(runs)
    drawn = lambda k, what, m: int(hashlib.md5(f"{name}:{k}:{what}".encode()).hexdigest()[:8], 16) % m
    out, start, k = [], 0, 0
    if int(hashlib.md5(name.encode()).hexdigest()[0], 16) < 8:
        while not out or out[-1][1] < n:
            start += drawn(k, "step", 11) + 10 if out else 0
            out.append((start, min(start + 20 + drawn(k, "size", 31), n)))
            k += 1
        return named(out)
    hyd = [dict((r[0], r[1]) for r in C.RESIDUES)[a] for a in letters]
    steps = [abs(np.mean(hyd[i : i + 5]) - np.mean(hyd[i + 5 : i + 10])) for i in range(n - 9)]
    bound = np.mean(steps) + 0.5 * np.std(steps)
    cuts = [0]
    for i in range(1, len(steps) - 1):
        if steps[i] > steps[i - 1] and steps[i] > steps[i + 1] and steps[i] > bound and i + 5 - cuts[-1] >= 10:
            cuts.append(i + 5)
    for a, b in zip(cuts, [*cuts[1:], n]):
        out += [(j, min(j + 50, b)) for j in range(a, b, 25)] if b - a > 50 else [(a, b)]
    return named(out)


def test_older_fragments(spark):
    rng = np.random.default_rng(3)
    chains = {f"c{k}": "".join(rng.choice(list("ARNDCQEGHILKMFPSTWYV"), n)) for k, n in enumerate((7, 50, 51, 300))}
    # no runs of ten: the class changes at every other residue; and one class throughout, longer than a run may be
    chains |= {f"s{k}": "".join("AEVYGS"[(2 * i + int(rng.integers(2))) % 6] for i in range(130)) for k in range(8)} | {f"u{k}": "GP" * 60 for k in range(3)}
    rows = [r for name, letters in chains.items() for r in helix(name, letters)] + helix("tiny", "AAXA")
    got: dict[str, set] = {}
    for r in fragmenter.older_fragments(spark.createDataFrame(rows, RESIDUES)).collect():
        got.setdefault(r.chain_id, set()).add((r.start, r.end, r.frag_id))
    assert got == {name: plain_older(name, letters) for name, letters in chains.items()}


def test_records_of_graphs(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "graph_id").withColumn("v", F.col("graph_id") * 2)
    index = records.write_indexed(rows.coalesce(1), str(tmp_path / "out"), "graph_id", 4)
    sizes = sorted(r["count"] for r in index.groupBy("file").count().collect())
    assert sizes == [2, 4, 4]
    (tmp_path / "out" / "graphs" / "broken.parquet").write_text("no parquet")
    back = records.stored_graphs(spark, str(tmp_path / "out" / "graphs"), "graph_id long, v long")
    assert sorted(r.graph_id for r in back.collect()) == list(range(10))
    wanted = spark.createDataFrame([(3,), (99,)], "graph_id long")
    assert [r.v for r in records.fetched(back.join(index, "graph_id"), wanted, index, "graph_id", "file").collect()] == [6]
    for k, meta in enumerate(({"cached_count": 0, "total_graphs": 7}, {"cached_count": 5, "expected_graph_count": 9}, {})):
        (tmp_path / f"meta{k}.json").write_text(json.dumps(meta))
    assert sorted((r.cached, r.expected) for r in records.cache_counts(spark, str(tmp_path / "meta*.json")).collect()) == [(0, 0), (5, 9), (7, 7)]
    for name in ("batch_2", "batch_1"):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / f"pdb_data_{name}.json").write_text(json.dumps({name: "ACD"}))
        (tmp_path / "in" / name / "other.json").write_text(json.dumps({"no": "ACD"}))
    folders = records.batch_folders(spark, str(tmp_path / "in"))
    assert [f.rsplit("/", 1)[1] for f in folders] == ["batch_1", "batch_2"] and records.batch_folders(spark, folders[0]) == [folders[0]]
    assert sorted(r.seq_id for r in records.sequence_json(spark, folders, ("pdb_data_", "protein_data_chunk_")).collect()) == ["batch_1", "batch_2"]


def test_subset_and_identified(spark):
    assert curate.subset(spark.range(30), F.md5(F.col("id").cast("string")), F.col("id"), ratio=0.1).count() == 10
    assert curate.subset(spark.range(5), F.md5(F.col("id").cast("string")), F.col("id"), ratio=0.1).count() == 5
    rows = spark.createDataFrame([("AC", "p", 1), ("AC", "p", 0), ("AC", None, 2), ("", "q", 3), (None, "r", 4), ("AC", "", 5)], "seq string, name string, k int").withColumn("d", F.lit("set"))
    got = sorted((r.seq_id, r.k) for r in reports.identified(rows, "seq", ["name"], "d", "k").collect())
    tail = hashlib.md5(b"AC").hexdigest()[:8]
    assert got == [("p", 0), (f"set_2_{tail}", 2), (f"set_5_{tail}", 5)]


# ---- layers ----


def test_attention_layer_by_hand():
    rng = np.random.default_rng(0)
    x, edge = rng.normal(size=(4, 3)), rng.normal(size=(5, 2))
    src, dst = np.array([0, 1, 2, 3, 0]), np.array([1, 0, 1, 1, 2])
    w = layers.drawn(0, left=(3, 2, 4), right=(3, 2, 4), edge=(2, 2, 4), score=(2, 4), skip=(3, 8))
    want = np.zeros((4, 8))
    for i in range(4):
        for h in range(2):
            into = [e for e in range(5) if dst[e] == i]
            scores = [sum(w["score"][h, c] * (v if v > 0 else 0.2 * v) for c, v in enumerate(x[src[e]] @ w["left"][:, h] + x[i] @ w["right"][:, h] + edge[e] @ w["edge"][:, h])) for e in into]
            total = sum(np.exp(s) for s in scores)
            for e, s in zip(into, scores):
                want[i, 4 * h : 4 * h + 4] += np.exp(s) / total * (x[src[e]] @ w["left"][:, h])
    want = layers.layer_norm(layers.gelu(want) + x @ w["skip"])
    assert layers.attention_layer(x, src, dst, edge, w) == pytest.approx(want)


def test_layers_by_hand():
    rng = np.random.default_rng(1)
    x, edge, kind = rng.normal(size=(4, 6)), rng.normal(size=(3, 8)), np.array([0, 1, 1])
    src, dst = np.array([0, 1, 2]), np.array([1, 2, 1])
    assert layers.layer_norm(x).mean(axis=1) == pytest.approx(np.zeros(4)) and layers.gelu(np.array([0.0, 1.0])) == pytest.approx([0, 0.8413447])
    w = layers.drawn(1, enter=(2, 20, 5), leave=(2, 5, 8))
    w["enter"], w["leave"] = rng.normal(size=(2, 20, 5)), rng.normal(size=(2, 5, 8))
    got = layers.edge_update(x, src, dst, edge, kind, w)
    for e in range(3):
        joint = np.concatenate([x[src[e]], x[dst[e]], edge[e]])
        assert got[e] == pytest.approx(layers.gelu(layers.layer_norm(joint @ w["enter"][kind[e]])) @ w["leave"][kind[e]])
    q = layers.drawn(2, query=(6, 2, 3), key=(6, 2, 3), value=(6, 2, 3), leave=(6, 6)) | {"bias": rng.normal(size=(3, 2))}
    got, cls = layers.structure_attention(x, src, dst, np.array([0, 1, 2, 0]), q), np.array([0, 1, 2, 0])
    out = np.zeros((4, 6))
    for i in range(4):
        for h in range(2):
            into = [e for e in range(3) if dst[e] == i]
            s = [np.exp((x[i] @ q["query"][:, h]) @ (x[src[e]] @ q["key"][:, h]) / np.sqrt(3) + q["bias"][cls[src[e]], h]) for e in into]
            for e, v in zip(into, s):
                out[i, 3 * h : 3 * h + 3] += v / sum(s) * (x[src[e]] @ q["value"][:, h])
    assert got == pytest.approx(layers.layer_norm(x + out @ q["leave"]))
    g = layers.drawn(3, enter=(8, 16), leave=(16, 1))
    soft, score = layers.edge_gate(edge, g)
    assert soft == pytest.approx(1 / (1 + np.exp(-10 * (score - 0.5)))) and set(layers.edge_gate(edge, g, hard=True)[0].reshape(-1)) <= {0.0, 1.0}
    p = layers.drawn(4, enter=(3, 4), leave=(4, 4))
    code = layers.position_encoding(x[:, :3], src, dst, p)
    unit = lambda a, b: (x[b, :3] - x[a, :3]) / (np.linalg.norm(x[b, :3] - x[a, :3]) + 1e-6)
    assert code[0] == pytest.approx(np.zeros(4)) and code[1] == pytest.approx((layers.mlp(unit(0, 1), p) + layers.mlp(unit(2, 1), p)) / 2)
    a = layers.drawn(5, enter=(6, 6), leave=(6, 1))
    alpha = layers.sigmoid(layers.mlp(x, a))
    assert layers.guided(x, np.ones((4, 1)), a) == pytest.approx(alpha + (1 - alpha) * layers.sigmoid(x.mean(axis=1, keepdims=True)))
    wide = {"encoders": rng.normal(size=(2, 10, 3))}
    assert layers.edge_processing(edge, kind, wide)[0] == pytest.approx(layers.gelu(layers.layer_norm(edge[0] @ wide["encoders"][0, :8])))
    t = {"types": rng.normal(size=(2, 3)), "edge": rng.normal(size=(8, 3))}
    assert layers.edge_encoding(edge, kind, t)[2] == pytest.approx(layers.layer_norm(np.concatenate([t["types"][1], layers.gelu(edge[2] @ t["edge"])])))


def test_fusions():
    rng = np.random.default_rng(2)
    s, g = rng.normal(size=(3, 4)), rng.normal(size=(3, 4))
    none = {k: np.zeros((4, 4)) for k in ("to_seq", "to_graph", "seq_in", "seq_out", "graph_in", "graph_out")}
    fused = layers.cross_fusion(s, g, [none], {"gate": np.zeros((8, 4)), "leave": np.eye(4)})
    twice = lambda v: layers.layer_norm(layers.layer_norm(v)) + v
    assert fused == pytest.approx(layers.layer_norm((twice(s) + twice(g)) / 2))
    w = layers.drawn(0, enter=(10, 6), leave=(6, 4)) | {"bilinear": rng.normal(size=(4, 4, 2))}
    product = np.array([[s[i] @ w["bilinear"][..., k] @ g[i] for k in range(2)] for i in range(3)])
    assert layers.bilinear_fusion(s, g, w) == pytest.approx(layers.layer_norm(layers.mlp(np.concatenate([s, g, product], axis=1), w)))
    p = layers.drawn(1, enter=(8, 6), leave=(6, 4)) | {"residues": rng.normal(size=(20, 2)), **{k: rng.normal(size=2) for k in ("hyd", "chg", "mw")}}
    ranges = {"hyd": (-4.5, 4.5), "chg": (-1.0, 1.0), "mw": (75.0, 204.0)}
    got = layers.physicochemical(np.array([3]), np.array([1.8]), np.array([-1.0]), np.array([204.0]), ranges, p)
    parts = np.concatenate([p["residues"][3], 0.7 * p["hyd"], 0.0 * p["chg"], 1.0 * p["mw"]])
    assert got[0] == pytest.approx(layers.layer_norm(layers.mlp(parts, p)))


def test_latents_and_layers_of_whole_table(spark):
    """q70 and q90 by plain calls for each graph."""
    from residua.operators import encode, graphs
    from residua.sources import tables

    rows = tables.residues(spark, SF)
    held = {r.graph_id: r for r in encode.encoded(graphs.nodes(rows), graphs.edges(rows)).collect()}
    parts = lambda r: (np.array(r.x, float), np.array(r.src), np.array(r.dst), np.array(r.edge_attr, float))
    encoder, stack = encode.Encoder(), layers.stacked()
    latents: dict[int, dict] = {}
    for r in catalogue.q70_graph_latents(spark, SF).collect():
        latents.setdefault(r.graph_id, {})[r.dim] = r.value
    assert latents.keys() == held.keys()
    hidden: dict[int, dict] = {}
    for r in catalogue.q90_attention_layers(spark, SF).collect():
        hidden.setdefault(r.graph_id, {})[r.place] = (r.h0, r.h1)
    for g, r in held.items():
        x, s, d, e = parts(r)
        want = encoder(x, s, d, e)
        assert [latents[g][k] for k in range(len(want))] == pytest.approx(want, abs=1e-3)
        h = stack(x, np.concatenate([s, d]), np.concatenate([d, s]), np.concatenate([e, e]))
        assert np.array([hidden[g][k] for k in range(len(h))]) == pytest.approx(h[:, :2], abs=1e-3)


def test_principal_components(spark):
    v = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()], float)
    _, axes = np.linalg.eigh(np.cov(v.T))
    want = np.abs(v @ axes[:, ::-1][:, :2])
    got = np.array([(r.pc1, r.pc2) for r in catalogue.q71_principal_components(spark, SF).orderBy("vec_id").collect()])
    assert got == pytest.approx(want, abs=1e-3)


# ---- whole chains in NumPy ----


def test_contacts_of_arrays_are_all_contacts():
    rng = np.random.default_rng(2)
    places = rng.uniform(-30, 30, (500, 3))
    i, j = chains.contacts(places, 8.0, 2)
    want = {(i, j) for i in range(500) for j in range(i + 2, 500) if np.linalg.norm(places[i] - places[j]) <= 8}
    assert len(i) == len(want) > 100 and set(zip(i.tolist(), j.tolist())) == want


def test_chains_are_cut_as_residues_are(spark):
    """The array rules against the joins and windows over residues; no chain is shuffled, whatever its length."""
    seqs = tables.chains(spark, SF).where("length(seq) < 1500").limit(60).localCheckpoint()
    rows = tables.residues(spark, SF, seqs.select(F.col("chain_id").alias("doc_id"), "seq")).withColumnRenamed("graph_id", "chain_id").localCheckpoint()
    cut = chains.fragments(seqs, lambda name, letters: chains.by_boundaries(letters, tables.helix)[:2])
    counted = chains.report(seqs, tables.helix)
    for new in (cut, counted):
        assert "Exchange" not in new._jdf.queryExecution().executedPlan().toString()
    old = extract.extracted(rows)
    assert sorted(map(tuple, cut.collect())) == sorted(map(tuple, old.fragments.select("chain_id", "start", "end", "frag_id").collect()))
    assert sorted(map(tuple, counted.collect())) == sorted(map(tuple, old.report.select(counted.columns).collect()))


def test_older_rules_of_arrays():
    rng = np.random.default_rng(3)
    held = {f"c{k}": "".join(rng.choice(list("ARNDCQEGHILKMFPSTWYV"), n)) for k, n in enumerate((51, 300))}
    held |= {f"s{k}": "".join("AEVYGS"[(2 * i + int(rng.integers(2))) % 6] for i in range(130)) for k in range(8)} | {f"u{k}": "GP" * 60 for k in range(3)}
    for name, letters in held.items():
        start, end = chains.by_older_rules(name, np.frombuffer(letters.encode(), np.uint8))
        assert {(a, b, f"{a + 1}-{b}") for a, b in zip(start.tolist(), end.tolist())} == plain_older(name, letters)


def test_a_model_gets_bounded_pieces(spark):
    """The vectors of a batch's other sequences aren't held while a piece is embedded."""

    def model():
        def run(seqs):
            assert sum(map(len, seqs)) <= 140
            return [np.arange(2 * len(s), dtype=np.float32).reshape(-1, 2) for s in seqs]

        return run

    rows = spark.createDataFrame([(k, "A" * (k % 40)) for k in range(200)], "doc_id long, seq string").coalesce(1)
    got = embed.embedded(rows, "doc_id", model, None, 100).collect()
    assert len(got) == 200 and all(r.n == r.doc_id % 40 and r.embedding == [[2.0 * i, 2.0 * i + 1] for i in range(r.n)] for r in got)


def test_graph_sizes_are_those_of_the_edges(spark):
    peptides = tables.peptides(spark, SF)
    new = chains.graph_sizes(peptides.select(F.col("doc_id").alias("graph_id"), "seq"), tables.helix)
    assert "Exchange" not in new._jdf.queryExecution().executedPlan().toString()
    want = graphs.edges(tables.residues(spark, SF)).groupBy("graph_id").agg(F.count(F.lit(1)).alias("e"))
    assert {r.graph_id: r.n_edges for r in new.collect()} == {r.graph_id: r.e for r in want.collect()}


def test_clustering_of_arrays(spark):
    peptides = tables.peptides(spark, SF).where("doc_id < 60")
    new = chains.graph_clustering(peptides.select(F.col("doc_id").alias("graph_id"), "seq"), tables.helix)
    assert "Exchange" not in new._jdf.queryExecution().executedPlan().toString()
    rows = tables.residues(spark, SF, peptides).localCheckpoint()
    want = topology.clustering(rows, graphs.edges(rows))
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, want.select("graph_id", "clustering").collect()))


def test_components_and_paths_of_arrays(spark):
    peptides = tables.peptides(spark, SF).where("doc_id < 60")
    named = peptides.select(F.col("doc_id").alias("graph_id"), "seq")
    rows = tables.residues(spark, SF, peptides).localCheckpoint()
    edges = graphs.edges(rows).localCheckpoint()
    pairs = [
        (chains.graph_components(named, tables.helix), topology.components(rows, edges.where("edge_type >= 3"))),
        (chains.graph_paths(named, tables.helix), topology.path_report(rows, edges.where("edge_type >= 3 or type_name = 'peptide'"))),
    ]
    for new, old in pairs:
        assert "Exchange" not in new._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.select(new.columns).collect()))


def test_attention_layers_build_graphs_in_a_task(spark):
    """Each peptide's graph is built where its layers run: no shuffle, and the rows of the encoded graphs."""
    from residua.operators import encode

    plan = catalogue.q90_attention_layers(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
    rows = spark.createDataFrame([(7, "ACDEFGHIKLMNPQRSTVWYX"), (8, "KKKEE"), (9, "A")], "graph_id long, seq string")
    got = {}
    for r in chains.graph_layers(rows, tables.helix, layers.stacked).collect():
        got.setdefault(r.graph_id, {})[r.place] = r.h
    residues = tables.residues(spark, SF, rows.withColumnRenamed("graph_id", "doc_id"))
    want = {}
    for r in layers.over_graphs(encode.encoded(graphs.nodes(residues), graphs.edges(residues)), layers.stacked).collect():
        want.setdefault(r.graph_id, {})[r.place] = r.h
    assert got.keys() == want.keys() == {7, 8}
    for g, places in want.items():
        assert got[g].keys() == places.keys()
        for k, h in places.items():
            assert got[g][k] == pytest.approx(h, abs=1e-5)


def test_rarest_grams_come_without_a_row_for_each_gram(spark):
    """The order of the grams by the driver and by joins give the same pairs; by the driver no gram of a set is shuffled for it."""
    from residua.operators import dedup

    rows = tables.sequences(spark, SF)
    ranked = dedup.jaccard_pairs(rows)
    assert "collect_list" not in ranked._jdf.queryExecution().optimizedPlan().toString()
    joined = dedup.jaccard_pairs(rows, driver_grams=1)
    assert sorted(map(tuple, ranked.collect())) == sorted(map(tuple, joined.collect())) != []


def _plain_jaccard(rows, threshold=0.6, coverage=0.8):
    """(id1, id2): similarity, by all pairs."""
    grams = [(i, len(t), {t[k : k + 3] for k in range(len(t) - 2)}) for i, t in rows if i is not None and t and len(t) >= 3]
    out = {}
    for i, n, g in grams:
        for j, m, h in grams:
            alike = len(g & h) / len(g | h)
            if i < j and n // 5 == m // 5 and alike >= threshold and min(n, m) / max(n, m) >= coverage:
                out[i, j] = round(alike, 6)
    return out


def _odd_sequences():
    rng = np.random.default_rng(5)
    base = ["".join(rng.choice(list("ACDEFGHIKLMNPQRSTVWY"), n)) for n in (5, 9, 40, 41, 44, 300)]
    texts = [t[:p] + rng.choice(list("ACDY")) + t[p + 1 :] for t in base for p in rng.integers(0, len(t), 12)]
    texts += [base[2]] * 30 + ["AAAAA", "AAAAAAAA", "ACACACAC", "AC", "A", "", None, "ACDEF\U0001f600" * 7, "ACDEF\U0001f600" * 7, "ACDEF\U0001f600" * 6 + "ACDEFX", "abcXZ" * 8, "abcXZ" * 8]
    return [*enumerate(texts), (None, base[2]), (None, base[3])]


def test_similar_sets_are_shuffled_once_and_no_pair_is(spark):
    """q08's tasks compare whole parts of buckets: the packed sets are shuffled once, beside them only each bucket's weight, and no join is shuffled."""
    plan = catalogue.q08_jaccard_pairs(spark, SF)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffles) == 2 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert sum("bucket" in line and ", i#" in line for line in shuffles) == 1 and "FlatMapGroupsInArrow" in plan


@pytest.mark.parametrize("bounds, driver_grams", [(None, 20_000), (None, 1), ((3000, 3000), 20_000), ((3000, 3000), 1)])
def test_similar_sets_of_odd_sequences(spark, bounds, driver_grams):
    """Copies, other letters, rows without an id and short ones, in one part or several of a bucket: the pairs of a plain pass."""
    from residua.operators import dedup, similar

    rows = _odd_sequences()
    seqs = spark.createDataFrame(rows, "doc_id long, seq string").withColumn("len", F.length("seq"))
    if bounds:
        sets = similar.gram_sets(seqs, "doc_id", similar.GRAMS <= driver_grams)
        assert similar.in_parts(sets, bounds).where("i > 2").count() > 0
        got = similar.similar_pairs(sets, 0.6, 0.8, bounds).withColumn("jaccard", F.round("jaccard", 6)).collect()
    else:
        got = dedup.jaccard_pairs(seqs, driver_grams=driver_grams).collect()
    assert {(r.id1, r.id2): r.jaccard for r in got} == _plain_jaccard(rows)
    assert len(got) == len(_plain_jaccard(rows)) > 400


def test_similar_sets_in_small_blocks(monkeypatch):
    """Blocks, columns and batches of a few: nothing is lost or doubled at their edges."""
    from residua.operators import similar

    for name, value in (("BLOCK", 7), ("WIDTH", 11), ("PAIRS", 5)):
        monkeypatch.setattr(similar, name, value)
    rows = [(i, t) for i, t in _odd_sequences() if i is not None and t and len(t) >= 3]
    for parts in (1, 2):
        for bits in (True, False):
            got = []
            for bucket in {len(t) // 5 for _, t in rows}:
                own = [(i, t) for i, t in rows if len(t) // 5 == bucket]
                for i, j in [(0, 0), (1, 0), (1, 1)][: 2 * parts - 1]:
                    group = [(k, t) for k, t in own if k % parts in (i, j)]
                    if group:
                        batch = pa.RecordBatch.from_pydict({
                            "i": [i] * len(group), "j": [j] * len(group), "part": [k % parts for k, _ in group], "id": [k for k, _ in group],
                            "len": [len(t) for _, t in group], "grams": pa.array([similar.packed(t, bits) for _, t in group], pa.binary()),
                        })
                        for out in similar.similar_rows(0.6, 0.8)(iter([batch])):
                            got += [(min(x, y), max(x, y), round(s, 6)) for x, y, s in zip(*(c.to_pylist() for c in out.columns), strict=True)]
            assert sorted(got) == sorted((x, y, s) for (x, y), s in _plain_jaccard(rows).items())
