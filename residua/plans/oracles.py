"""DuckDB building blocks of the oracle queries."""

from __future__ import annotations

from residua import constants as C

_WHOLE = "regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"
SEQS = f"seqs AS (SELECT doc_id, seq, length(seq) AS len FROM (SELECT doc_id, {_WHOLE} AS seq FROM documents) WHERE length(seq) >= 5)"
PEPTIDES = f"seqs AS (SELECT doc_id, seq, length(seq) AS len FROM (SELECT doc_id, substring({_WHOLE}, 1, (5 + doc_id % 46)::INT) AS seq FROM documents) WHERE length(seq) >= 5)"
CHAINS = f"{SEQS}, chains AS (SELECT doc_id AS chain_id, seq, len AS n FROM seqs)"
PROPS = "props(aa, hyd, chg, mw, vol, flex, arom, helix) AS (SELECT c0, " + ", ".join(f"c{k}::DOUBLE" for k in range(1, 8)) + " FROM (VALUES " + ", ".join(str(r) for r in C.RESIDUES) + ") t(c0, c1, c2, c3, c4, c5, c6, c7))"
_LETTERS = f"{PROPS}, letters AS (SELECT doc_id, len, idx, substr(seq, idx + 1, 1) AS aa FROM (SELECT *, unnest(range(0, len))::INT AS idx FROM seqs))"
LETTERS, SHORT_LETTERS = f"{SEQS}, {_LETTERS}", f"{PEPTIDES}, {_LETTERS}"
KMERS = f"{SEQS}, kmers AS (SELECT doc_id, len, len // 5 AS bucket, pos, substr(seq, pos + 1, 3) AS kmer FROM (SELECT *, unnest(range(0, len - 2))::INT AS pos FROM seqs))"
PLDDT = "(50 + (ascii(aa) * 7 + idx * 13) % 50)::DOUBLE AS plddt"
RESIDUES = f"""{SHORT_LETTERS}, residues AS (
    SELECT doc_id AS graph_id, idx, aa, round(2.3 * cos(radians(100.0 * idx)), 6) AS x, round(2.3 * sin(radians(100.0 * idx)), 6) AS y, round(1.5 * idx, 6)::DOUBLE AS z,
           {PLDDT} FROM letters)"""
PLACED = f"""{RESIDUES}, centred AS (
    SELECT graph_id, idx, aa, plddt, x - avg(x) OVER g AS x, y - avg(y) OVER g AS y, z - avg(z) OVER g AS z FROM residues WINDOW g AS (PARTITION BY graph_id)
), placed AS (
    SELECT graph_id, idx, aa, plddt, x / far AS x, y / far AS y, z / far AS z FROM (SELECT *, max(sqrt(x * x + y * y + z * z)) OVER (PARTITION BY graph_id) AS far FROM centred))"""


def _in(column: str, letters: str) -> str:
    return f"contains('{letters}', {column})"


def _either(s: str, t: str) -> str:
    return f"(({_in('p', s)} AND {_in('q', t)}) OR ({_in('p', t)} AND {_in('q', s)}))"


_NAME = " ".join(f"WHEN {t} THEN '{n}'" for t, (n, _) in C.CONTACTS.items())
_STRENGTH = " ".join(f"WHEN {t} THEN {s}" for t, (_, s) in C.CONTACTS.items())
EDGES = f"""{PLACED}, pairs AS (
    SELECT a.graph_id, a.idx AS i, b.idx AS j, a.aa AS p, b.aa AS q, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, b.x - a.x AS dx, b.y - a.y AS dy
    FROM placed a JOIN placed b ON a.graph_id = b.graph_id AND a.idx <> b.idx
), near AS (
    SELECT *, row_number() OVER (PARTITION BY graph_id, i ORDER BY round(d, 5), j) AS r, count(*) OVER (PARTITION BY graph_id, i) AS others FROM pairs
), typed AS (
    SELECT *, CASE WHEN {_either(C.POSITIVE, C.NEGATIVE)} AND d < 6 THEN 3 WHEN {_in('p', C.GREASY)} AND {_in('q', C.GREASY)} AND d < 6 THEN 4
                   WHEN {_either(C.DONORS, C.ACCEPTORS)} AND d < 5 THEN 2 WHEN d <= 8 THEN 1 ELSE 0 END AS edge_type
    FROM near WHERE r <= least(8, greatest(2, others)) AND d <= 8 AND abs(i - j) > 1
), once AS (
    SELECT graph_id, least(i, j) AS src, greatest(i, j) AS dst, arg_max(edge_type, i) AS edge_type, arg_max(d, i) AS distance,
           arg_max(CASE WHEN d > 0 THEN dx / d ELSE 0 END, i) AS dir_x, arg_max(CASE WHEN d > 0 THEN dy / d ELSE 0 END, i) AS dir_y
    FROM typed WHERE edge_type > 0 GROUP BY ALL
), chain AS (
    SELECT graph_id, idx AS src, lead(idx) OVER w AS dst, sqrt((x - lead(x) OVER w) ** 2 + (y - lead(y) OVER w) ** 2 + (z - lead(z) OVER w) ** 2) AS distance
    FROM placed WINDOW w AS (PARTITION BY graph_id ORDER BY idx)
), edges AS (
    SELECT graph_id, src, dst, 1 AS edge_type, 'peptide' AS type_name, distance, 1.0::DOUBLE AS strength, 1.0::DOUBLE AS dir_x, 0.0::DOUBLE AS dir_y FROM chain WHERE dst = src + 1
    UNION ALL
    SELECT graph_id, src, dst, edge_type, CASE edge_type {_NAME} END, distance, (CASE edge_type {_STRENGTH} END)::DOUBLE, dir_x, dir_y FROM once)"""
_SS = "CASE WHEN contains('AELMQKRH', aa) THEN 0 WHEN contains('VIYCWFT', aa) THEN 1 ELSE 2 END"
BLOSUM = "blosum(aa, b) AS (VALUES " + ", ".join(f"('{a}', {row})" for a, row in C.SUBSTITUTION.items()) + ")"
NODES = (
    f"{BLOSUM}, nodes AS (SELECT graph_id, idx, aa, "
    + ", ".join(f"b[{k + 1}]::DOUBLE AS f{k}" for k in range(20))
    + f""", x AS f20, y AS f21, z AS f22, hyd AS f23, chg AS f24, mw / 200 AS f25, vol / 200 AS f26, flex AS f27, arom AS f28,
    ({_SS} = 0)::INT::DOUBLE AS f29, ({_SS} = 1)::INT::DOUBLE AS f30, ({_SS} = 2)::INT::DOUBLE AS f31, 0.5::DOUBLE AS f32, flex AS f33, plddt / 100 AS f34
    FROM placed JOIN props USING (aa) JOIN blosum USING (aa))"""
)
_STATS = [f for lo, hi in ((0, 20), (20, 23), (23, 29), (29, 35)) for f in [f"avg(f{k})" for k in range(lo, hi)] + [f"stddev_pop(f{k})" for k in range(lo, hi)]]
_EDGE_STATS = [f"avg((edge_type = {k})::INT)" for k in range(4)] + ["avg(distance)", "stddev_pop(distance)", "min(distance)", "max(distance)", "avg(strength)", "stddev_pop(strength)", "avg(dir_x)", "avg(dir_y)"]
VECTORS = f"""{NODES}, nv AS (SELECT graph_id, count(*) AS n, [{', '.join(_STATS)}] AS nv FROM nodes GROUP BY ALL),
ev AS (SELECT graph_id, count(*) AS e, [{', '.join(_EDGE_STATS)}] AS ev FROM edges GROUP BY ALL),
vectors AS (SELECT graph_id, list_concat(list_concat([n::DOUBLE, (coalesce(e, 0) // 2)::DOUBLE, (coalesce(e, 0) // 2) / greatest(n, 1)], nv), coalesce(ev, [])) AS v FROM nv LEFT JOIN ev USING (graph_id))"""


def hybrid(a: str, b: str) -> str:
    parts = [f"{w} / (1 + list_distance({a}[{s + 1}:{s + n}], {b}[{s + 1}:{s + n}]) / {scale})" for _, s, n, scale, w in C.VECTOR_SLICES]
    return f"greatest(0.0, least(1.0, {' + '.join(parts)}))"


# ---- whole chains as residues, and their fragments ----

CHAIN_RESIDUES = f"""{LETTERS}, res AS (SELECT doc_id AS chain_id, len AS n, idx, aa, round(2.3 * cos(radians(100.0 * idx)), 6) AS x, round(2.3 * sin(radians(100.0 * idx)), 6) AS y,
    round(1.5 * idx, 6)::DOUBLE AS z, {PLDDT} FROM letters)"""
# the helix rises by 1.5 at each residue, so contacts within 8 lie at most five residues ahead
CHAIN_CONTACTS = """con AS MATERIALIZED (SELECT a.chain_id, a.idx AS i, b.idx AS j FROM (SELECT *, unnest([2, 3, 4, 5])::INT AS ahead FROM res) a
    JOIN res b ON b.chain_id = a.chain_id AND b.idx = a.idx + a.ahead WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 8),
    density AS (SELECT r.chain_id, r.n, r.idx, coalesce(c.k, 0) AS v FROM res r LEFT JOIN (SELECT chain_id, idx, count(*) AS k FROM (SELECT chain_id, i AS idx FROM con UNION ALL SELECT chain_id, j FROM con) GROUP BY ALL) c ON c.chain_id = r.chain_id AND c.idx = r.idx)"""


def steep(name: str, source: str, floor: float, deviations: float) -> str:
    """name(chain_id, idx): where v changes most along the chains of source(chain_id, n, idx, v)."""
    return f"""{name}_s AS (SELECT chain_id, idx, CASE WHEN n < 200 THEN sum(v) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3
            WHEN n < 250 THEN sum(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) / 4 ELSE sum(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 END AS s FROM {source} WINDOW w AS (PARTITION BY chain_id ORDER BY idx)),
    {name}_g AS (SELECT chain_id, idx, abs(CASE WHEN lag(s) OVER w IS NULL THEN lead(s) OVER w - s WHEN lead(s) OVER w IS NULL THEN s - lag(s) OVER w ELSE (lead(s) OVER w - lag(s) OVER w) / 2 END) AS g FROM {name}_s WINDOW w AS (PARTITION BY chain_id ORDER BY idx)),
    {name}_n AS (SELECT chain_id, idx, CASE WHEN max(g) OVER u > 0 THEN g / max(g) OVER u ELSE 0 END AS norm FROM {name}_g WINDOW u AS (PARTITION BY chain_id)),
    {name} AS MATERIALIZED (SELECT chain_id, idx FROM (SELECT *, greatest({floor}, avg(norm) OVER u + {deviations} * stddev_pop(norm) OVER u) AS bound FROM {name}_n WINDOW u AS (PARTITION BY chain_id)) WHERE norm > bound)"""


# goes behind WITH RECURSIVE
CHAIN_FRAGMENTS = f"""{CHAIN_RESIDUES}, {CHAIN_CONTACTS}, {steep('dom', 'density', 0.2, 1.0)}, {steep('flx', '(SELECT chain_id, n, idx, plddt AS v FROM res)', 0.3, 0.5)},
    kept AS (SELECT chain_id, min(idx) AS pos FROM dom GROUP BY chain_id UNION ALL SELECT kept.chain_id, min(dom.idx) FROM kept JOIN dom ON dom.chain_id = kept.chain_id AND dom.idx - kept.pos >= 5 GROUP BY kept.chain_id),
    chg AS (SELECT chain_id, idx FROM (SELECT chain_id, idx, c, lag(c) OVER (PARTITION BY chain_id ORDER BY idx) AS p FROM (SELECT chain_id, idx, {_SS} AS c FROM res)) WHERE p <> c),
    chains AS (SELECT doc_id AS chain_id, len AS n FROM seqs),
    bs AS (SELECT chain_id, pos FROM kept UNION SELECT chain_id, idx FROM flx UNION SELECT chain_id, idx FROM chg UNION SELECT chain_id, unnest(range(0, n + 1, 50))::INT FROM chains UNION SELECT chain_id, n::INT FROM chains),
    gaps AS (SELECT chain_id, pos AS start, lead(pos) OVER (PARTITION BY chain_id ORDER BY pos) AS "end" FROM bs),
    good AS (SELECT * FROM gaps WHERE "end" - start BETWEEN 5 AND 50),
    bare AS (SELECT chain_id, s::INT AS start, least(s + 50, n)::INT AS "end", n FROM (SELECT chain_id, n, unnest(range(0, greatest(n, 1), 25)) AS s FROM chains WHERE chain_id NOT IN (SELECT chain_id FROM good))),
    frags AS MATERIALIZED (SELECT chain_id, start, "end", (start + 1) || '-' || "end" AS frag_id FROM (SELECT chain_id, start, "end" FROM good UNION ALL SELECT chain_id, start, "end" FROM bare WHERE "end" - start >= 5 AND (start = 0 OR start + 25 < n)))"""
_MEMBERS = """members AS (SELECT f.chain_id || '_' || f.frag_id AS graph_id, f.chain_id, r.idx, r.aa, r.x, r.y, r.z, r.plddt FROM (SELECT chain_id, frag_id, unnest(range(start, "end"))::INT AS idx FROM frags) f JOIN res r ON r.chain_id = f.chain_id AND r.idx = f.idx)"""
FRAGMENT_EDGES = EDGES.replace(
    RESIDUES,
    f"""{CHAIN_FRAGMENTS}, {_MEMBERS}, residues AS MATERIALIZED (SELECT graph_id, chain_id, idx, aa, x, y, z, plddt FROM (SELECT *, count(*) OVER (PARTITION BY graph_id) AS left_over FROM
        (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY graph_id) AS size FROM members) WHERE plddt >= CASE WHEN size <= 10 THEN 50 ELSE 70 END)) WHERE left_over >= 2)""",
)

# the shortest paths between all pairs, by six doublings: enough for chains of 64 steps
STEPS = "d0 AS MATERIALIZED (SELECT graph_id, a, b, min(d) AS d FROM (SELECT graph_id, a, b, 1 AS d FROM links UNION ALL SELECT DISTINCT graph_id, a, a, 0 FROM ends) GROUP BY ALL), " + ", ".join(
    f"d{k + 1} AS MATERIALIZED (SELECT x.graph_id, x.a, y.b, min(x.d + y.d) AS d FROM d{k} x JOIN d{k} y ON y.graph_id = x.graph_id AND y.a = x.b GROUP BY ALL)" for k in range(6)
)
