"""Media, packing, tokens, pieces, chats, licences and toxicity."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from residua.llm import bpe, chat_format, common, license_scan, media, packing, queries, sentencepieces, token_counts, toxicity, webp

from .conftest import SF

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF)


# ---- lossless WebP ----


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 5000, 70_000])
@pytest.mark.parametrize("kinds", [1, 2, 60, 256])
def test_payload_round_trip(size, kinds):
    text = np.random.default_rng(size).integers(0, kinds, size).astype(np.uint8).tobytes()
    payload = media.payload_of(text)
    assert len(payload) % 64 == 0 and payload and payload[:size] == text and not any(payload[size:])
    assert b"".join(p.tobytes() for p in media.load(media.store(payload))) == payload


def slow(data, monkeypatch):
    """The file as the reader for one symbol at a time sees it."""
    with monkeypatch.context() as m:
        m.setattr(webp, "_greens", lambda *_: None)
        return webp.read(data)


@pytest.mark.parametrize("case", ["two kinds", "few kinds", "lines", "one byte", "text", "long run"])
def test_written_with_palettes_and_copies(case, monkeypatch):
    rng = np.random.default_rng(3)
    line = rng.integers(32, 127, 90).astype(np.uint8).tobytes()
    text = {
        "two kinds": rng.integers(65, 67, 3000).astype(np.uint8).tobytes(), "few kinds": rng.integers(65, 75, 3000).astype(np.uint8).tobytes(),
        "lines": b"".join(line + rng.integers(32, 127, int(n)).astype(np.uint8).tobytes() for n in rng.integers(0, 200, 60)), "one byte": b"a" * 5000 + b"b",
        "text": b" ".join(b"word%d" % k for k in rng.integers(0, 40, 4000)), "long run": rng.integers(0, 256, 300).astype(np.uint8).tobytes() * 60,
    }[case]
    samples = np.frombuffer(media.payload_of(text), np.uint8).reshape(-1, 64)
    stored = webp.write_greens(samples)
    for got in (webp.read(stored), slow(stored, monkeypatch)):
        assert ((got >> 8 & 255) == samples).all() and (got & 0xFFFF00FF == 0xFF000000).all()
    counts = np.bincount(samples.reshape(-1))
    plain = (counts * webp.code_lengths(counts, 12)).sum() / 8
    # "two kinds" and "few kinds" hold nought too, the filling
    assert len(stored) < (0.99 if "kinds" in case else 0.7) * plain + 60
    for cut in (stored[:40], stored[: len(stored) // 2]):
        with pytest.raises((ValueError, IndexError)):
            webp.read(cut)


def test_payload_over_a_picture():
    payload = media.payload_of(bytes(range(256)) * 4200)
    stored = media.store(payload)
    assert len(media.load(stored)) == 2 and b"".join(p.tobytes() for p in media.load(stored)) == payload


@pytest.fixture
def pixels():
    return np.random.default_rng(1).integers(0, 2**32, (7, 11), dtype=np.uint64).astype(np.uint32)


def back(shape, tokens, transforms=(), cache=0):
    return webp.read(webp.write_tokens(shape[1], shape[0], tokens, list(transforms), cache))


def literal(p):
    return [("pixel", x) for x in p.reshape(-1)]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(pixels, mode):
    modes = np.full((2, 3), mode << 8, np.uint32)
    left = webp._predictor(pixels, modes, 2, False)
    assert (back(pixels.shape, literal(left), [(webp.PREDICTOR, modes, 2)]) == pixels).all()


def test_colour_transforms_stack(pixels):
    marks = np.random.default_rng(2).integers(0, 2**24, (2, 3)).astype(np.uint32)
    one = webp._subtract_green(pixels, False)
    two = webp._cross_colour(one, marks, 2, False)
    got = back(pixels.shape, literal(two), [(webp.SUBTRACT_GREEN, None, 0), (webp.CROSS_COLOUR, marks, 2)])
    assert (got == pixels).all()


@pytest.mark.parametrize("colours", [2, 4, 16, 40])
def test_palette(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 2**32, colours, dtype=np.uint64).astype(np.uint32)
    index = rng.integers(0, colours, (5, 13))
    bits = webp._bundle(colours)
    per, each = 1 << bits, 8 >> bits
    wide = np.zeros((5, -(-13 // per) * per), np.int64)
    wide[:, :13] = index
    packed = (wide.reshape(5, -1, per) << (np.arange(per) * each)).sum(axis=2) if bits else index
    tokens = [("pixel", 0xFF000000 | int(p) << 8) for p in packed.reshape(-1)]
    assert (back((5, 13), tokens, [(webp.PALETTE, table, 0)]) == table[index]).all()


def test_back_references_and_cache():
    a, b = 0xFF102030, 0x80405060
    far = len(webp.NEAR)
    slot = lambda p: (p * webp.CACHE_FACTOR & 0xFFFFFFFF) >> 28
    tokens = [("pixel", a), ("pixel", b), ("copy", 4, far + 2), ("cache", slot(a)), ("copy", 5, 1)]
    got = back((2, 6), tokens, cache=4).reshape(-1).tolist()
    # the last copy takes the pixels one row above, (0, 1)
    assert got == [a, b, a, b, a, b, a, b, a, b, a, b]


def test_media_report(edge, empty):
    rows = sorted(edge.select("doc_id", "text").collect(), key=str)
    got = sorted(media.media_report(edge).collect(), key=lambda r: str(r.doc_id))
    want = Counter()
    for r in rows:
        p = media.payload_of((r.text or "").encode())
        want[(r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in got}) == len({r.payload_sha256 for r in got})
    assert media.media_report(empty).count() == 0


# ---- tokens and packing ----


def test_ids_are_those_of_the_library(docs, edge):
    own, theirs = bpe.ByteBpe.load(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for text in [r.text for r in docs.collect()] + [r.text for r in edge.collect()] + ["it's  'S\n\n x\t　y 12ab'll don't", "a<|endoftext|>b <|endoftext|> <|endoftext", "<|endoftext|>"]:
        ids = own.ids(text)
        encoded = theirs.encode(text or "", add_special_tokens=False)
        assert ids.tolist() == encoded.ids
        # the library's offsets count characters, and a character may be cut by tokens
        ends = np.cumsum([0, *(len(c.encode()) for c in text or "")])
        assert len(ids) < 2 or all(ends[b - 1] < e <= ends[b] for e, (_, b) in zip(own.byte_ends(ids), encoded.offsets))


def test_other_vocabularies_are_refused(tmp_path):
    import json

    with open(VOCABULARY, encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{**spec["added_tokens"][0], "lstrip": True}]}):
        with open(tmp_path / "other.json", "w", encoding="utf-8") as f:
            json.dump(spec | change, f)
        with pytest.raises(ValueError):
            bpe.ByteBpe(str(tmp_path / "other.json"))


@pytest.mark.parametrize("text", [" " * 1_000_000 + "a", "a" + "\n" * 1_000_001, "a" * 120_000 + " b"])
def test_ids_of_very_long_runs(text):
    own, theirs = bpe.ByteBpe.load(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    ids = own.ids(text)
    assert ids.tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert own.byte_ends(ids)[-1] == len(text.encode())


def check_packing(rows, texts, size):
    own = bpe.ByteBpe.load(VOCABULARY)
    places: dict[int, list] = {}
    pieces: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for p in places.values():
        p.sort()
        assert p[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(p, p[1:])) and sum(n for _, n in p) <= size
    want = Counter()
    for i, text in texts:
        ids = np.append(own.ids(text), 0).astype("<u4")
        cuts = [0, *range(len(ids) % size or size, len(ids) + 1, size)] if len(ids) > size else [0, len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(r.length for r in rows)
    assert -(-total // size) <= len(places)
    return len(places), -(-total // size)


def test_packing(docs, edge, empty):
    n, least = check_packing(packing.pack(docs, VOCABULARY).collect(), [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert n <= 1.05 * least + 1
    check_packing(packing.pack(edge, VOCABULARY, 64).collect(), [(r.doc_id, r.text) for r in edge.collect()], 64)
    assert packing.pack(empty, VOCABULARY).count() == 0


def test_packing_in_many_groups_and_of_whole_pieces_alone(spark, docs):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    check_packing(packing.pack(docs, VOCABULARY, 64, per_salt=3).collect(), texts, 64)
    few = [(1, "a few words"), (2, None), (2, "a")]
    rows = packing.pack(spark.createDataFrame(few, "doc_id long, text string"), VOCABULARY, 1).collect()
    places = sorted(r.sequence_id for r in rows)
    assert len(rows) == len(set(places)) == 3 + 1 + 1 + 1 + 1 and all(r.offset == 0 and r.length == 1 for r in rows)


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(0)
    counts = Counter(np.minimum(rng.gamma(1.2, 500, 50_000).astype(int) + 5, 2048).tolist())
    bins = packing.plan(dict(counts), 2048)
    used = Counter()
    for n, content in bins.kinds():
        assert sum(content) <= 2048
        for c in content:
            used[c] += n
    assert used == counts
    total = sum(n * c for n, c in counts.items())
    assert bins.number() <= 1.01 * -(-total // 2048)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens(docs, edge, empty, rule):
    own = bpe.ByteBpe.load(VOCABULARY)
    for frame in (docs.limit(40), edge):
        want = Counter()
        for r in frame.collect():
            data = (r.text or "").encode()
            ends = [k + 1 for k, b in enumerate(data) if b == 10]
            ends = ends if ends and ends[-1] == len(data) else [*ends, len(data)]
            tokens, at = [0] * len(ends), 0
            crossing = [0] * len(ends)
            for n in own.lengths[own.ids(r.text)].tolist():
                held = Counter(next(s for s, e in enumerate(ends) if p < e) for p in range(at, at + n)) if len(ends) < 200 else Counter({int(np.searchsorted(ends, at, "right")): n})
                first, last = min(held), max(held)
                s = first if rule == "first" else last if rule == "last" else max(held, key=lambda s: (held[s], -s))
                tokens[s] += 1
                crossing[s] += first != last
                at += n
            for s, (a, e) in enumerate(zip([0, *ends], ends)):
                want[(r.doc_id, s, a, e - a, tokens[s], crossing[s])] += 1
        assert Counter(tuple(r) for r in token_counts.section_tokens(frame, VOCABULARY, rule).collect()) == want
    assert token_counts.section_tokens(empty, VOCABULARY).count() == 0


def test_given_sections(spark):
    rows = [(1, "alpha beta<|endoftext|>gamma", [3, 10]), (2, "alpha beta", [40, 0, None, 7, 7]), (3, None, [2]), (4, "one two", None)]
    got = token_counts.section_tokens(spark.createDataFrame(rows, "doc_id long, text string, ends array<int>"), VOCABULARY, "first", "ends").collect()
    assert [tuple(r)[:4] for r in got if r.doc_id == 1] == [(1, 0, 0, 3), (1, 1, 3, 7), (1, 2, 10, 18)]
    assert [r.n_bytes for r in got if r.doc_id == 2] == [0, 7, 0, 3] and [r.n_bytes for r in got if r.doc_id > 2] == [0, 7]
    theirs = Tokenizer.from_file(VOCABULARY)
    for i, text, _ in rows:
        assert sum(r.n_tokens for r in got if r.doc_id == i) == len(theirs.encode(text or "", add_special_tokens=False).ids)


def test_pieces(docs, edge, empty):
    for frame in (docs, edge):
        rows = sentencepieces.pieces_report(frame, PIECES).collect()
        assert len(rows) == frame.count() and all(r.parity and r.round_trip for r in rows)
    assert sentencepieces.pieces_report(empty, PIECES).count() == 0


def proto_varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + proto_varint(n >> 7)


def proto_field(k, v):
    return proto_varint(k << 3 | 2) + proto_varint(len(v)) + v


def small_model(path, unigram, squeeze, cross):
    """A model put together here, over the letters a, b and c."""
    import struct

    piece = lambda p, s, t: proto_field(1, proto_field(1, p.encode()) + proto_varint(2 << 3 | 5) + struct.pack("<f", s) + proto_varint(3 << 3) + proto_varint(t))
    flag = lambda k, v: proto_varint(k << 3) + proto_varint(int(v))
    own = [("▁", -3.0), ("▁a", -0.5), ("▁ab", -1.0), ("a", -2.0), ("b", -2.1), ("c", -2.2), ("bc", -1.5), ("abc", -4.0), ("ca", -2.3)] + ([("c▁", -1.1), ("c▁a", -1.2)] if cross else [])
    body = piece("<unk>", 0, 2) + b"".join(piece(f"<0x{b:02X}>", 0, 6) for b in range(256)) + b"".join(piece(p, s, 1) for p, s in own)
    body += proto_field(2, flag(3, 1 if unigram else 2) + flag(35, 1)) + proto_field(3, flag(3, 1) + flag(4, squeeze) + flag(5, 1))
    path.write_bytes(body)
    return str(path)


@pytest.mark.parametrize("unigram", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("cross", [True, False])
def test_small_models(tmp_path, unigram, squeeze, cross):
    """Both kinds of model, with and without words that tokens can cross, against the sentencepiece library on whole texts."""
    import sentencepiece

    path = small_model(tmp_path / "own.model", unigram, squeeze, cross)
    codec, theirs = sentencepieces.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert codec.model.unigram == unigram and codec.model.byte_fallback and codec.by_word == (not cross)
    rng = np.random.default_rng(1)
    texts = ["", " ", "▁", *("".join(rng.choice(list("aabbcc   é▁\n"), int(rng.integers(0, 30)))) for _ in range(200))]
    normal, ids, bounds, parity = codec.encode(texts)
    own = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert own == theirs.encode(texts) and parity.all() and normal == [theirs.normalize(t) for t in texts]
    assert own == [e.ids for e in codec.whole.encode_batch(texts, add_special_tokens=False)]
    back = codec.decode(ids, bounds)
    assert back == [n.replace("▁", " ")[1:] for n in normal] and back == [codec.whole.decode(i, skip_special_tokens=False) for i in own]


def test_parity_sees_other_ids(tmp_path):
    codec = sentencepieces.Codec(small_model(tmp_path / "own.model", True, False, False))
    right = codec.encode(["ab c", "bc ca"])[3]
    other = sentencepieces.Model(open(tmp_path / "own.model", "rb").read())
    other.pieces = [(p, -50.0 if p == "▁a" else score, kind) for p, score, kind in other.pieces]
    codec.known, codec.words = {}, sentencepieces.rebuild(other)
    assert right.all() and codec.encode(["ab c", "bc ca", "abc"])[3].tolist() == [True, True, False]


# ---- chats ----


def test_chats(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "more"), (4, 0, "user", "other"),
        (5, 0, "user", "other"), (6, None, None, None), (None, 0, "user", "lost"), (4, 0, "user", "other"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat_format.chats(frame).collect()}
    assert got == {3: (3, 1), 4: (1, 2), 6: (1, 1)}
    assert chat_format.chats(frame.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE[name]).df()
    order = sorted(mine.columns)
    assert order == sorted(theirs.columns)
    assert sorted(map(str, mine[order].values.tolist())) == sorted(map(str, theirs[order].values.tolist()))


# ---- licences and toxicity ----


def test_licences(spark, edge, empty):
    texts = [(1, "Some prose.\nReleased under the MIT License.\nMore."), (2, "Licensed under the Apache License, Version 2.0."), (3, "The licence fee rose and nobody had permission."), (4, None), (5, "Licensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.")]
    rows = {r.doc_id: r for r in license_scan.license_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [(rows[k].family, rows[k].confirmed) for k in (1, 2, 3, 4)] == [("mit", True), ("apache", True), ("unknown", False), ("unknown", False)]
    assert rows[5].families == "cc-by-nc,gpl" and rows[5].n_licence_paragraphs == 2 and rows[1].n_paragraphs == 3
    assert license_scan.license_report(edge).count() == edge.count() and license_scan.license_report(empty).count() == 0


def test_licences_in_wrapped_lines_and_without_licence_words(spark):
    model = license_scan.classifier()
    texts = [
        (1, "Prose here.\n\n# This Source Code Form is subject to the terms of the Mozilla Public\n# License, version 2.0.\n#\n# More prose"),
        (2, "Redistribution and use in source and binary\nforms, with or without modification, are\npermitted."), (3, "under the terms of the GNU General Public"),
        (4, "This Source Code Form is subject to the terms of the Mozilla Public"), (5, "Released under the MIT"), (6, "He walked\n\n\nto work"), (7, "\n" * 200_000 + "the MIT\nLicense"),
    ]
    rows = {r.doc_id: r for r in license_scan.license_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [(rows[k].family, rows[k].confirmed, rows[k].n_paragraphs) for k in (1, 2)] == [("mpl", True, 3), ("bsd", True, 1)]
    assert rows[6].n_paragraphs == 2
    # every paragraph is classed as the model classes it
    for k, text in texts:
        words = [re.findall(license_scan.WORD, p.lower()) for p in re.split(r"\n[\s#*/;|>-]*\n|(?<=[.!?])\n", text)]
        p = model._softmax((model._matrix([(w, "") for w in words]) @ model.weights + model.bias) / model.temperature)
        best = max(((p[j].max(), model.names[p[j].argmax()]) for j in range(len(words)) if p[j].argmax() < len(model.names) - 1 and p[j].max() > model.least), default=(0.0, "unknown"))
        assert (rows[k].family, round(rows[k].probability, 5)) == (best[1], round(best[0], 5))
    assert rows[4].family == "mpl" and not re.search(license_scan.LICENCE_WORDS, texts[3][1].lower())
    pairs = {" ".join(w[i : i + 2]) for own in license_scan.TEMPLATES.values() for t in own for w in [re.findall(license_scan.WORD, t.lower())] for i in range(len(w) - 1)}
    assert pairs <= set(model.vocabulary)


def test_licence_classifier_on_held_out_examples():
    model = license_scan.classifier()
    held = license_scan._examples(3)
    p = model._softmax((model._matrix(held) @ model.weights + model.bias) / model.temperature)
    right = sum(model.names[p[k].argmax()] == c for k, (_, c) in enumerate(held))
    assert right >= 0.95 * len(held)
    bare = model._softmax(model.bias[None] / model.temperature)[0]
    assert model.names[bare.argmax()] == license_scan.UNKNOWN


def test_licence_names_in_forms_not_trained_on(spark):
    model = license_scan.classifier()
    assert not set(license_scan.TEST_FORMS) & {*license_scan.FORMS, *license_scan.CALIBRATION_FORMS}
    held = license_scan._notices(license_scan.TEST_FORMS)
    p = model._softmax((model._matrix(held) @ model.weights + model.bias) / model.temperature)
    right = sum(model.names[p[k].argmax()] == c for k, (_, c) in enumerate(held))
    assert right >= 0.97 * len(held) and len(model.names) == 17
    lines = [
        ("Distributed under GPLv3 or later.", "gpl"), ("MIT, see file.", "mit"), ("This is free software under the terms of the GNU GPL.", "gpl"), ("SPDX: Apache-2.0", "apache"),
        ("The terms of the old treaty are available, see the file.", "unknown"), ("The general public was let in or later thrown out.", "unknown"),
    ]
    frame = spark.createDataFrame([(k, f"Some prose.\n\n{t}\n\nMore") for k, (t, _) in enumerate(lines)], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.license_report(frame).collect()}
    for k, (text, family) in enumerate(lines):
        p = model._softmax((model._matrix([(license_scan.words_in(text), "")]) @ model.weights + model.bias) / model.temperature)[0]
        assert rows[k].family == family and (family == "unknown" or round(rows[k].probability, 5) == round(p.max(), 5))


def test_toxicity_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.toxicity_report(common.documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")).where("held_out").toPandas()
    both = rows.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    # this size has about 290 toxic rows to learn from, and most kinds of words in few of them
    assert (both.predicted[both.toxic == 0] == 0).mean() > 0.99
    assert (both.predicted[both.toxic == 1] == 1).mean() > 0.7
    assert both.score[both.toxic == 1].mean() > 5 * both.score[both.toxic == 0].mean()


def plain_features(text):
    """The same words, pairs and skip pairs, one by one."""
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    return {(w,) for w in words} | {(a, 1, b) for a, b in zip(words, words[1:])} | {(a, 2, b) for a, b in zip(words, words[2:])}


def test_ftrl_against_a_plain_loop(spark):
    """Coordinates by name in a dictionary, with the published update; no hashing, no arrays."""
    docs = {r.doc_id: r.text for r in common.documents(spark, SF).collect()}
    labels = {r.doc_id: int(r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in docs}
    ids, r = sorted(labels), toxicity.RATES
    z, n = {}, {}

    def weight(k):
        l1 = 0.0 if k is None else r["l1"]
        return 0.0 if abs(z.get(k, 0.0)) <= l1 else -(z[k] - (l1 if z[k] > 0 else -l1)) / ((r["beta"] + n[k] ** 0.5) / r["alpha"] + r["l2"])

    def chance(text):
        return 1 / (1 + np.exp(-sum(weight(k) for k in {*plain_features(text), None})))

    for _ in range(r["epochs"]):
        for i in ids:
            own = {*plain_features(docs[i]), None}
            g = chance(docs[i]) - labels[i]
            for k, w in [(k, weight(k)) for k in own]:
                before = n.get(k, 0.0)
                n[k] = before + g * g
                z[k] = z.get(k, 0.0) + g - (n[k] ** 0.5 - before**0.5) / r["alpha"] * w
    rows = list(toxicity.distinct_features(pa.array([docs[i] for i in ids], pa.string()), 40))
    assert [len(m) for m in rows] == [len(plain_features(docs[i])) for i in ids]
    flat = np.unique(np.concatenate(rows))
    at, w = toxicity.fit([np.searchsorted(flat, m) for m in rows], [labels[i] for i in ids], bits=22)
    assert len(flat) < 1 << 22
    table = np.zeros((1 << 22) + 1)
    table[at] = w
    got = [1 / (1 + np.exp(-(table[np.searchsorted(flat, m)].sum() + table[-1]))) for m in rows]
    np.testing.assert_allclose(got, [chance(docs[i]) for i in ids], atol=1e-9)


def test_toxicity_sample_is_bounded(spark, edge):
    labels = spark.createDataFrame([(k, k % 2) for k in range(11)], "doc_id long, toxic int")
    none = toxicity.train(edge, labels, max_train_bytes=0)
    some = toxicity.train(edge, labels, max_train_bytes=100_000)
    assert len(none[0]) <= 1 and len(some[0]) >= len(none[0])


def test_toxicity_edges(spark, edge, empty):
    labels = spark.createDataFrame([(7, 1), (8, 0), (None, 1), (9, None), (99, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(edge, labels).collect()
    assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 10)}) == 1
    assert toxicity.drop_toxic(edge, labels).columns == edge.columns
    assert {r.score for r in toxicity.toxicity_report(edge, labels.where("false")).collect()} == {0.5}
    assert toxicity.toxicity_report(empty, labels).count() == 0
