"""SentencePiece models on the tokenizers library: encoding, decoding and a parity check.

The model's protobuf is read field by field: pieces with score and kind, the trainer's model type and byte fallback, and the
normaliser's settings. From these a tokenizers.Tokenizer is rebuilt: the normaliser (its character map, if it has one, the
removal of extra blanks, the dummy prefix and the metaspace marker), unigram scores or, for a BPE model, merges in the order of
the scores of what they make, byte fallback, and the decoder. Control, unused and byte pieces are never matched in a text.

Where no piece has the marker behind another character, tokens can't cross from a word into the next marker; then normalised
texts are cut there, and the distinct words of a batch that a process hasn't met yet are encoded in one multithreaded batch, by
this library and by sentencepiece. Else whole texts are encoded.

Parity: a text has it if both libraries normalise the whole text alike and have the same ids for each of its words. Where a word
differs, or where texts aren't cut, the whole text's ids are compared. Every text is compared.

Defined cases: a null text counts as empty and has no token. Repeated rows are encoded each; an empty table gives no rows.
Characters outside the vocabulary become bytes, or the unknown piece in a model without byte fallback. A very long text is a
batch by itself. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
#: Words whose ids a process keeps.
KNOWN_WORDS = 400_000
_MARK = MARK.encode()


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message; fixed-size values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            n = {1: 8, 5: 4}.get(kind)
            n = varint() if n is None else n
            yield number, data[at : at + n]
            at += n


class Model:
    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for number, value in fields(data):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, b"\0\0\0\0"))[0], own.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        self.unigram = trainer.get(3, 1) == 1
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = rules.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.unknown = next(k for k, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def rebuild(model: Model):
    """A tokenizers.Tokenizer of normalised text."""
    from tokenizers import Tokenizer, models

    # what a text must never match gets a name that no text has
    names = [p if kind in (NORMAL, USER, BYTE, UNKNOWN) else f"{k}" for k, (p, _, kind) in enumerate(model.pieces)]
    if model.unigram:
        return Tokenizer(models.Unigram([(n, s) for n, (_, s, _) in zip(names, model.pieces)], unk_id=model.unknown, byte_fallback=model.byte_fallback))
    ids = {p: k for k, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER)}
    merges = []
    for made in sorted(ids, key=lambda p: (-model.pieces[ids[p]][1], ids[p])):
        pairs = [(made[:i], made[i:]) for i in range(1, len(made)) if made[:i] in ids and made[i:] in ids]
        merges += sorted(pairs, key=lambda p: (ids[p[0]], ids[p[1]]))
    vocabulary = {n: k for k, n in enumerate(names)}
    return Tokenizer(models.BPE(vocabulary, merges, unk_token=names[model.unknown], fuse_unk=True, byte_fallback=model.byte_fallback))


def normaliser(model: Model):
    """The model's normaliser, marker included, as one of the tokenizers library; None where it changes nothing."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
        if model.squeeze:  # markers at the end go like blanks
            steps.append(normalizers.Replace(Regex(rf"{MARK}+\z"), ""))
    return normalizers.Sequence(steps) if steps else None


def whole(model: Model):
    """The full tokenizer, from raw text to ids and back."""
    from tokenizers import decoders

    out = rebuild(model)
    if steps := normaliser(model):
        out.normalizer = steps
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of runs of given sizes, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Codec:
    _loaded: dict[str, "Codec"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        import sentencepiece

        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.words, self.whole, self.steps = rebuild(self.model), whole(self.model), normaliser(self.model)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=open(path, "rb").read())
        self.by_word = self.model.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in self.model.pieces if kind in (NORMAL, USER))
        # ids as bytes, and the words on which the libraries differ
        self.known: dict[bytes, bytes] = {}
        self.unlike: set[bytes] = set()
        made = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.sizes = np.array([len(b) for b in made])
        self.starts, self.bytes = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(made), np.uint8)
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])

    @classmethod
    def load(cls, path: str) -> "Codec":
        """One for each process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def normalise(self, text: str) -> str:
        return self.steps.normalize_str(text) if text and self.steps else text

    def _word_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, packed."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known, self.unlike, new = {}, set(), words
        own = [w.decode() for w in new]
        plain = [w.replace(MARK, " ") for w in own]
        theirs = self.other.encode([w[1:] for w in plain] if self.model.dummy_prefix else plain, num_threads=1)
        for w, e, t in zip(new, self.words.encode_batch_fast(own, add_special_tokens=False), theirs):
            ids = e.ids
            self.known[w] = array("I", ids).tobytes()
            if ids != t:
                self.unlike.add(w)
        return list(map(self.known.__getitem__, words))

    def encode(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The normalised texts, all ids, the bounds of each text's ids among them, and the texts' parity."""
        if not self.by_word:
            ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            bounds = np.cumsum([0, *map(len, ids)])
            parity = np.array([a == b for a, b in zip(ids, self.other.encode(texts, num_threads=1))], bool)
            return [self.normalise(t) for t in texts], np.fromiter(chain.from_iterable(ids), np.uint32, int(bounds[-1])), bounds, parity
        normal = [self.normalise(t) for t in texts]
        raw = [t.encode() for t in normal]
        ends = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), np.uint8)
        # a word begins with the text or with a marker behind another character
        marks = np.zeros(len(data) + 3, bool)
        marks[: max(0, len(data) - 2)] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
        opens = marks.copy()
        opens[3:] &= ~marks[:-3]
        opens[ends] = True
        starts = np.flatnonzero(opens[: len(data)])
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        kinds = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        words = kinds.dictionary.to_pylist()
        known = self._word_ids(words)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.uint32)
        at = kinds.indices.to_numpy()
        ids = flat[_spread((np.cumsum(sizes) - sizes)[at], sizes[at])]
        first = np.searchsorted(starts, ends)  # each text's first word
        bounds = np.append(0, np.cumsum(sizes[at]))[first]
        wrong = np.append(0, np.cumsum(np.array([w in self.unlike for w in words] if self.unlike else np.zeros(len(words)), bool)[at]))[first]
        alike = np.array([self.other.normalize(t) == n for t, n in zip(texts, normal)], bool)
        parity = alike & (np.diff(wrong) == 0)
        for k in np.flatnonzero(~parity):
            parity[k] = self.other.encode(texts[k]) == ids[bounds[k] : bounds[k + 1]].tolist()
        return normal, ids, bounds, parity

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        sizes = self.sizes[ids]
        data = self.bytes[_spread(self.starts[ids], sizes)].tobytes()
        cuts = np.append(0, np.cumsum(sizes))[bounds].tolist()
        out = (data[a:b].decode(errors="replace") for a, b in zip(cuts, cuts[1:]))
        return [t[1:] if self.model.dummy_prefix and t.startswith(" ") else t for t in out]


def pieces_report(docs: DataFrame, path: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32, decoded_sha256, round_trip and parity of every row.

    round_trip: decoding gives the normalised text. parity: the sentencepiece library has the same ids for the whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in batches:
            out: list[tuple] = []
            texts = batch["text"].to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= batch_bytes):
                    size, end = size + len(texts[end]), end + 1
                normal, ids, bounds, parity = codec.encode(texts[at:end])
                of_bytes = np.append(0, np.cumsum(codec.is_byte[ids]))[bounds]
                packed, cuts = memoryview(ids.astype("<u4").tobytes()), bounds.tolist()
                for k, (text, back) in enumerate(zip(normal, codec.decode(ids, bounds))):
                    plain = text.replace(MARK, " ") if codec.model.escape else text
                    plain = plain[1:] if codec.model.dummy_prefix else plain
                    n = cuts[k + 1] - cuts[k]
                    out.append((n, int(of_bytes[k + 1] - of_bytes[k]), zlib.crc32(packed[4 * cuts[k] : 4 * cuts[k + 1]]), hashlib.sha256(back.encode()).hexdigest(), back == plain, bool(parity[k])))
                at = end
            n, b, crc, sha, same, parity = list(zip(*out)) or [()] * 6
            cols = [pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_()), pa.array(parity, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean")
