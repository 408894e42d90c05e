"""Media columns: payloads stored as lossless WebP pictures, read back to pixel arrays, and features of the pixels.

A payload is the text in UTF-8, filled with bytes 0 to a positive multiple of 64. Its bytes are the green samples of pictures
64 pixels wide and at most 16384 high, so up to 1 MiB each; a longer payload is several files, one after the other.

Defined cases: a null text is an empty one, 64 bytes 0. Equal texts give equal files and values. Rows are independent, so
nulls, ties and repeated rows in other columns pass through.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from . import webp

WIDTH, HEIGHT = 64, 16384


def payload_of(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH))


def store(payload: bytes) -> bytes:
    """The pictures that hold a payload."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return b"".join(webp.write_greens(samples[k : k + HEIGHT]) for k in range(0, len(samples), HEIGHT))


def load(media: bytes) -> list[np.ndarray]:
    """The sample arrays of stored pictures."""
    out, at = [], 0
    while at < len(media):
        end = at + 8 + struct.unpack("<I", media[at + 4 : at + 8])[0]
        out.append((webp.read(media[at:end]) >> 8 & 255).astype(np.uint8))
        at = end
    return out


def feature(pictures: list[np.ndarray]) -> str:
    """height x width, sum, sum of squares, sums of the absolute steps along rows and columns, and the distinct values."""
    rows = sum(len(p) for p in pictures)
    wide = [p.astype(np.int64) for p in pictures]
    across = sum(int(np.abs(np.diff(p, axis=1)).sum()) for p in wide)
    down = sum(int(np.abs(np.diff(p, axis=0)).sum()) for p in wide)
    kinds = np.zeros(256, np.int64)
    for p in pictures:
        kinds += np.bincount(p.reshape(-1), minlength=256)
    values = np.arange(256)
    return f"{rows}x{WIDTH}:{int(kinds @ values)}:{int(kinds @ values**2)}:{across}:{down}:{int((kinds > 0).sum())}"


def with_media(docs: DataFrame) -> DataFrame:
    """doc_id and the stored form of each text: n_bytes and media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.text_bytes(batch["text"])
            texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()), pa.array([store(payload_of(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_report(docs: DataFrame) -> DataFrame:
    """What is read back from the stored form of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for media in batch["media"]:
                media = media.as_py()
                pictures = load(media)
                payload = b"".join(p.tobytes() for p in pictures)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(pictures)))
            size, name, tail, n, of, what = list(zip(*out)) or [()] * 6
            cols = [pa.array(size, pa.int64()), pa.array(name, pa.string()), pa.array(tail, pa.int64()), pa.array(n, pa.int64()), pa.array(of, pa.string()), pa.array(what, pa.string())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], *cols], names=NAMES)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_media(docs).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
