"""The data plane of batch embedding: per-partition inference with a pluggable model, manifests and work packing."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[np.ndarray]]


def hash_model(size: int = 8) -> Model:
    """Stands in for a learned model: each residue's vector comes from a hash of it and its neighbours."""

    known: dict[str, np.ndarray] = {}  # windows of three letters are few

    def one(window: str) -> np.ndarray:
        if window not in known:
            if len(known) > 100_000:
                known.clear()
            known[window] = (np.frombuffer(hashlib.md5(window.encode()).digest()[:size], np.uint8) / 255.0).astype(np.float32)
        return known[window]

    def run(seqs: list[str]) -> list[np.ndarray]:
        return [np.array([one(s[max(0, i - 1) : i + 2]) for i in range(len(s))], np.float32).reshape(-1, size) for s in seqs]

    return run


def embedded(seqs: DataFrame, id_: str, model: Callable[[], Model], longest: int | None = 1022, piece: int = 50_000) -> DataFrame:
    """id, n and embedding, one vector for each residue; the model is made once in each task.

    Sequences are cut at longest, the window of the model; with None they go in whole. The model gets sequences of about `piece`
    residues at a time, one sequence at least, and vectors stay packed, so a task holds no more of them than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model()
        for batch in batches:
            first = 0
            cut: list[str] = []
            n = 0
            for at, seq in enumerate(batch["seq"]):
                cut.append(seq.as_py()[:longest])
                n += len(cut[-1])
                if n >= piece or at + 1 == batch.num_rows:
                    vectors = own(cut)
                    yield pa.RecordBatch.from_arrays([batch[id_].slice(first, len(cut)), pa.array([len(v) for v in vectors], pa.int64()), _nested(vectors)], names=[id_, "n", "embedding"])
                    first, cut, n = at + 1, [], 0

    kind = seqs.schema[id_].dataType.simpleString()
    return seqs.select(id_, "seq").mapInArrow(run, f"{id_} {kind}, n long, embedding array<array<float>>")


def _nested(vectors: list[np.ndarray]) -> pa.Array:
    """A row for each sequence, its vectors as a list of lists, without an object for each number."""
    flat = np.concatenate(vectors).astype(np.float32)
    size = flat.shape[1]
    inner = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, max(size, 1), dtype=np.int32), flat.reshape(-1))
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, vectors)], dtype=np.int32), inner)


def lpt_packed(files: DataFrame, workers: int) -> DataFrame:
    """file, size, worker and place: files, largest first, each to the worker with least load. One row a file goes to a task."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["size", "file"], ascending=[False, True])
        heap = [(0, w, 0) for w in range(workers)]
        out = []
        for file, size in zip(own["file"], own["size"]):
            load, w, n = heapq.heappop(heap)
            out.append((file, size, w, n))
            heapq.heappush(heap, (load + int(size), w, n + 1))
        return pd.DataFrame(out, columns=["file", "size", "worker", "place"])

    return files.select("file", F.col("size").cast("long").alias("size")).withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda d: run(d), "file string, size long, worker int, place int")
