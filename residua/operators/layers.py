"""Forward passes of the graph and fusion layers in NumPy, on one graph or one batch of vectors, with given weights.

A weight is an array; `drawn` makes a set of them from a seed where none are learned. Edges are (src, dst), messages go to dst.
Learning weights isn't part of the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Weights = dict[str, np.ndarray]


def drawn(seed: int, **shapes: tuple[int, ...]) -> Weights:
    """Normal weights over the root of their first dimension, by name and seed alone."""
    return {name: np.random.default_rng([seed, *name.encode()]).normal(0, 1 / np.sqrt(shape[0]), shape) for name, shape in shapes.items()}


def gelu(x: np.ndarray) -> np.ndarray:
    return x * (1 + np.vectorize(erf, otypes=[float])(x / np.sqrt(2))) / 2


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def leaky(x: np.ndarray, slope: float = 0.2) -> np.ndarray:
    return np.where(x > 0, x, slope * x)


def layer_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + eps)


def summed(values: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, *values.shape[1:]))
    np.add.at(out, to, values)
    return out


def segment_softmax(scores: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Softmax of each column over the rows that go to the same place."""
    top = np.full((n, *scores.shape[1:]), -np.inf)
    np.maximum.at(top, to, scores)
    e = np.exp(scores - top[to])
    return e / summed(e, to, n)[to]


def mlp(x: np.ndarray, w: Weights, residual: bool = False) -> np.ndarray:
    """Linear, normalised, GELU, linear; with residual x is added and the sum normalised."""
    out = gelu(layer_norm(x @ w["enter"])) @ w["leave"]
    return layer_norm(x + out) if residual else out


def attention_layer(x: np.ndarray, src: np.ndarray, dst: np.ndarray, edge: np.ndarray, w: Weights) -> np.ndarray:
    """Graph attention of the second kind: a score of the activated sum of both ends and the edge, for each head; the messages'
    weighted sum is activated, added to the projected input and normalised. left and right: d x h x k, edge: e x h x k,
    score: h x k, skip: d x (h k)."""
    a, b = np.einsum("nd,dhk->nhk", x, w["left"]), np.einsum("nd,dhk->nhk", x, w["right"])
    joint = leaky(a[src] + b[dst] + np.einsum("ed,dhk->ehk", edge, w["edge"]))
    alpha = segment_softmax((joint * w["score"]).sum(axis=-1), dst, len(x))
    out = summed(alpha[..., None] * a[src], dst, len(x)).reshape(len(x), -1)
    return layer_norm(gelu(out) + x @ w["skip"])


def structure_attention(x: np.ndarray, src: np.ndarray, dst: np.ndarray, kind: np.ndarray, w: Weights) -> np.ndarray:
    """Scaled dot-product attention along edges, with a bias for the structure class of the source."""
    q, k, v = (np.einsum("nd,dhk->nhk", x, w[c]) for c in ("query", "key", "value"))
    scores = (q[dst] * k[src]).sum(axis=-1) / np.sqrt(q.shape[-1]) + w["bias"][kind[src]]
    alpha = segment_softmax(scores, dst, len(x))
    out = summed(alpha[..., None] * v[src], dst, len(x)).reshape(len(x), -1)
    return layer_norm(x + out @ w["leave"])


def edge_encoding(edge: np.ndarray, kind: np.ndarray, w: Weights) -> np.ndarray:
    """The type's embedding beside the activated projection of the other features, normalised."""
    return layer_norm(np.concatenate([w["types"][kind], gelu(edge @ w["edge"])], axis=1))


def edge_processing(edge: np.ndarray, kind: np.ndarray, w: Weights) -> np.ndarray:
    """Each edge through the encoder of its type; features are cut or filled with noughts to the encoder's width."""
    width = w["encoders"].shape[1]
    edge = np.pad(edge[:, :width], ((0, 0), (0, max(0, width - edge.shape[1]))))
    return gelu(layer_norm(np.einsum("ed,edk->ek", edge, w["encoders"][kind])))


def edge_update(x: np.ndarray, src: np.ndarray, dst: np.ndarray, edge: np.ndarray, kind: np.ndarray, w: Weights) -> np.ndarray:
    """New edge features from both ends and the edge, by the network of the edge's type."""
    joint = np.concatenate([x[src], x[dst], edge], axis=1)
    hidden = gelu(layer_norm(np.einsum("ed,edk->ek", joint, w["enter"][kind])))
    return np.einsum("ek,ekd->ed", hidden, w["leave"][kind])


def edge_gate(edge: np.ndarray, w: Weights, threshold: float = 0.5, sharpness: float = 10.0, hard: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(mask, importance) of each edge: a soft mask around the threshold, or a hard one."""
    score = sigmoid(mlp(edge, w))
    return ((score > threshold).astype(float) if hard else sigmoid((score - threshold) * sharpness)), score


def position_encoding(xyz: np.ndarray, src: np.ndarray, dst: np.ndarray, w: Weights) -> np.ndarray:
    """The mean over a node's incoming edges of their encoded directions."""
    step = xyz[dst] - xyz[src]
    code = mlp(step / (np.linalg.norm(step, axis=1, keepdims=True) + 1e-6), w)
    return summed(code, dst, len(xyz)) / np.maximum(np.bincount(dst, minlength=len(xyz)), 1)[:, None]


def guided(x: np.ndarray, attention: np.ndarray, w: Weights) -> np.ndarray:
    """A node's given attention mixed with one from its mean, by a weight of its own."""
    alpha = sigmoid(mlp(x, w))
    return alpha * attention + (1 - alpha) * sigmoid(x.mean(axis=1, keepdims=True))


def physicochemical(code: np.ndarray, hyd: np.ndarray, chg: np.ndarray, mw: np.ndarray, ranges: dict[str, tuple[float, float]], w: Weights, bins: int = 10) -> np.ndarray:
    """The residue's embedding beside its binned properties, through a network and normalised; bins without an epsilon."""
    parts = [w["residues"][code]]
    for name, value in (("hyd", hyd), ("chg", chg), ("mw", mw)):
        lo, hi = ranges[name]
        part = np.floor((np.clip(value, lo, hi) - lo) / (hi - lo) * bins) / bins
        parts.append(part[:, None] * w[name])
    return layer_norm(mlp(np.concatenate(parts, axis=1), w))


def cross_fusion(seq: np.ndarray, graph: np.ndarray, layers: list[Weights], w: Weights) -> np.ndarray:
    """Both vectors of a row look at each other, layer by layer, and are mixed by a gate. Over one key, attention is its value."""
    s, g = seq, graph
    for own in layers:
        s, g = layer_norm(s + g @ own["to_seq"]), layer_norm(g + s @ own["to_graph"])
        s = layer_norm(s + gelu(s @ own["seq_in"]) @ own["seq_out"])
        g = layer_norm(g + gelu(g @ own["graph_in"]) @ own["graph_out"])
    s, g = s + seq, g + graph
    gate = sigmoid(np.concatenate([s, g], axis=1) @ w["gate"])
    return layer_norm((gate * s + (1 - gate) * g) @ w["leave"])


def bilinear_fusion(seq: np.ndarray, graph: np.ndarray, w: Weights) -> np.ndarray:
    """Both vectors and their bilinear product, through a network and normalised."""
    product = np.einsum("nd,dek,ne->nk", seq, w["bilinear"], graph)
    return layer_norm(mlp(np.concatenate([seq, graph, product], axis=1), w))


Layer = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def over_graphs(graphs: DataFrame, layer: Callable[[], Layer]) -> DataFrame:
    """graph_id, place and h of every node of encoded graphs: layer(x, src, dst, edge), made once in each task. Edges go both
    ways; the nodes of a graph without any have themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = layer()
        for batch in batches:
            out = []
            for g, x, s, d, e in zip(batch["graph_id"], batch["x"], batch["src"], batch["dst"], batch["edge_attr"]):
                x, s, d = np.stack(x).astype(float), np.asarray(s, int), np.asarray(d, int)
                e = np.stack(e).astype(float) if len(s) else np.zeros((len(x), 8))
                s, d = (s, d) if len(s) else (np.arange(len(x)), np.arange(len(x)))
                h = own(x, np.concatenate([s, d]), np.concatenate([d, s]), np.concatenate([e, e]))
                out.append(pd.DataFrame({"graph_id": g, "place": np.arange(len(h)), "h": h.tolist()}))
            yield pd.concat(out) if out else pd.DataFrame({"graph_id": [], "place": [], "h": []})

    return graphs.select("graph_id", "x", "src", "dst", "edge_attr").mapInPandas(run, "graph_id long, place long, h array<double>")


def stacked(hidden: int = 16, heads: int = 2, seed: int = 0) -> Layer:
    """Edges encoded and gated, then two attention layers."""
    k = hidden // heads
    edges = drawn(seed, edge=(8, hidden // 2), types=(4, hidden // 2))
    gate = drawn(seed + 1, enter=(8, 16), leave=(16, 1))
    sets = [drawn(seed + 2 + i, left=(d, heads, k), right=(d, heads, k), edge=(hidden, heads, k), score=(heads, k), skip=(d, hidden)) for i, d in enumerate((35, hidden))]

    def run(x: np.ndarray, src: np.ndarray, dst: np.ndarray, edge: np.ndarray) -> np.ndarray:
        e = edge_encoding(edge, edge[:, :4].argmax(axis=1), edges) * edge_gate(edge, gate)[0]
        for w in sets:
            x = attention_layer(x, src, dst, e, w)
        return x

    return run
