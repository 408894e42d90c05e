"""Token counts of a document's sections by offset mapping.

A document is encoded once, as a whole. In byte-level BPE every token stands for a known number of bytes, so running sums give
each token's span in the text, and a sorted search joins the spans with the sections'. Sections are the lines of the text, a
line break belonging to the line that it ends, or they end at the bytes that a column names, such as the ends of the fields from
which a text was put together.

A token that crosses a boundary is allocated by an explicit rule: "first", to the section in which it begins; "last", to the
one in which it ends; "most", to the one that holds most of its bytes, the earlier of equals.

Defined cases: a null or empty text is one empty section without tokens. A text that ends in a line break has no section
behind it. Given ends are sorted and held to the text, and the text's own end is added where it lacks; sections may be empty, and
null ends make the text one section. Repeated rows are counted each; a null doc_id is carried along. An empty table gives no rows.
A very long text is encoded whole. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByteBpe

RULES = ("first", "last", "most")


def line_ends(data: bytes) -> np.ndarray:
    """Where each line ends, in bytes."""
    cuts = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return cuts if len(cuts) and cuts[-1] == len(data) else np.append(cuts, len(data))


def given_ends(size: int, ends) -> np.ndarray:
    """Ends of sections as given, of a text of so many bytes."""
    cuts = np.sort(np.clip(np.array([e for e in ends or () if e is not None], np.int64), 0, size))
    return cuts if len(cuts) and cuts[-1] == size else np.append(cuts, size)


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens allocated to it that cross its bounds)."""
    starts = np.append(0, token_ends[:-1]) if len(token_ends) else token_ends
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    own = last if rule == "last" else first.copy()
    if rule == "most":
        for k in np.flatnonzero(last > first):
            edges = np.concatenate([[starts[k]], section_ends[first[k] : last[k]], [token_ends[k]]])
            own[k] = first[k] + int(np.argmax(np.diff(edges)))
    n = len(section_ends)
    return np.bincount(own, minlength=n), np.bincount(own[last > first], minlength=n)


def section_tokens(docs: DataFrame, vocabulary: str, rule: str = "first", ends: str | None = None) -> DataFrame:
    """doc_id, section, start, n_bytes, n_tokens and n_crossing of every section.

    ends names a column with the bytes at which each text's sections end, as an array; without it sections are lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(vocabulary)
        for batch in batches:
            owner, section, start, size, tokens, crossing = [], [], [], [], [], []
            given = batch["ends"].to_pylist() if ends else None
            for k, text in enumerate(batch["text"].to_pylist()):
                data = text.encode()
                cuts = given_ends(len(data), given[k]) if given else line_ends(data)
                n, crossed = allocate(bpe.byte_ends(bpe.ids(text)), cuts, rule)
                owner.append(np.full(len(cuts), k))
                section.append(np.arange(len(cuts)))
                start.append(np.append(0, cuts[:-1]))
                size.append(np.diff(cuts, prepend=0))
                tokens.append(n)
                crossing.append(crossed)
            cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (owner, section, start, size, tokens, crossing)]
            own, section, *rest = cols
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(own)), pa.array(section.astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in rest)], names=["doc_id", "section", "start", "n_bytes", "n_tokens", "n_crossing"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *([F.col(ends).cast("array<long>").alias("ends")] if ends else []))
    return rows.mapInArrow(run, f"doc_id {kind}, section int, start long, n_bytes long, n_tokens long, n_crossing long")
