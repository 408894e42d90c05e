from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, and columns with clashing names."""
    base = " ".join(f"word{k % 97} thing{k % 89}" for k in range(30_000))
    near = " ".join(f"alpha{k} beta{k}" for k in range(200))
    rows = [
        (1, near, "en", "s", 1, "x", 0.5), (2, near + " tail", None, "s", None, None, None), (2, near, "en", None, 1, "x", 0.5), (2, near, "en", None, 1, "x", 0.5),
        (None, None, None, None, None, None, None), (None, near, "de", "s", 5, "y", 1.0), (3, "", "en", "s", 0, "x", 0.5), (3, "", "en", "s", 0, "x", 0.5),
        (4, " \t\n ", "en", "s", 4, "x", 0.5), (5, base, "en", "s", len(base), "x", 0.5), (6, base + "é<|endoftext|>", "en", "s", 7, "x", 0.5), (7, "a  b", "en", "s", 4, "x", 0.5), (8, "a b", "en", "s", 3, "x", 0.5),
        (9, "ünïcode ☃ text 雪 with few words", "xx", "s", 9, "x", 0.5), (10, None, "en", "s", 0, "x", 0.5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, toxicity double").selectExpr("*", "text as body", "doc_id as id", "'x' as spans", "1 as first", "2 as n", "'k' as label", "7 as _rsd_file", "8 as _rsd_row", "9 as _RSD_spans", "10 as _rsd_toxicity", "11 as _rsd_parts")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
