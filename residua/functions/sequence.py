"""Column builders over residue sequences: k-mers, hashes, properties and descriptors. All but descriptors stay in the JVM."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from residua import constants as C


def residues_of(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def property_of(code: Column, name: str, default: float | None = 0.0) -> Column:
    """A residue's property; None as default takes the unknown residue's."""
    k = 1 + C.PROPERTIES.index(name)
    table = F.create_map(*(F.lit(v) for r in C.RESIDUES for v in (r[0], float(r[k]))))
    return F.coalesce(F.try_element_at(table, code), F.lit(float(C.UNKNOWN_RESIDUE[k] if default is None else default)))


def one_letter(name: Column) -> Column:
    table = F.create_map(*(F.lit(v) for kv in C.THREE_LETTERS.items() for v in kv))
    return F.coalesce(F.try_element_at(table, F.upper(F.trim(name))), F.lit("X"))


def kmers(seq: Column, k: int = 3) -> Column:
    """All overlapping substrings of length k in order; empty for shorter sequences. In one pass, however long the sequence is."""
    return F.regexp_extract_all(seq, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))


def seq_hash(seq: Column) -> Column:
    return F.md5(F.coalesce(F.nullif(seq, F.lit("")), F.lit("empty")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of a sequence are among the letters."""
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def _by_byte(name: str) -> np.ndarray:
    out = np.zeros(256)
    for r in C.RESIDUES:
        out[ord(r[0])] = r[1 + C.PROPERTIES.index(name)]
    return out


def moment(hydropathy: np.ndarray, window: int = 18) -> float:
    """The largest |sum of h(i + j) cos(100 j degrees)| / w over windows of w = min(window, n) residues."""
    w = min(window, len(hydropathy))
    starts = len(hydropathy) - w + 1
    sums = np.zeros(starts)
    for j in range(w):
        sums += hydropathy[j : j + starts] * math.cos(math.radians(100.0 * j))
    return float(np.abs(sums).max()) / w


def descriptors(seq: Column) -> Column:
    """Sums of hydropathy, charge and helix propensity, and the hydrophobic moment; unknown residues count as 0, an empty sequence too.

    Sliding sums over long sequences cost some microseconds a residue in lambdas, so whole batches go to NumPy.
    """
    hyd, chg, helix = map(_by_byte, ("hyd", "chg", "helix"))

    @F.pandas_udf("hyd double, chg double, helix double, moment double")
    def run(batch: pd.Series) -> pd.DataFrame:
        rows = []
        for s in batch:
            codes = np.frombuffer((s or "").encode("latin-1", "replace"), np.uint8)
            own = hyd[codes]
            rows.append((own.sum(), chg[codes].sum(), helix[codes].sum(), moment(own) if len(own) else 0.0))
        return pd.DataFrame(rows, columns=["hyd", "chg", "helix", "moment"], dtype=float)

    return run(seq)


def length_range(n: Column) -> Column:
    out = F.lit(f">={C.LENGTH_RANGES[-1][1] + 1}")
    for lo, hi in reversed(C.LENGTH_RANGES):
        out = F.when(n <= hi, F.lit(f"{lo}-{hi}")).otherwise(out)
    return out


def tokens(seq: Column, alphabet: str = "LAGVSERTIDPKQNFYMHWC", first: int = 4, begin: int = 0, end: int = 2) -> Column:
    """Token ids: begin, each residue of the alphabet, end. Other characters go; an empty sequence counts as A."""
    known = F.filter(residues_of(seq), lambda c: c.isin(*alphabet))
    known = F.when(F.size(known) > 0, known).otherwise(F.array(F.lit("A")))
    return F.concat(F.array(F.lit(begin)), F.transform(known, lambda c: F.instr(F.lit(alphabet), c) + (first - 1)), F.array(F.lit(end)))
