"""Lookup tables of residues, and the layout of node and edge features."""

from __future__ import annotations

# Residue code, hydropathy, charge, molecular weight, volume, flexibility, aromatic, helix propensity.
RESIDUES = (
    ("A", 1.8, 0.0, 89.09, 88.6, 0.36, 0, 1.41),
    ("C", 2.5, 0.0, 121.15, 108.5, 0.35, 0, 0.66),
    ("D", -3.5, -1.0, 133.10, 111.1, 0.51, 0, 0.98),
    ("E", -3.5, -1.0, 147.13, 138.4, 0.50, 0, 1.53),
    ("F", 2.8, 0.0, 165.19, 189.9, 0.31, 1, 1.16),
    ("G", -0.4, 0.0, 75.07, 60.1, 0.54, 0, 0.43),
    ("H", -3.2, 0.1, 155.16, 153.2, 0.32, 1, 1.05),
    ("I", 4.5, 0.0, 131.17, 166.7, 0.30, 0, 1.09),
    ("K", -3.9, 1.0, 146.19, 168.6, 0.47, 0, 1.23),
    ("L", 3.8, 0.0, 131.17, 166.7, 0.40, 0, 1.34),
    ("M", 1.9, 0.0, 149.21, 162.9, 0.41, 0, 1.30),
    ("N", -3.5, 0.0, 132.12, 114.1, 0.46, 0, 0.76),
    ("P", -1.6, 0.0, 115.13, 112.7, 0.51, 0, 0.34),
    ("Q", -3.5, 0.0, 146.15, 143.8, 0.49, 0, 1.27),
    ("R", -4.5, 1.0, 174.20, 173.4, 0.47, 0, 0.96),
    ("S", -0.8, 0.0, 105.09, 89.0, 0.51, 0, 0.57),
    ("T", -0.7, 0.0, 119.12, 116.1, 0.44, 0, 0.76),
    ("V", 4.2, 0.0, 117.15, 140.0, 0.34, 0, 0.98),
    ("W", -0.9, 0.0, 204.23, 227.8, 0.31, 1, 1.02),
    ("Y", -1.3, 0.0, 181.19, 193.6, 0.42, 1, 0.74),
)
UNKNOWN_RESIDUE = ("X", 0.0, 0.0, 110.0, 135.0, 0.45, 0, 0.0)
PROPERTIES = ("hyd", "chg", "mw", "vol", "flex", "arom", "helix")

# Functional groups, and the classes that decide the type of a contact.
FUNCTIONAL_GROUPS = {"hydrophobic": "AFILMVWY", "charged_positive": "KRH", "charged_negative": "DE", "polar_uncharged": "NQST", "special": "CGP"}
DONORS, ACCEPTORS, GREASY, POSITIVE, NEGATIVE = "NQRKWST", "DEQNSTYHW", "AVILMFYW", "KRH", "DE"
THREE_LETTERS = {
    "ALA": "A", "CYS": "C", "ASP": "D", "GLU": "E", "PHE": "F", "GLY": "G", "HIS": "H", "ILE": "I", "LYS": "K", "LEU": "L",
    "MET": "M", "ASN": "N", "PRO": "P", "GLN": "Q", "ARG": "R", "SER": "S", "THR": "T", "VAL": "V", "TRP": "W", "TYR": "Y",
}
# Name and strength of each contact type, and the class of each secondary-structure code.
CONTACTS = {1: ("spatial", 0.3), 2: ("hbond", 0.8), 3: ("ionic", 0.7), 4: ("hydrophobic", 0.5), 5: ("unknown", 0.2)}
SS_CLASS = {"H": 0, "G": 0, "I": 0, "E": 1, "B": 1, "T": 2, "S": 2, "C": 2}

# BLOSUM62; each residue's row, its columns in the order of SUBSTITUTION_ORDER.
SUBSTITUTION_ORDER = "ARNDCQEGHILKMFPSTWYV"
SUBSTITUTION = {
    "A": [4, -1, -2, -2, 0, -1, -1, 0, -2, -1, -1, -1, -1, -2, -1, 1, 0, -3, -2, 0],
    "R": [-1, 5, 0, -2, -3, 1, 0, -2, 0, -3, -2, 2, -1, -3, -2, -1, -1, -3, -2, -3],
    "N": [-2, 0, 6, 1, -3, 0, 0, 0, 1, -3, -3, 0, -2, -3, -2, 1, 0, -4, -2, -3],
    "D": [-2, -2, 1, 6, -3, 0, 2, -1, -1, -3, -4, -1, -3, -3, -1, 0, -1, -4, -3, -3],
    "C": [0, -3, -3, -3, 9, -3, -4, -3, -3, -1, -1, -3, -1, -2, -3, -1, -1, -2, -2, -1],
    "Q": [-1, 1, 0, 0, -3, 5, 2, -2, 0, -3, -2, 1, 0, -3, -1, 0, -1, -2, -1, -2],
    "E": [-1, 0, 0, 2, -4, 2, 5, -2, 0, -3, -3, 1, -2, -3, -1, 0, -1, -3, -2, -2],
    "G": [0, -2, 0, -1, -3, -2, -2, 6, -2, -4, -4, -2, -3, -3, -2, 0, -2, -2, -3, -3],
    "H": [-2, 0, 1, -1, -3, 0, 0, -2, 8, -3, -3, -1, -2, -1, -2, -1, -2, -2, 2, -3],
    "I": [-1, -3, -3, -3, -1, -3, -3, -4, -3, 4, 2, -3, 1, 0, -3, -2, -1, -3, -1, 3],
    "L": [-1, -2, -3, -4, -1, -2, -3, -4, -3, 2, 4, -2, 2, 0, -3, -2, -1, -2, -1, 1],
    "K": [-1, 2, 0, -1, -3, 1, 1, -2, -1, -3, -2, 5, -1, -3, -1, 0, -1, -3, -2, -2],
    "M": [-1, -1, -2, -3, -1, 0, -2, -3, -2, 1, 2, -1, 5, 0, -2, -1, -1, -1, -1, 1],
    "F": [-2, -3, -3, -3, -2, -3, -3, -3, -1, 0, 0, -3, 0, 6, -4, -2, -2, 1, 3, -1],
    "P": [-1, -2, -2, -1, -3, -1, -1, -2, -2, -3, -3, -1, -2, -4, 7, -1, -1, -4, -3, -2],
    "S": [1, -1, 1, 0, -1, 0, 0, 0, -1, -2, -2, 0, -1, -2, -1, 4, 1, -3, -2, -2],
    "T": [0, -1, 0, -1, -1, -1, -1, -2, -2, -1, -1, -1, -1, -2, -1, 1, 5, -2, -2, 0],
    "W": [-3, -3, -4, -4, -2, -2, -3, -2, -2, -3, -2, -3, -1, 1, -4, -3, -2, 11, 2, -3],
    "Y": [-2, -2, -2, -3, -2, -1, -2, -3, 2, -1, -1, -2, -1, 3, -3, -2, -2, 2, 7, -1],
    "V": [0, -3, -3, -3, -1, -2, -2, -3, -3, 3, 1, -2, 1, -1, -2, -2, 0, -3, -1, 4],
}

# Slices of the 85 numbers of a graph vector: name, start, length, scale and weight in the hybrid similarity.
VECTOR_SLICES = (("topology", 0, 3, 3.0, 0.3), ("substitution", 3, 40, 20.0, 0.15), ("position", 43, 6, 3.0, 0.1), ("chemistry", 49, 12, 6.0, 0.15), ("structure", 61, 12, 6.0, 0.1), ("edges", 73, 12, 8.0, 0.2))
# Edges of the ranges of the length histogram.
LENGTH_RANGES = ((0, 10), (11, 20), (21, 30), (31, 40), (41, 50), (51, 100), (101, 200), (201, 300), (301, 500))
