"""Byte-level BPE ids from a tokenizers JSON file, merged by tiktoken's engine, which gives the same ids several times faster.

The ranks are read from the JSON's own vocabulary and merges; load() refuses a file in which a merge's rank and its id differ,
since only then do both engines agree. It also refuses files with another pre-tokeniser, a normaliser, or added tokens that
take blanks along or match whole words only.

The ids are those of the tokenizers library with its default settings: an added token that stands in a text, such as
<|endoftext|>, is that token. Such a text is encoded by the library itself, as is one with a run of LONGEST blanks, letters,
digits or other signs, since tiktoken's pattern overflows its stack on runs of about a million blanks.
"""

from __future__ import annotations

import json
import re

import numpy as np
import tiktoken
from tokenizers import Tokenizer

# Fixed value: the public byte-level pre-tokenisation pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST = 100_000
LONG_RUN = re.compile(rf"\s{{{LONGEST}}}|[^\W\d_]{{{LONGEST}}}|\d{{{LONGEST}}}|[^\w\s]{{{LONGEST}}}|_{{{LONGEST}}}")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such a vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    _loaded: dict[str, "ByteBpe"] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", ())
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: not plain byte-level text")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: an added token takes more than its own text")
        special = {t["content"]: t["id"] for t in added}
        self.added = re.compile("|".join(map(re.escape, special))) if special else None
        ranks = {bytes(letters[c] for c in token): n for token, n in model["vocab"].items() if token not in special}
        for k, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if model["vocab"][left + right] != 256 + k:
                raise ValueError(f"{path}: merge {k} has another id than its rank")
        self.engine = tiktoken.Encoding("residua", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.path, self._library = path, None
        self.lengths = np.zeros(max(*ranks.values(), *special.values(), 0) + 1, np.int64)
        for token, n in special.items():
            self.lengths[n] = len(token.encode())
        for token, n in ranks.items():
            self.lengths[n] = len(token)

    @classmethod
    def load(cls, path: str) -> "ByteBpe":
        """One for each process."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def library(self) -> Tokenizer:
        """Loaded when a text first needs it."""
        if self._library is None:
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if (self.added and self.added.search(text)) or (len(text) >= LONGEST and LONG_RUN.search(text)):
            return np.asarray(self.library().encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self.engine.encode_ordinary(text), dtype=np.uint32)

    def byte_ends(self, ids: np.ndarray) -> np.ndarray:
        """Where each token ends, in UTF-8 bytes of the text."""
        return np.cumsum(self.lengths[ids])
