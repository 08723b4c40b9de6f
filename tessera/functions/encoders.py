"""Encoders are pluggable: anything that turns a list of texts or images into unit vectors.

No models are shipped.  The stub projects hashed character trigrams, so equal texts have equal vectors
and similar ones near ones; it lets the whole pipeline run and be tested.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.diagnostics import Errors

Encoder = Callable[[list[str]], np.ndarray]


@lru_cache(maxsize=1 << 16)
def _trigram(run: str) -> tuple[int, int]:
    """A trigram's axis, before it is cut to the dimension, and sign."""
    d = hashlib.md5(run.encode("utf-8", "surrogatepass")).digest()
    return d[0], 1 if d[1] & 1 else -1


def hash_projection(texts: list[str], dim: int = 64) -> np.ndarray:
    """Signed hashed trigrams, unit length; an empty text is the first axis."""
    out = np.zeros((len(texts), dim))
    for i, t in enumerate(texts):
        low = f"  {t.lower()} "
        for j in range(len(low) - 2):
            place, sign = _trigram(low[j : j + 3])
            out[i, place % dim] += sign
        if not out[i].any():
            out[i, 0] = 1
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def encode_column(text: Column, encoder: Encoder = hash_projection, batch: int = 16, errors: Errors | None = None) -> Column:
    """Vectors for a text column, ``batch`` texts at a time; a text that fails gets an empty vector, which means: tried, failed.

    Why it failed goes to ``errors``.
    """

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out: list = []
            values = part.fillna("").tolist()
            for i in range(0, len(values), batch):
                try:
                    out += [v.astype(np.float32) for v in encoder(values[i : i + batch])]
                except Exception:  # one at a time, so that a bad text costs only itself
                    for v in values[i : i + batch]:
                        try:
                            out.append(encoder([v])[0].astype(np.float32))
                        except Exception as e:
                            out.append(np.zeros(0, np.float32))
                            if errors is not None:
                                errors.add(e)
            yield pd.Series(out)

    return run(text)


def preprocess_image(rgb: np.ndarray, side: int = 224, mean=(0.48145466, 0.4578275, 0.40821073), std=(0.26862954, 0.26130258, 0.27577711)) -> np.ndarray:
    """Shortest side to ``side`` (nearest), centre crop, channels first, normalised."""
    h, w = rgb.shape[:2]
    scale = side / min(h, w)
    rows = np.minimum((np.arange(round(h * scale)) / scale).astype(int), h - 1)
    cols = np.minimum((np.arange(round(w * scale)) / scale).astype(int), w - 1)
    big = rgb[rows][:, cols]
    top, left = (big.shape[0] - side) // 2, (big.shape[1] - side) // 2
    return ((big[top : top + side, left : left + side] / 255.0 - mean) / std).transpose(2, 0, 1).astype(np.float32)


def merge_pairs(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair merging: the neighbours of lowest rank become one part wherever they stand, from the left, until no pair has a rank.

    Each pair has an index of the places where its left part begins, so a merge touches only what it changes.
    """
    part = dict(enumerate(parts))
    right = {i: i + 1 for i in part}
    left = {i: i - 1 for i in part}
    places: dict[tuple[str, str], set[int]] = {}
    queue: list[tuple[int, tuple[str, str]]] = []

    def meet(i: int) -> None:
        """Index the pair that begins at ``i``, if it can merge."""
        pair = (part.get(i), part.get(right.get(i)))
        if pair in ranks:
            if pair not in places:
                heapq.heappush(queue, (ranks[pair], pair))
            places.setdefault(pair, set()).add(i)

    for i in list(part):
        meet(i)
    while queue:
        _, pair = heapq.heappop(queue)
        for i in sorted(places.pop(pair, ())):
            j = right.get(i)
            if (part.get(i), part.get(j)) != pair:
                continue
            part[i] = pair[0] + part.pop(j)
            right[i] = right.pop(j)
            left[right[i]] = i
            meet(left[i])
            meet(i)
    return [part[i] for i in sorted(part)]


class ClipTokens:
    """Byte-level BPE with word ends, to a fixed number of ids: start, text, end; padded with the end id."""

    #: Fixed value: how the public model splits words; letters and numbers are Unicode classes.
    WORDS = regex.compile(r"<\|startoftext\|>|<\|endoftext\|>|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.IGNORECASE)

    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int], start: int, end: int, length: int = 77):
        self.vocab, self.ranks, self.start, self.end, self.length = vocab, ranks, start, end, length
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in plain]
        self.letter = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def encode(self, text: str) -> list[int]:
        ids = []
        for w in self.WORDS.findall(" ".join(text.split()).lower()):
            parts = [self.letter[b] for b in w.encode()]
            parts[-1] += "</w>"
            ids += [self.vocab[p] for p in merge_pairs(parts, self.ranks) if p in self.vocab]
        ids = [self.start, *ids[: self.length - 2], self.end]
        return ids + [self.end] * (self.length - len(ids))

    def mask(self, ids: list[int]) -> list[int]:
        """Ones up to and with the first end id."""
        stop = ids.index(self.end)
        return [int(i <= stop) for i in range(len(ids))]


class PieceTokens:
    """BPE over characters with ``▁`` for spaces and bytes for characters out of vocabulary; begin and end ids."""

    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int], begin: int, end: int, unknown: int = 3):
        self.vocab, self.ranks, self.begin, self.end, self.unknown = vocab, ranks, begin, end, unknown

    def encode(self, text: str, most: int = 512) -> list[int]:
        parts: list[str] = []
        for c in text.replace(" ", "▁"):
            parts += [c] if c in self.vocab else [f"<0x{b:02X}>" for b in c.encode()]
        ids = [self.vocab.get(p, self.unknown) for p in merge_pairs(parts, self.ranks)]
        return [self.begin, *ids[: most - 2], self.end]
