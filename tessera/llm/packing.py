"""Packing by concatenate and cut.

First pass: each partition tokenizes its documents, keeps their ids and counts its tokens.  A prefix sum
over the partitions' totals (one row each) gives every partition its global offset.  Second pass: the
stream is cut at fixed windows; a document that crosses a boundary gives one record for each window.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .bytewords import strings
from .store import park

WIDTH = 2048
END = 1


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A byte-level BPE encoder for the ordinary text of a ``tokenizers`` JSON file; :func:`ids_of` knows its added tokens.

    The file's vocabulary and merges are given to tiktoken, whose ids are the same (a test holds them
    against ``tokenizers``) at about four times the speed.
    """
    import tiktoken

    with open(vocabulary, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["id"] for t in model.get("added_tokens", ())}
    # Byte-level BPE writes each byte as a printable character: itself where printable, else from 256 on.
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if i not in special}
    import public_tokenizers

    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def added_tokens(vocabulary: str) -> dict[str, int]:
    """The ids of the file's added tokens; those with rules on what stands around them are refused, not read otherwise."""
    with open(vocabulary, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens", ())
    if any(t.get(rule) for t in tokens for rule in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens with rules in {vocabulary}")
    return {t["content"]: t["id"] for t in tokens if t["content"]}


def ids_of(vocabulary: str, added: bool) -> Callable[[str], list[int]]:
    """A text's ids.  With ``added``, as ``tokenizers`` gives them by default: added tokens are cut out first, of those that
    begin at one place the longest, and the texts between them are encoded each on its own.  Without, their strings are text.
    """
    ordinary = encoder(vocabulary).encode_ordinary
    tokens = added_tokens(vocabulary) if added else {}
    if not tokens:
        return ordinary
    cut = re.compile("|".join(map(re.escape, sorted(tokens, key=len, reverse=True))))

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for m in cut.finditer(text):
            out += [*ordinary(text[at : m.start()]), tokens[m[0]]]
            at = m.end()
        return out + ordinary(text[at:]) if at else ordinary(text)

    return encode


def id_type(vocabulary: str) -> str:
    """Two bytes for an id where the vocabulary and its added tokens allow."""
    most = max([encoder(vocabulary).n_vocab - 1, *added_tokens(vocabulary).values()])
    return "<u2" if most < 1 << 16 else "<u4"


def tokenize(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", added: bool = False) -> DataFrame:
    """_pid, _before (tokens before it in its partition), id, _n and _ids (little-endian, unsigned, as wide as the vocabulary needs); parked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind = ids_of(vocabulary, added), id_type(vocabulary)
        pid, before = TaskContext.get().partitionId(), 0
        for b in batches:
            # A few rows at a time, so that ids of long texts don't pile up.
            for i in range(0, b.num_rows, 64):
                ids = [np.array([*encode(t), END], kind) for t in strings(b.column(1).slice(i, 64)).to_pylist()]
                n = np.array([len(x) for x in ids], np.int64)
                start = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), pid, np.int64)), pa.array(start), b.column(0).slice(i, 64), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], names=["_pid", "_before", "_id", "_n", "_ids"])

    read = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    return park(read.mapInArrow(run, "_pid long, _before long, _id long, _n long, _ids binary"))


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, added: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    All sequences but the last are full, so there is padding only in the last.  A null or empty text is the end token alone.
    Repeated rows are packed each on its own, in the partitions' order.  A null id stays null.  An empty
    table gives no rows.  Documents of any length are cut into as many pieces as they need.  ``added``: whether the
    strings of added tokens give those tokens' ids, as in :func:`ids_of`.
    """
    parked = tokenize(docs, vocabulary, id_col, text, added)
    totals = parked.groupBy("_pid").agg(F.sum("_n").alias("_total"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("_pid").alias("_p"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    # A row per partition: some 16 bytes for each 128 MB of input.  Parked, its size is known, and Spark
    # broadcasts it below its threshold or joins by shuffle.
    base = park(base)
    placed = parked.join(base, F.col("_pid") == F.col("_p")).select("_id", "_n", (F.col("_base") + F.col("_before")).alias("_at"), "_ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = id_type(vocabulary)
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        for b in batches:
            rows: list[tuple] = []
            for d, n, at, ids in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
                raw, start = np.frombuffer(ids.as_buffer(), kind).astype("<u4").tobytes(), 0
                while start < n:
                    seq, place = divmod(at + start, width)
                    length = min(n - start, width - place)
                    piece = raw[4 * start : 4 * (start + length)]
                    rows.append((d, start, length, zlib.crc32(piece), n, seq, place, piece))
                    start += length
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    return placed.mapInArrow(cut, f"`{id_col}` long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, width: int = WIDTH, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens and token ids (array of int): padded to ``width``, except where the number is a power of two."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").cast("int").alias("n_tokens"), parts.alias("_parts"))

    @F.arrow_udf(ArrayType(IntegerType()))
    def lay(column: pa.Array) -> pa.Array:
        out = []
        for row in column.to_pylist():
            got = np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int32)
            full = len(got) & (len(got) - 1) == 0
            out.append(got if full else np.concatenate([got, np.full(width - len(got), pad, np.int32)]))
        return pa.array(out, pa.list_(pa.int32()))

    return whole.select("sequence_id", "n_tokens", lay("_parts").alias("ids"))
