"""Best-fit packing by sums of squares.

A sequence is open while it has a gap. Each piece goes into the open
sequence that makes the sum over all gaps g of N(g)^2 smallest, N(g) being
the number of open sequences with gap g; a new one is opened only where no
open one has room, since fewest sequences are wanted. Pieces are placed from
long to short, independently in hash-dealt shards of bounded size, so no
task holds more than a few thousand lengths and a lost one is done again
alone.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written

PIECES_PER_SHARD = 4096
NUMBER = "__number"

#: Texts made of these characters only, with no long unbroken run, go to the faster
#: of two encoders that agree on them; any other text goes to the reference one.
_PLAIN = re.compile(r"[\x00-\x7f -ſ‐-‧€]*\Z")
_LONG_RUN = re.compile(r"\S{400}|\s{400}")
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def _encoders(path: str):
    """The tokenizers file, and the same vocabulary as a rank table where the
    file is a plain byte-level BPE (ids in merge order)."""
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        return exact, None
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    alphabet = byte_alphabet()
    ranks = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
    return exact, tiktoken.Encoding("ranks", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)


def encode(path: str, text: str) -> list[int]:
    exact, fast = _encoders(path)
    if fast is not None and _PLAIN.match(text) and not _LONG_RUN.search(text):
        return fast.encode(text, allowed_special="all")
    return exact.encode(text, add_special_tokens=False).ids


def piece_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of a document of n ids; all but the first are full."""
    if n <= capacity:
        return [n]
    first = (n - 1) % capacity + 1
    return [first, *[capacity] * ((n - first) // capacity)]


class SumOfSquares:
    """Open sequences of one shard, by gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to capacity ids."""
        cap, n = self.capacity, self.counts
        there = n[size:cap]
        if there.any():
            change = 2 * (n[: cap - size] - there + 1)  # gap g loses one, gap g - size gains one
            change[0] -= 1  # a full sequence is no longer open
            gap = size + int(np.where(there > 0, change, np.iinfo(np.int64).max).argmin())
            at = self.open[gap].pop()
            n[gap] -= 1
        else:
            at, gap = self.made, cap
            self.made += 1
        if gap > size:
            n[gap - size] += 1
            self.open[gap - size].append(at)
        return at, cap - gap


def token_pieces(df: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: its document, number, start, length and checksum."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = np.array([*encode(tokenizer, text.as_py()), end_id], "<u4")
                start = 0
                for k, n in enumerate(piece_lengths(len(ids), capacity)):
                    rows.append((doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                    start += n
            if rows:
                columns = zip(zip(*rows, strict=True), _PIECE.types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=_PIECE)

    return id_and_text(df, id_col, text_col).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def pack_lengths(pieces: DataFrame, capacity: int, shard_size: int = PIECES_PER_SHARD) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and a `length` of 1 to capacity."""
    if NUMBER not in pieces.columns:
        pieces = written(pieces.withColumn(NUMBER, F.monotonically_increasing_id()), "pieces")
    shards = max(1, -(-pieces.count() // shard_size))
    schema = [f for f in pieces.schema if f.name != NUMBER]

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        state = SumOfSquares(capacity)
        put = [state.place(int(n)) for n in group["length"]]
        first = int(group["__shard"].iloc[0]) << 32
        group = group.assign(sequence_id=first + np.array([a for a, _ in put], "int64"), offset=np.array([b for _, b in put], "int64"))
        return group.drop(columns=["__shard", NUMBER])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    # by the written row number, so that rows that repeat in bulk are dealt like all others
    dealt = pieces.withColumn("__shard", F.pmod(F.xxhash64(NUMBER), F.lit(shards)))
    return dealt.groupBy("__shard").applyInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 1024,
    end_id: int = 2,
    shard_size: int = PIECES_PER_SHARD,
) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Result: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts are one piece that holds the end id only; a null id is
    kept as null; repeated rows are packed once each; ties in length go by
    doc_id and piece; other columns are ignored, whatever their names; an
    empty table gives an empty result.
    """
    pieces = token_pieces(df, tokenizer, id_col, text_col, capacity, end_id)
    pieces = written(pieces.withColumn(NUMBER, F.monotonically_increasing_id()), "pieces")
    return pack_lengths(pieces, capacity, shard_size)
