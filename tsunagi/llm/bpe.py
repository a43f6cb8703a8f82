"""Byte-level BPE encoding and decoding.

The merges of a piece run off a rank queue: each merge rank has a bucket of positions in the piece's linked list of
symbols, and a hierarchical bitmap over the ranks tells by find-first-set which bucket is next. A merge only pushes
its two new pairs; entries whose pair has changed since are stale and skipped when they come up. So a piece of n
bytes takes about n pushes and pops, and a piece of a million letters costs no more a byte than a short one.
"""

from __future__ import annotations

import base64
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table

#: Characters below this one are told apart by listed classes.
NARROW = 0x250
#: Pieces that a worker remembers, twice, and the longest piece that it remembers.
REMEMBERED, LONGEST = 200_000, 48
#: Bytes of text that are encoded at a time.
SLICE = 4_000_000
#: Rows that are decoded at a time.
ROWS = 1_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _narrow(pattern: str) -> str:
    """`pattern` for texts of characters below NARROW alone, where classes can be listed; Python's own re then serves."""
    for name in "LN":
        chars = "".join(re.escape(chr(i)) for i in range(NARROW) if unicodedata.category(chr(i))[0] == name)
        inside = re.sub(r"(\[[^\]]*)\\p\{%s\}" % name, lambda m: m[1] + chars, pattern)
        pattern = inside.replace(r"\p{%s}" % name, f"[{chars}]")
    return pattern


class Bpe:
    """Encodes and decodes by merge ranks; `pattern` splits a text into pieces that are encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.width = ranks, max(map(len, ranks))
        # white space as Unicode defines it, as the tokenizer library has it; Python adds four control characters
        unicode_space = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.wide, self.narrow = regex.compile(unicode_space).findall, re.compile(_narrow(pattern)).findall
        self.odd = re.compile(f"[^\\x00-\\x1b\\x20-{chr(NARROW - 1)}]").search
        self.known = _Known(self.merge)

    def split(self, text: str) -> list[str]:
        return (self.wide if self.odd(text) else self.narrow)(text)

    def merge(self, piece: bytes) -> bytes:
        """The ids of a piece, four bytes each.

        `buckets` holds, for each rank, the position whose symbol merges with the next one at that rank, or a heap of
        them; bit r % 256 of `words[r // 256]` says whether the bucket has any, and bit w of `top` whether words[w] has.
        """
        get, width, n = self.ranks.get, self.width, len(piece)
        if (whole := get(piece)) is not None:
            return whole.to_bytes(4, "little")
        after = list(range(1, n + 1))  # where the symbol that starts here ends
        before = list(range(-1, n))  # where the symbol before it starts
        pair = [-1] * n  # the rank of a symbol with the next one; -1: they don't merge, or no symbol starts here
        buckets: dict[int, int | list[int]] = {}
        words: dict[int, int] = {}
        top, at = 0, 0
        for first in range(n - 1):
            if (rank := get(piece[first : first + 2])) is not None:
                pair[first] = rank
                if rank in buckets:
                    if type(bucket := buckets[rank]) is int:
                        buckets[rank] = [bucket, first]
                    else:
                        bucket.append(first)
                else:
                    buckets[rank] = first
                    word = rank >> 8
                    if word in words:
                        words[word] |= 1 << (rank & 255)
                    else:
                        words[word] = 1 << (rank & 255)
                        top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = word << 8 | (bits & -bits).bit_length() - 1
            at = buckets[rank]
            if type(at) is not int and len(at) > 1:
                at = heappop(at)
            else:
                if type(at) is not int:
                    at = at[0]
                del buckets[rank]
                if bits := bits & (bits - 1):
                    words[word] = bits
                else:
                    del words[word]
                    top &= top - 1
            if pair[at] != rank:
                continue  # stale
            gone = after[at]
            end = after[at] = after[gone]
            pair[gone] = -1
            if end < n:
                before[end] = at
            first = at
            while first >= 0:  # the new symbol with the next one, then the one before it with the new one
                middle = after[first]
                if middle < n and (last := after[middle]) - first <= width and (rank := get(piece[first:last])) is not None:
                    pair[first] = rank
                    if rank in buckets:
                        if type(bucket := buckets[rank]) is int:
                            buckets[rank] = [bucket, first] if bucket < first else [first, bucket]
                        else:
                            heappush(bucket, first)
                    else:
                        buckets[rank] = first
                        word = rank >> 8
                        if word in words:
                            words[word] |= 1 << (rank & 255)
                        else:
                            words[word] = 1 << (rank & 255)
                            top |= 1 << word
                else:
                    pair[first] = -1
                if first != at:
                    break
                first = before[at]
        out, at = [], 0
        while at < n:
            out.append(get(piece[at : after[at]]))
            at = after[at]
        return struct.pack(f"<{len(out)}i", *out)

    def encode(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        return b"".join(map(self.known.__getitem__, self.split(text)))


class _Known(dict):
    """Ids by piece. When it is full, it starts anew, but still finds what it had before."""

    def __init__(self, merge):
        self.merge, self.old = merge, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8", "surrogatepass"))
            if len(piece) > LONGEST:
                return ids
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def _slices(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE bytes of column `name` (no nulls), or one row."""
    sizes = np.cumsum(pc.binary_length(batch.column(name)).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + SLICE, side="right")))
        yield batch.slice(start, end - start)
        start = end


#: One coder a worker process and vocabulary, so that what it remembers serves all tasks.
_coders: dict[tuple[int, str], Bpe] = {}


def _coder(vocabulary, name: str, pattern: str) -> Bpe:
    key = (name, pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Bpe(vocabulary.value, pattern)
    return _coders[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of `docs` and the token ids of the whole text, array<int>, without special tokens.

    The vocabulary file is read by the driver and broadcast; its size is that of the vocabulary, not of the data.
    A null text counts as empty and has no ids; repeated rows, empty tables and extra columns need no care.
    """
    session, keep = docs.sparkSession, list(keep)
    vocabulary = session.sparkContext.broadcast(read_ranks(ranks_path))
    source = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias(ids_col))
    schema = T.StructType([*source.select(*keep).schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary, ranks_path, pattern)
        for whole in batches:
            for batch in _slices(whole, ids_col):
                ids = [coder.encode(x) for x in batch.column(ids_col).to_pylist()]
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in ids], out=ends[1:])
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[*keep, ids_col])

    return map_arrow(source, run, schema)


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All columns of `tokens` and the bytes that its ids stand for, as binary; null ids count as none.
    An id that the vocabulary lacks is an error. `bytes_col` must not be a column already."""
    if bytes_col in tokens.columns:
        raise ValueError(f"there is a column {bytes_col} already")
    ranks = read_ranks(ranks_path)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    vocabulary = tokens.sparkSession.sparkContext.broadcast(pieces)
    schema = T.StructType([*tokens.schema.fields, T.StructField(bytes_col, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = vocabulary.value.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = [b"".join(map(piece, x.values.to_numpy().tolist())) if x.is_valid else b"" for x in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[*part.schema.names, bytes_col])

    return map_arrow(tokens, run, schema)


def coded(docs: DataFrame, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """`docs` encoded and decoded again with the production vocabulary: the columns `keep`, ids and decoded."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return decode(encode(docs, path, public_tokenizers.PATTERN, keep=keep), path)


def digests(tokens: DataFrame, *keep: str) -> DataFrame:
    return tokens.select(
        *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(coded(table(spark, sf_dir, "documents")), "doc_id")
