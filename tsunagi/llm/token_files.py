"""Token ids as files of Simple-8b words.

A word of 64 bits has a selector of four bits and, by it, 240 values of no bits (zeros) to one value of 60. A value that
fills its bits with ones is an escape: the id itself stands in a list of 32-bit numbers beside the words. At each place
the selector is taken that costs the fewest bits an id, escapes counted, so that a rare large id does not widen the ids
around it. Ids are packed in blocks of `BLOCK`; each block starts a word, and the first word and the first escape of each
block are listed, so that a block can be read alone, and all of them with a few operations on arrays.

A file is Parquet: Spark commits it as a whole, on any store that Spark writes. A row is a run of whole documents, its
columns the words, the escapes, the blocks' offsets, the documents' ids and where each of them ends. `part` and `first`
tell where the run stands: parts are in ascending order, and `first` counts the ids before it in its part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .common import map_arrow, table
from .library import library
from tsunagi.sources.staging import new_folder

#: Fixed values of the format: how many ids a word holds, and of how many bits, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: The value that stands for an escape; for no bits, any value but zero would be one, but none is allowed.
MARKS = np.array([(1 << int(w)) - 1 if w else 1 for w in WIDTHS], np.uint64)
#: Ids a block. Ids after which a row ends with the document that is under way.
BLOCK, RUN = 4096, 65_536
_STRIDE = BLOCK + int(COUNTS[0])
#: A number that every count divides.
_MULTIPLE = 1680


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (uint64), escapes (uint32), and each block's first word and first escape, of ids below 2**32."""
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int32)
    padded = np.zeros((blocks, _STRIDE), np.uint32)
    full = len(ids) // BLOCK
    padded[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    if full < blocks:
        padded[full, : len(ids) - full * BLOCK] = ids[full * BLOCK :]
    values = padded.reshape(-1)
    # at each place the least of cost << 4 | selector; a cost is bits an id, times a common multiple of all counts
    best, before = np.full(len(values), np.iinfo(np.int32).max, np.int32), np.zeros(len(values) + int(COUNTS[0]) + 1, np.int32)
    for selector, (count, width) in enumerate(zip(COUNTS.tolist(), WIDTHS.tolist(), strict=True)):
        over = values >= MARKS[selector].astype(np.uint32) if width < 32 else np.zeros(len(values), bool)
        n_over = int(np.count_nonzero(over))
        if blocks * BLOCK - n_over < count // 2:
            continue  # nearly all would be escapes
        share = _MULTIPLE // count << 4
        if n_over:
            np.cumsum(over, out=before[1 : len(values) + 1])
            before[len(values) + 1 :] = before[len(values)]
            cost = before[count : count + len(values)] - before[: len(values)]
            if not width:
                cost[cost > 0] = 1 << 9  # no escapes among no bits
            cost *= 32 * share
            cost += 64 * share + selector
            np.minimum(best, cost, out=best)
        else:
            np.minimum(best, np.int32(64 * share + selector), out=best)
            break  # all fit, so fewer and wider ones cost more
    best &= 15
    values = values.astype(np.uint64)
    steps, starts, block_words = COUNTS[best].tolist(), [], np.zeros(blocks, np.int32)
    for b in range(blocks):
        block_words[b] = len(starts)
        at, end = b * _STRIDE, b * _STRIDE + min(BLOCK, len(ids) - b * BLOCK)
        while at < end:
            starts.append(at)
            at += steps[at]
    at = np.array(starts)
    chosen = best[at]
    words, mark = chosen.astype(np.uint64) << np.uint64(60), np.full(len(values), np.iinfo(np.uint64).max, np.uint64)
    for selector in np.unique(chosen).tolist():
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        mine = np.flatnonzero(chosen == selector)
        slots = at[mine][:, None] + np.arange(count)
        if width:
            mark[slots] = MARKS[selector]
            shifts = (np.arange(count) * width).astype(np.uint64)
            words[mine] |= np.bitwise_or.reduce(np.minimum(values[slots], MARKS[selector]) << shifts, axis=1)
    escaped = np.flatnonzero(values >= mark)
    return words, values[escaped].astype(np.uint32), block_words, np.searchsorted(escaped, np.arange(blocks) * _STRIDE).astype(np.int32)


def unpack(words: np.ndarray, escapes: np.ndarray, block_words: np.ndarray, n: int) -> np.ndarray:
    """The `n` ids (uint32) of consecutive blocks; `block_words` has the place of each block's first word in `words`."""
    blocks = len(block_words)
    values = np.zeros(blocks * _STRIDE, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(COUNTS[chosen])])
    of = np.repeat(np.arange(blocks), np.diff(np.append(block_words, len(words))))
    starts = before[:-1] - before[block_words][of] + of * _STRIDE
    escaped = np.zeros(len(values), bool)
    for selector in np.unique(chosen).tolist():
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        if not width:
            continue
        mine = np.flatnonzero(chosen == selector)
        raw = (words[mine][:, None] >> (np.arange(count) * width).astype(np.uint64)) & MARKS[selector]
        slots = starts[mine][:, None] + np.arange(count)
        values[slots] = raw
        if width < 60:
            escaped[slots] = raw == MARKS[selector]
    values[escaped] = escapes
    return values.reshape(blocks, _STRIDE)[:, :BLOCK].reshape(-1)[:n].astype(np.uint32)


def unpack_block(words: np.ndarray, escapes: np.ndarray, block_words: np.ndarray, block_escapes: np.ndarray, n: int, block: int) -> np.ndarray:
    """The ids of one block of a row of `n` ids, without looking at the others."""
    ends = lambda starts, whole: (int(starts[block]), int(starts[block + 1]) if block + 1 < len(starts) else whole)
    (a, b), (c, d) = ends(block_words, len(words)), ends(block_escapes, len(escapes))
    return unpack(words[a:b], escapes[c:d], np.zeros(1, np.int64), min(BLOCK, n - block * BLOCK))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encodes every whole text and writes the ids, each document's with `end_id` after them, to files under `path`.

    Documents are in ascending order of their id: null ids first, rows of one id by their texts' hashes, so repeated
    rows may stand in any order among themselves. A null text counts as empty and leaves the end id alone. Special
    tokens are not added; their strings inside texts get their ids, as the library does. An empty table writes no rows;
    other columns are ignored, whatever their names. A task holds one slice of texts and one row of ids at a time; a
    document longer than `RUN` ids makes a row of its length.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("body")).withColumn("mark", F.xxhash64("body"))
    ordered = rows.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark").select("id", "body")
    id_type = ordered.schema["id"].dataType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()), T.StructField("escapes", T.BinaryType()),
        T.StructField("block_words", T.ArrayType(T.IntegerType())), T.StructField("block_escapes", T.ArrayType(T.IntegerType())),
    ])
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, first = library(definition, tokenizer_path, False), TaskContext.get().partitionId(), 0
        ids, parts, ends, size = [], [], [], 0

        def row() -> pa.RecordBatch:
            words, escapes, block_words, block_escapes = pack(np.frombuffer(b"".join(parts), "<u4"))
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first]), pa.array([size]), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), pa.concat_arrays(ids)),
                 one(ends, pa.int64()), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([escapes.astype("<u4").tobytes()], pa.binary()),
                 one(block_words, pa.int32()), one(block_escapes, pa.int32())],
                names=schema.names,
            )

        for whole in batches:
            for batch in _slices(whole, "body"):
                coded, start = coder.encode(batch.column("body").to_pylist()), 0
                for at, tokens in enumerate(coded, 1):
                    parts += tokens, last
                    size += len(tokens) // 4 + 1
                    ends.append(size)
                    if size >= RUN:
                        ids.append(batch.column("id").slice(start, at - start))
                        yield row()
                        first, start, ids, parts, ends, size = first + size, at, [], [], [], 0
                if start < batch.num_rows:
                    ids.append(batch.column("id").slice(start))
        if size:
            yield row()

    map_arrow(ordered, run, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", ids_col: str | None = "tokens") -> DataFrame:
    """One row a document of the files under `path`: its id, `start` (ids of all documents before it), n_tokens (with the
    end id), ids_crc32 (of its ids as little-endian unsigned 32-bit numbers) and, unless `ids_col` is None, the ids."""
    runs = spark.read.parquet(path)
    # one row a file's part is collected, as many as the writing stage had tasks
    sizes = sorted((r["part"], r["size"]) for r in runs.groupBy("part").agg(F.max(F.col("first") + F.col("n_ids")).alias("size")).collect())
    starts, total = {}, 0
    for part, size in sizes:
        starts[part] = total
        total += size
    kind = runs.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType(), False) for c in ("start", "n_tokens", "ids_crc32"))])
    if ids_col:
        schema.add(ids_col, T.ArrayType(T.LongType(), False), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell = lambda name: batch.column(name)[row]  # noqa: B023, E731
                n = cell("n_ids").as_py()
                ids = unpack(np.frombuffer(cell("words").as_py(), "<u8"), np.frombuffer(cell("escapes").as_py(), "<u4"), cell("block_words").values.to_numpy(), n)
                ends = cell("ends").values.to_numpy()
                begins = np.concatenate([[0], ends[:-1]])
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [cell("ids").values, pa.array(begins + (starts[cell("part").as_py()] + cell("first").as_py())), pa.array(ends - begins), pa.array(sums, pa.int64())]
                if ids_col:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begins, n), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return map_arrow(runs, run, schema)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_folder(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path, ids_col=None)
