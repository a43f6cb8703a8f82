"""Substring dedup: documents are parsed relative to the whole corpus, block by block.

A relative Lempel-Ziv parse covers a document greedily with the longest pieces that a reference holds. Here the
reference is every document, and its index must not be copied to each task, so both sides are first cut at places
that the words themselves choose: of nine 5-word hashes in a row the least one is an anchor, and the windows of 13
words that share an anchor make up one phrase. Equal passages are thus cut alike, wherever they stand.

1. Index and parse: a reference block (the documents that a task reads) lists its phrases with the smallest document
   of each. The shuffle brings a phrase together with all blocks that index its anchor, and a phrase that a smaller
   document has is a factor as a whole. Most of a repeated passage goes this way, a fifth of a row for each window.
2. Boundaries: where a passage begins or ends, a phrase reaches into other words and is no factor, though its anchor
   is found elsewhere. Only of such phrases the single windows are indexed and looked up, in the same way.
3. Factors that overlap or touch are joined into spans.

As a block lists each phrase once, a passage that a third of all documents share is one row a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, table
from .shingles import WordHashes, mixed, shingles

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 13, 5
#: Phrases or windows that a block holds at most, but for those of one document.
BLOCK = 2_000_000

_M = 0xD1342543DE82EF95
_M_INVERSE = pow(_M, -1, 1 << 64)


class _Bytes(WordHashes):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= 400_000:
            self.clear()
        self[word] = mark = xxhash.xxh3_64_intdigest(word)
        return mark


_hashes = _Bytes()


def split_words(text: str) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+`: bytes are split at exactly these characters."""
    return text.encode("utf-8", "surrogatepass").split()


class Parsed:
    """The windows and phrases of a text: phrase i has the windows first[i] .. last[i]."""

    def __init__(self, words: list[bytes], window: int, anchor: int):
        self.window = window
        n = len(words)
        self.n_windows = max(0, n - window + 1)
        if not self.n_windows:
            self.first = self.last = np.empty(0, np.int64)
            self.anchors, self.phrases = np.empty(0, np.int32), np.empty(0, np.uint64)
            return
        marks = np.fromiter(map(_hashes.__getitem__, words), np.uint64, n)
        grams = shingles(marks, anchor)
        least, at = grams[: self.n_windows].copy(), np.arange(self.n_windows)
        for i in range(1, window - anchor + 1):
            other = grams[i : i + self.n_windows]
            better = other < least
            np.copyto(least, other, where=better)
            at[better] = np.flatnonzero(better) + i
        cuts = np.flatnonzero(np.diff(at)) + 1
        self.first, self.last = np.append(0, cuts), np.append(cuts, self.n_windows) - 1
        self.anchors = (least[self.first] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        self._sums = np.zeros(n + 1, np.uint64)
        powers = np.full(n, _M, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        np.cumsum(marks * powers, out=self._sums[1:])
        self.back = np.full(n, _M_INVERSE, np.uint64)
        self.back[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        offset = (at[self.first] - self.first + 1).astype(np.uint64)
        self.phrases = self._hash(self.first, self.last + window) ^ mixed(offset)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self._sums[end] - self._sums[start]) * self.back[start] + (end - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))

    def windows(self, at: np.ndarray) -> np.ndarray:
        return self._hash(at, at + self.window)

    def windows_of(self, phrases: np.ndarray) -> np.ndarray:
        """The windows of the phrases with these numbers."""
        counts = self.last[phrases] - self.first[phrases] + 1
        return np.repeat(self.first[phrases] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())


def _block(anchors: np.ndarray, marks: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A block's index: anchor, mark, the smallest id that has the mark, and the other ids that have it."""
    order = np.lexsort((ids, marks))
    anchors, marks, ids = anchors[order], marks[order], ids[order]
    new_mark = np.ones(len(marks), bool)
    new_mark[1:] = marks[1:] != marks[:-1]
    new = new_mark.copy()
    new[1:] |= ids[1:] != ids[:-1]
    anchors, marks, ids, new_mark = anchors[new], marks[new], ids[new], new_mark[new]
    starts = np.flatnonzero(new_mark)
    # the others of a mark stand after its first row
    ends = np.append(starts[1:], len(marks)) - np.arange(1, len(starts) + 1)
    others = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids[~new_mark]))
    return pa.RecordBatch.from_arrays([pa.array(anchors[starts]), pa.array(marks[starts].view(np.int64)), pa.array(ids[starts]), others], names=["anchor", "mark", "id", "others"])


_BLOCK_SCHEMA = "anchor int, mark long, id long, others array<long>"


def _blocks(parts: Iterator[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """Blocks of the anchors and marks of single documents."""
    held, size = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if size:
            ids = np.repeat(np.array([x[2] for x in held], np.int64), [len(x[0]) for x in held])
            block = _block(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), ids)
            for start in range(0, block.num_rows, 50_000):
                yield block.slice(start, 50_000)

    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= BLOCK:
            yield from flush()
            held, size = [], 0
    yield from flush()


def duplicate_parts(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """For `docs` (id, body) without nulls, each row with `whole`, the marks of its phrases that a smaller id has, and
    `single`, the marks of windows at the boundaries that a smaller id has; null where there are none."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for number, text in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), strict=True):
                    parsed = Parsed(split_words(text), window, anchor)
                    yield parsed.anchors, parsed.phrases, number

        return _blocks(parts())

    same_anchor, same_mark = Window.partitionBy("anchor"), Window.partitionBy("anchor", "mark")
    found = (
        map_arrow(docs, index, _BLOCK_SCHEMA)
        .repartition("anchor")
        .withColumn("least", F.min("id").over(same_mark))
        .withColumn("one_mark", F.min("mark").over(same_anchor) == F.max("mark").over(same_anchor))
        .withColumn("one_id", F.min("id").over(same_anchor) == F.max(F.greatest("id", F.coalesce(F.array_max("others"), "id"))).over(same_anchor))
    )
    factor = F.struct("id", "mark", (F.col("id") > F.col("least")).alias("whole"))
    flags = found.filter((F.col("id") > F.col("least")) | (F.size("others") > 0) | ~(F.col("one_mark") | F.col("one_id"))).select(
        F.explode(
            F.concat(
                F.filter(F.array(factor), lambda x: x["whole"] | ~(F.col("one_mark") | F.col("one_id"))),
                F.transform("others", lambda x: F.struct(x.alias("id"), F.col("mark").alias("mark"), F.lit(True).alias("whole"))),
            )
        ).alias("x")
    )
    flags = cut(flags.groupBy("x.id").agg(F.collect_list(F.when(F.col("x.whole"), F.col("x.mark"))).alias("whole"), F.collect_list(F.when(~F.col("x.whole"), F.col("x.mark"))).alias("open")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for batch in batches:
                for number, text, marks in zip(batch.column("id").to_pylist(), batch.column("body").to_pylist(), batch.column("open"), strict=True):
                    parsed = Parsed(split_words(text), window, anchor)
                    phrases = np.flatnonzero(np.isin(parsed.phrases, marks.values.to_numpy().view(np.uint64)))
                    windows = parsed.windows(parsed.windows_of(phrases))
                    yield (windows >> np.uint64(32)).astype(np.uint32).view(np.int32), windows, number

        return _blocks(parts())

    opened = map_arrow(docs.join(flags.filter(F.size("open") > 0).select("id", "open"), "id"), look, _BLOCK_SCHEMA)
    opened = opened.repartition("mark").withColumn("least", F.min("id").over(Window.partitionBy("mark")))
    single = (
        opened.filter((F.col("id") > F.col("least")) | (F.size("others") > 0))
        .select("mark", F.explode(F.concat(F.when(F.col("id") > F.col("least"), F.array("id")).otherwise(F.array().cast("array<long>")), "others")).alias("id"))
        .groupBy("id").agg(F.collect_list("mark").alias("single"))
    )
    return docs.join(flags.select("id", "whole"), "id", "left").join(single, "id", "left")


def covered(text_words: list[bytes], whole: np.ndarray, single: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Which words the duplicate phrases and windows cover."""
    n = len(text_words)
    steps = np.zeros(n + 1, np.int32)
    if len(whole) or len(single):
        parsed = Parsed(text_words, window, anchor)
        if len(whole):
            hit = np.isin(parsed.phrases, whole)
            np.add.at(steps, parsed.first[hit], 1)
            np.add.at(steps, parsed.last[hit] + window, -1)
        if len(single) and parsed.n_windows:
            hit = np.flatnonzero(np.isin(parsed.windows(np.arange(parsed.n_windows)), single))
            np.add.at(steps, hit, 1)
            np.add.at(steps, hit + window, -1)
    return np.cumsum(steps)[:n] > 0


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of `docs`: the id, n_words, n_removed, spans (start and number of words of what goes), and kept,
    the words that stay, joined by one space.

    A word goes if a window of `window` words in a row covers it whose word sequence also starts in a row with a
    smaller id. A null text counts as empty; texts of fewer words than a window lose nothing. Rows that repeat an id
    are no reference for each other. Rows with a null id lose nothing and are no reference. An empty table gives an
    empty result; extra columns are ignored. Ids are integers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    named = rows.filter("id is not null")
    parts = duplicate_parts(named, window, anchor)
    nothing = rows.filter("id is null").select("id", "body", F.lit(None).cast("array<long>").alias("whole"), F.lit(None).cast("array<long>").alias("single"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, whole, single in zip(batch.column("body").to_pylist(), batch.column("whole"), batch.column("single"), strict=True):
                words = split_words(text)
                gone = covered(words, *(x.values.to_numpy().view(np.uint64) if x.is_valid else none for x in (whole, single)), window, anchor)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                spans.append([{"start": int(s), "words": int(e - s)} for s, e in zip(edges[::2], edges[1::2], strict=True)])
                kept.append(b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x] if removed[-1] else words).decode("utf-8", "surrogatepass"))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "spans", "kept"])

    done = parts.select("id", "body", "whole", "single").unionByName(nothing).mapInArrow(run, "id long, n_words long, n_removed long, spans array<struct<start:int,words:int>>, kept string")
    return done.withColumnRenamed("id", id_col)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
least AS (SELECT g, min(doc_id) AS d FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN least USING (g) WHERE doc_id > d),
each AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
