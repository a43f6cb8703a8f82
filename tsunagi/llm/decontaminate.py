"""Benchmark decontamination by greedy string tiling.

Seeds are k words in a row; documents and benchmark items meet in a join on the hashes of their seeds. A pair's
shared seeds lie on diagonals, and k-word matches in a row on one diagonal are one longer match. Of these the longest
is marked as a tile again and again, and what it covers is taken away from the others, until no match of k words is
left unmarked. As tiles may stand in any order, a passage whose sentences were shuffled is covered all the same.

The seeds of the benchmark filter the documents' seeds inside the scan if they are few enough to be sent to all
executors (`FILTER` seeds); otherwise the join alone does it, by a shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, small, table
from .shingles import shingles, word_hashes

#: Words of a seed, which are also the fewest words of a tile.
SEED = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.8
#: Seeds that are sent to all executors at most, 8 bytes each.
FILTER = 2_000_000


def tiles(doc_at: np.ndarray, item_at: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of one document and one item, given where they share k words: the tiles as
    (position in the document, position in the item, words), longest first, ties by position."""
    order = np.lexsort((doc_at, doc_at - item_at))
    doc_at, item_at = doc_at[order], item_at[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(doc_at) != 1) | (np.diff(item_at) != 1)
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(order))) + k - 1
    heap = [(-int(n), int(d), int(i)) for n, d, i in zip(lengths, doc_at[starts], item_at[starts], strict=True)]
    heapq.heapify(heap)
    doc_marked, item_marked = set(), set()
    found = []
    while heap:
        n, d, i = heapq.heappop(heap)
        free = [d + x not in doc_marked and i + x not in item_marked for x in range(-n)]
        if all(free):
            found.append((d, i, -n))
            doc_marked.update(range(d, d - n))
            item_marked.update(range(i, i - n))
            continue
        start = None  # what is left of the match goes back, in parts
        for x, is_free in enumerate([*free, False]):
            if is_free and start is None:
                start = x
            elif not is_free and start is not None:
                if x - start >= k:
                    heapq.heappush(heap, (start - x, d + start, i + start))
                start = None
    return found


def _seeds(df: DataFrame, id_col: str, text_col: str, k: int, only=None) -> DataFrame:
    """row, id, n_words, and the seeds of the text as arrays `mark` and `at`; rows without a seed in `only` go."""
    source = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if only is None else only.value
        for batch in batches:
            counts, marks, at, kept = [], [], [], []
            for number, text in enumerate(batch.column("body").to_pylist()):
                words = word_hashes(text)
                seeds = shingles(words, k)
                where = np.arange(len(seeds), dtype=np.int32)
                if wanted is not None and len(seeds):
                    place = np.searchsorted(wanted, seeds)
                    where = where[wanted[np.minimum(place, len(wanted) - 1)] == seeds] if len(wanted) else where[:0]
                if len(where):
                    kept.append(number)
                    counts.append(len(words))
                    marks.append(seeds[where].view(np.int64))
                    at.append(where)
            if kept:
                ends = pa.array(np.cumsum([0, *map(len, at)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").take(pa.array(kept)), batch.column("id").take(pa.array(kept)), pa.array(counts, pa.int32()),
                     pa.ListArray.from_arrays(ends, pa.array(np.concatenate(marks))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(at)))],
                    names=["row", "id", "n_words", "mark", "at"],
                )

    return map_arrow(source, run, f"row long, id {df.schema[id_col].dataType.simpleString()}, n_words int, mark array<long>, at array<int>")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = SEED, coverage: float = COVERAGE, most: int = FILTER
) -> DataFrame:
    """One row for each document and benchmark item whose tiles cover the share `coverage` of the item's words or
    more: the two ids, item_words, covered_words, coverage, n_tiles, and tiles, an array of (doc_at, item_at, words).

    Words are runs of letters and digits in lower case. Null and empty texts, and items of fewer than k words, match
    nothing. Repeated rows of a document are tiled each for itself and give one row if they agree in id and tiles. Empty
    tables give an empty result; extra columns are ignored.
    """
    flat = lambda df: df.select("row", "id", "n_words", F.explode(F.arrays_zip("mark", "at")).alias("s")).select("row", "id", "n_words", "s.mark", "s.at")
    items = cut(flat(_seeds(benchmark, item_id, item_text, k))).select("mark", F.col("row").alias("item_row"), F.col("id").alias("item"), F.col("n_words").alias("item_words"), F.col("at").alias("item_at"))
    only = None
    if items.limit(most + 1).count() <= most:
        known = items.select("mark").distinct().toPandas()["mark"].to_numpy(np.int64).view(np.uint64)
        only = docs.sparkSession.sparkContext.broadcast(np.sort(known))
    found = flat(_seeds(docs, doc_id, doc_text, k, only)).select("mark", "row", "id", F.col("at").alias("doc_at"))
    pairs = (
        found.join(items if only is None else F.broadcast(items), "mark")
        .groupBy("row", "id", "item_row", "item", "item_words")
        .agg(F.collect_list("doc_at").alias("doc_at"), F.collect_list("item_at").alias("item_at"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, covered, all_tiles = [], [], []
            for number, (n, doc_at, item_at) in enumerate(zip(batch.column("item_words").to_pylist(), batch.column("doc_at"), batch.column("item_at"), strict=True)):
                doc_at, item_at = doc_at.values.to_numpy(), item_at.values.to_numpy()
                starts = np.unique(item_at)
                most_covered = int(np.minimum(np.diff(np.append(starts, starts[-1] + k)), k).sum())
                if most_covered < coverage * n:  # tiles cover no more than all seeds do
                    continue
                found = tiles(doc_at, item_at, k)
                if (words := sum(t[2] for t in found)) >= coverage * n:
                    kept.append(number)
                    covered.append(words)
                    all_tiles.append([{"doc_at": d, "item_at": i, "words": w} for d, i, w in found])
            if kept:
                rows = batch.take(pa.array(kept))
                kind = pa.list_(pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("words", pa.int32())]))
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("item"), rows.column("item_words"), pa.array(covered, pa.int32()), pa.array(all_tiles, kind)], names=["id", "item", "item_words", "covered_words", "tiles"])

    kind = lambda df, name: df.schema[name].dataType.simpleString()
    tiled = map_arrow(pairs, run, f"id {kind(docs, doc_id)}, item {kind(benchmark, item_id)}, item_words int, covered_words int, tiles array<struct<doc_at:int,item_at:int,words:int>>").distinct()
    item_name = item_id if item_id != doc_id else f"item_{item_id}"
    return tiled.select(
        F.col("id").alias(doc_id), F.col("item").alias(item_name), "item_words", "covered_words",
        (F.col("covered_words") / F.col("item_words")).alias("coverage"), F.size("tiles").alias("n_tiles"), "tiles",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs`, all columns, whose id has no match; rows with a null id stay."""
    hits = cut(contaminated(docs, benchmark, doc_id, **how).select(doc_id).distinct())
    return docs.join(small(hits, 1_000_000), doc_id, "left_anti").select(docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the benchmark items that they hold."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")
