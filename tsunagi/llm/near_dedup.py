"""Near-duplicate documents by Order MinHash.

For each of B hash functions a sketch takes the L k-mers (k words in a row, labelled by their occurrence number) with
the least hashes, and puts their hashes together in text order. Documents agree in an element of the sketch only if
they share the same least k-mers in the same order, so edits that move text count, unlike for MinHash of sets.
Documents that agree in an element are candidates; a banded alignment of their words decides.

Equal word sequences are one node from the start. Nodes with the same element are a bucket. In two rounds a bucket has
one node as its centre, first the shortest one, then one at random, and every node is aligned with the centre that it
shares most buckets with. So a bucket of thousands of copies costs thousands of alignments, and what a passage that
many documents share has in common with them is found from its shortest holder. Nodes of a bucket that are still in
different classes are then aligned pair by pair. Before each alignment, lengths and parity bits of the words rule out
pairs that can't be similar: words that only one of two texts has, and the difference of the lengths, bound the edit
distance from below.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, small, staged, table
from .shingles import mixed, shingles, word_hashes

#: Words of a k-mer; k-mers of an element; elements of a sketch; least similarity.
K, L, B, SIMILARITY = 5, 2, 64, 0.8
#: Longs of parity bits of a text, and of the same bits folded.
PARITY, FOLDED = 64, 4
FOLDS = tuple(f"fold{i}" for i in range(FOLDED))
#: Numbers that are hashed at a time.
AT_ONCE = 100_000
#: Width of the first band that an alignment tries; it grows by the factor until the distance fits or may not be more.
FIRST_BAND, WIDER = 24, 4


def occurrence_labelled(kmers: np.ndarray) -> np.ndarray:
    """Each k-mer's hash together with how often it has come before."""
    order = np.argsort(kmers, kind="stable")
    in_order = kmers[order]
    new = np.ones(len(kmers), bool)
    new[1:] = in_order[1:] != in_order[:-1]
    if new.all():
        return kmers
    starts = np.flatnonzero(new)
    number = np.arange(len(kmers)) - np.repeat(starts, np.diff(np.append(starts, len(kmers))))
    out = np.empty_like(kmers)
    out[order] = mixed(in_order + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return np.where(np.isin(kmers, in_order[~new]), out, kmers)


def sketch(words: np.ndarray, k: int, least: int, elements: int) -> np.ndarray:
    """The elements of a text's Order MinHash; a text of fewer than k words is one k-mer."""
    kmers = shingles(words, min(k, len(words)))
    kmers = occurrence_labelled(kmers)
    factors = mixed(np.arange(1, elements + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
    take, parts, step = min(least, len(kmers)), [], max(1, AT_ONCE // len(kmers))
    for start in range(0, elements, step):
        hashes = kmers[None, :] * factors[start : start + step, None]
        each = np.arange(len(hashes))
        where = np.empty((len(hashes), take), np.int64)
        for i in range(take):  # few, so that one minimum after the other is faster than a partition
            where[:, i] = hashes.argmin(axis=1)
            hashes[each, where[:, i]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        where.sort(axis=1)
        chosen = kmers[where]
        out = np.arange(start, start + len(chosen), dtype=np.uint64)
        for i in range(take):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i])
        parts.append(out)
    return np.concatenate(parts)


def parity_bits(words: np.ndarray) -> np.ndarray:
    """PARITY longs; bit i is set if an odd number of the text's words, of which each repeat is a word of its own, has the
    hash bucket i."""
    odd = np.bincount((mixed(occurrence_labelled(words)) >> np.uint64(16)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two word sequences, or most + 1 if it is more than `most`. A band of 2 * most + 1
    diagonals is kept as bits of integers, and a column of the alignment is a few operations on them."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    same = np.flatnonzero(a[: len(b)] != b)
    head = int(same[0]) if len(same) else len(b)
    a, b = a[head:], b[head:]
    same = np.flatnonzero(a[len(a) - len(b) :][::-1] != b[::-1])
    tail = int(same[0]) if len(same) else len(b)
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    if not b or not most:
        return min(len(a), most + 1)
    limit, most = most, min(most, len(a))
    # a is the pattern; column j of b looks at rows j - most .. j + most, and bit i stands for row j - most + i
    places: dict[int, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    width = 2 * most + 1
    full, bottom = (1 << width) - 1, 1 << (width - 1)
    plus, minus = full & ~((1 << most) - 1), 0  # rows above the first don't cost
    score = most  # at the band's lowest row, and later at the last row of a
    last = None
    for j, word in enumerate(b):
        at = places.get(word, 0)
        at = (at >> (j - most) if j >= most else at << (most - j)) & full
        diagonal = ((((at & plus) + plus) ^ plus) | at | minus) & full
        up = (minus | ~(diagonal | plus)) & full
        down = diagonal & plus
        low = j + most  # the row of a at the band's lowest bit
        if low < len(a):
            score += not diagonal & bottom
        else:
            last = 1 << (width - 1 - (low - len(a) + 1))
            score += bool(up & last) - bool(down & last)
        if score > most + most:
            return limit + 1
        shifted = diagonal >> 1
        plus = (down | ~(shifted | up)) & full
        minus = shifted & up
    return min(score, limit + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - edit distance / words of the longer text is at least `least`."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    band = FIRST_BAND  # near copies fit into a narrow band, however long they are
    while band < most:
        if banded_distance(a, b, band) <= band:
            return True
        band *= WIDER
    return banded_distance(a, b, most) <= most


def text_marks(words: np.ndarray, text: str) -> list[int]:
    """Two hashes of a word sequence; without words the text itself tells copies."""
    powers, marks = np.arange(1, len(words) + 1, dtype=np.uint64), []
    for salt in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3):
        if len(words):
            mark = mixed(words + powers * np.uint64(salt)).sum(dtype=np.uint64)
        else:
            mark = np.uint64(xxhash.xxh3_64_intdigest(text.strip().encode("utf-8", "surrogatepass"), seed=salt))
        marks.append(int(mark.view(np.int64)))
    return marks


def _sketches(docs: DataFrame, id_col: str, text_col: str, k: int, least: int, elements: int) -> DataFrame:
    """id, n_words, two hashes of the word sequence, the parity bits, and the sketch."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks, bits, sketches = [], [[], []], [], []
            for text in batch.column("body").to_pylist():
                words = word_hashes(text)
                sizes.append(len(words))
                bits.append(parity_bits(words))
                for held, mark in zip(marks, text_marks(words, text), strict=True):
                    held.append(mark)
                sketches.append(sketch(words, k, least, elements).view(np.int64) if len(words) else np.empty(0, np.int64))
            ends = pa.array(np.cumsum([0, *map(len, sketches)]).astype(np.int32))
            flat = pa.array(np.concatenate(sketches) if sketches else np.empty(0, np.int64))
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * PARITY), pa.array(np.concatenate(bits) if bits else np.empty(0, np.int64)))
            folded = np.bitwise_xor.reduce(np.array(bits, np.int64).reshape(-1, PARITY // FOLDED, FOLDED), axis=1)
            columns = [batch.column("id"), pa.array(sizes, pa.int32()), *(pa.array(x, pa.int64()) for x in marks), parity, *(pa.array(folded[:, i].copy()) for i in range(FOLDED)), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "mark", "mark2", "parity", *FOLDS, "sketch"])

    return map_arrow(source, run, f"id {docs.schema[id_col].dataType.simpleString()}, n_words int, mark long, mark2 long, parity array<long>, {', '.join(f'{c} long' for c in FOLDS)}, sketch array<long>")


def _aligned(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar; mark_a and mark_b tell which text of a repeated id is meant."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).filter("id is not null")
    both = pairs.select("a", "b", "mark_a", "mark_b").join(texts.withColumnsRenamed({"id": "a", "body": "text_a"}), "a").join(texts.withColumnsRenamed({"id": "b", "body": "text_b"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words_b, meant_b = None, None, 0
        for batch in batches:
            verdicts = []
            marks = zip(batch.column("mark_a").to_pylist(), batch.column("mark_b").to_pylist(), strict=True)
            for text_a, text_b, (mark_a, mark_b) in zip(batch.column("text_a"), batch.column("text_b"), marks, strict=True):
                if (b := text_b.as_py()) != last:
                    last, words_b = b, word_hashes(b)
                    meant_b = text_marks(words_b, b)[0]
                a = text_a.as_py()
                words_a = word_hashes(a)
                verdicts.append(meant_b == mark_b and text_marks(words_a, a)[0] == mark_a and similar(words_a, words_b, least))
            kept = batch.filter(pa.array(verdicts, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(both.select("a", "b", "mark_a", "mark_b", "text_a", "text_b"), run, f"a {kind}, b {kind}").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and label, the least id of its component, for every node of `links` (a, b).

    Each round a node takes the least label around it and then the label of that label, until a round changes nothing.
    """
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("near")).select(F.col("a").alias("id"), F.least("a", "near").alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near")).withColumnRenamed("a", "id")
        new = labels.join(near, "id").select("id", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        onward = new.select(F.col("id").alias("new"), F.col("new").alias("next"))
        new = cut(new.join(onward, "new").select("id", F.least("new", "next").alias("label"), "old"))
        labels = new.select("id", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels


def _can_be_similar(similarity: float):
    """Whether neither lengths nor parity bits rule out the similarity of a and b. Each word that one text has more often
    changes a bit at most; an edit makes two such words if it changes one, or one if it changes the length."""
    longer, shorter = F.greatest("n_words_a", "n_words_b"), F.least("n_words_a", "n_words_b")
    most = F.floor(longer * (1 - similarity) + 1e-9)
    # the few folded bits rule most pairs out at once; a loop over all bits, which no compiled method must hold, the rest
    few = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in FOLDS), F.lit(0))
    all_bits = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return (longer - shorter <= most) & (few + longer - shorter <= 2 * most) & (all_bits + longer - shorter <= 2 * most)


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c == "bucket" else side if c == "node" else f"{c}_{side}") for c in df.columns])


def _labelled(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """The buckets (bucket, node, place) whose nodes are in more than one class, with the nodes' labels."""
    named = staged(buckets.join(labels.withColumnRenamed("id", "node"), "node", "left").select("bucket", "node", "place", F.coalesce("label", "node").alias("label")))
    several = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    return named.join(several.select("bucket"), "bucket", "left_semi")


def _join_classes(pairs: DataFrame, links: DataFrame | None, labels: DataFrame | None, docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links and labels with those of `pairs` (a, b, mark_a, mark_b, label_a, label_b) added that are similar."""
    more = cut(_aligned(pairs, docs, id_col, text_col, similarity).join(pairs.select("a", "b", "label_a", "label_b"), ["a", "b"]))
    joined = components(more.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    if links is None or labels is None:
        return more.select("a", "b"), joined
    merged = joined.select(F.col("id").alias("label"), F.col("label").alias("merged"))
    labels = labels.join(merged, "label", "left").select("id", F.coalesce("merged", "label").alias("label"))
    labels = cut(labels.unionByName(joined.join(labels.select("id"), "id", "left_anti")))  # classes that were one node
    return links.unionByName(more.select("a", "b")), labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, least: int = L, elements: int = B, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: the id, class_id (the least id of its class), class_size and n_links, the aligned
    pairs of different texts that the document's text was found in.

    Two documents are linked if their word sequences (runs of letters and digits, lower case) are equal, or agree in
    an element of their sketches and have 1 - edit distance / longer length of at least `similarity`; classes are the
    components of the links. Texts without words are copies if they are equal but for white space at their ends; a null
    text counts as empty. A row with a null id is a class of its own. Rows that repeat an id are one document: the text
    with the least word sequence hash stands for it. Pairs at exactly the similarity are linked. An empty table gives
    an empty result, and extra columns are ignored. Texts are compared whole, however long: near copies of a million
    words need a narrow band and take seconds; for two such texts that differ in up to a fifth of their words the last
    band has 400,000 bits a step, which takes minutes in one task.
    """
    rows = staged(_sketches(docs, id_col, text_col, k, least, elements))
    own = rows.filter("id is not null").groupBy("id").agg(F.min(F.struct("mark", "mark2")).alias("m")).select("id", "m.*")
    nodes = cut(own.groupBy("mark", "mark2").agg(F.min("id").alias("node")))
    members = cut(own.join(nodes, ["mark", "mark2"]).select("id", "node"))
    of_node = rows.join(nodes.withColumnRenamed("node", "id"), ["id", "mark", "mark2"], "left_semi").dropDuplicates(["id"]).withColumnRenamed("id", "node")
    # two orders of the nodes as single numbers, which partial sums can compare: by length, and by a hash
    by_chance = F.shiftrightunsigned(F.xxhash64("node", F.lit(1)), 24)
    places = [F.shiftleft(F.least("n_words", F.lit((1 << 23) - 1)).cast("long"), 40).bitwiseOR(by_chance), F.xxhash64("node", F.lit(2))]
    of_node = staged(of_node.select("node", "mark", "n_words", "parity", *FOLDS, "sketch", *[p.alias(f"place{i}") for i, p in enumerate(places)]))
    facts = of_node.select("node", "mark", "n_words", "parity", *FOLDS)
    every = of_node.select("node", "place0", "place1", F.explode("sketch").alias("bucket")).repartition("bucket")
    shared = every.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    buckets = staged(every.join(shared, "bucket", "left_semi"))

    links, labels, tried = None, None, None
    for i in range(len(places)):
        rest = buckets.select("bucket", "node", F.col(f"place{i}").alias("place"))
        rest = rest.withColumn("label", F.col("node")) if labels is None else staged(_labelled(rest, labels))
        centre = rest.groupBy("bucket").agg(F.min("place").alias("centre"))
        near = rest.join(centre, "bucket").filter("place <> centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("label"))
        near = near.join(of_node.select(F.col(f"place{i}").alias("centre"), F.col("node").alias("b")), "centre")
        near = near.join((rest.select(F.col("node").alias("b"), F.col("label").alias("label_b")).distinct() if labels is not None else of_node.select(F.col("node").alias("b"), F.col("node").alias("label_b"))), "b").filter("label <> label_b")
        best = near.groupBy("node").agg(F.max_by(F.struct("b", "label", "label_b"), F.struct("n", "centre")).alias("x")).select(F.col("node").alias("a"), "x.b", F.col("x.label").alias("label_a"), "x.label_b")
        pairs = best.join(_side(facts, "a"), "a").join(_side(facts, "b"), "b").filter(_can_be_similar(similarity)).select("a", "b", "mark_a", "mark_b", "label_a", "label_b")
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
        pairs = cut(pairs)
        tried = pairs.select("a", "b") if tried is None else tried.unionByName(pairs.select("a", "b"))
        links, labels = _join_classes(pairs, links, labels, docs, id_col, text_col, similarity)

    # pairs of different classes that are left, each in the first element that the two share. At least one of them is
    # not in the class of the bucket's centre, so the members of a large class are not compared with each other
    brief_of = lambda x: x.bitwiseAND(0x7FFFFFFF).cast("int")
    rest = staged(_labelled(buckets.select("bucket", "node", F.col("place0").alias("place")), labels))
    main = rest.groupBy("bucket").agg(F.min("place").alias("place")).join(rest, ["bucket", "place"]).groupBy("bucket").agg(F.min("label").alias("main"))
    rest = rest.join(main, "bucket").select("bucket", "node", "place", "label", (F.col("label") == F.col("main")).alias("inside"))
    rest = rest.join(of_node.select("node", "mark", "n_words", "parity", *FOLDS, F.transform("sketch", brief_of).alias("brief")), "node")
    # a is the shorter one; lengths of similar texts are in the same class or in classes that follow each other
    size = F.floor(F.log("n_words") / (math.log(1 / similarity) * (1 + 1e-9))).cast("int")
    rest = staged(rest.withColumn("size", size))
    left = _side(rest.withColumn("size", F.explode(F.array("size", F.col("size") + 1))), "a").withColumnRenamed("size_a", "size")
    right = _side(rest, "b").withColumnRenamed("size_b", "size")
    shorter = (F.col("place_a") < F.col("place_b")) | ((F.col("place_a") == F.col("place_b")) & (F.col("a") < F.col("b")))
    earliest = F.get(F.array_intersect("brief_a", "brief_b"), F.lit(0)) == brief_of(F.col("bucket"))
    meet = lambda x, y: x.join(y, ["bucket", "size"]).filter((F.col("label_a") != F.col("label_b")) & shorter & _can_be_similar(similarity) & earliest)
    pairs = meet(left.filter("not inside_a"), right).select("a", "b", "mark_a", "mark_b", "label_a", "label_b")
    pairs = pairs.unionByName(meet(left.filter("inside_a"), right.filter("not inside_b")).select(pairs.columns))
    pairs = pairs.select("a", "b", "mark_a", "mark_b", "label_a", "label_b").distinct()
    pairs = pairs.join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    links, labels = _join_classes(cut(pairs), links, labels, docs, id_col, text_col, similarity)

    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    classes = members.join(labels.withColumnRenamed("id", "node"), "node", "left").join(degree, "node", "left").select("id", F.coalesce("label", "node").alias("class_id"), "n_links")
    classes = cut(rows.select("id").join(classes, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    sizes = cut(classes.filter("class_id is not null").groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")))
    return classes.join(sizes, "class_id", "left").select(F.col("id").alias(id_col), "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), "n_links")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs`, all columns, without those whose class has a smaller id; rows with a null id stay."""
    classes = near_duplicates(docs, id_col, **how)
    gone = cut(classes.filter(F.col(id_col) != F.col("class_id")).select(id_col).distinct())
    return docs.join(small(gone, 1_000_000), id_col, "left_anti").select(docs.columns)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))
