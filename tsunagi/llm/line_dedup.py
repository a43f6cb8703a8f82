"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its words. Words are ordered by rarity, and two sets of similarity t or more must share a word
among their first few (the prefix). So the prefixes are joined word by word; lengths, positions and bits that bound the
difference of two sets rule nearly all other pairs out, and the sets of the rest are compared in full. A line goes if any earlier line is that similar.

* Rarity is counted in a fixed number of buckets of word hashes, and a byte for each bucket goes to the executors. Any
  order that is the same for all lines gives exact results, so the table keeps one size, whatever the vocabulary. A
  word's rank begins with its rarity, so a rank alone tells how common the word is.
* Lines with equal sets are one class from the start, so a line that a third of all documents share is one row.
* Among the classes that share a common word, each is first compared with the earliest class of a part of them; in a
  group of thousands of variants of one line this finds the earlier line for nearly all. Only what is left then looks
  for its earlier lines in the whole index. This decides on the way alone and not on the result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small, staged, table

#: Least Jaccard similarity of the words of two lines.
SIMILARITY = 0.8
#: Buckets of the rarity table.
BUCKETS = 1 << 19
#: A word is common if its bucket has more than COMMON words of lines; PARTS is the number of parts of its classes.
COMMON, PARTS = 256, 8
#: Parts in which the index is joined with itself, so that only one is on the disks at a time.
SLICES = 3
#: Buckets of lines whose words are looked at again.
LINES = 1 << 20
#: Rows of a broadcast at most.
BROADCAST = 1_000_000
#: Parity bits of all words, and of lines of at least WIDE words those of a half of the words too.
BITS, WIDE = ("bits", "half"), 80
#: Characters besides the space that part words.
SPACES = "\t\r\f\v"


def _bucket(mark: Column) -> Column:
    return mark.bitwiseAND(BUCKETS - 1).cast("int")


def _code(n: Column) -> Column:
    """The logarithm of a number as a byte."""
    return F.least(F.lit(127), F.round(4 * F.log2(n + 1))).cast("tinyint")


def _rarity(lines: DataFrame) -> Callable[[Column], Column]:
    """How common a word is, by its hash. The table of all buckets, a byte each, goes along in the plan."""
    words = lines.select(F.explode(_words(F.col("body"))).alias("word")).select(_bucket(F.xxhash64("word")).alias("bucket"))
    counts = words.groupBy("bucket").agg(_code(F.count(F.lit(1))).alias("code"))
    every = lines.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    listed = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    parts = every.withColumn("code", F.coalesce("code", F.lit(0).cast("tinyint"))).groupBy(F.shiftright("bucket", 10).alias("part")).agg(listed("bucket", "code").alias("codes"))
    codes = parts.agg(F.flatten(listed("part", "codes")).alias("rarity")).first()["rarity"]  # one row of BUCKETS bytes
    table = F.split(F.lit(",".join(map(str, codes))), ",").cast("array<bigint>")  # folded to a constant
    return lambda mark: F.get(table, _bucket(mark))


def _least_overlap(n: Column, t: float) -> Column:
    return F.ceil(n * t - 1e-9)


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line (its number) and body, for every line of every document."""
    body = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    return docs.select(F.col(id_col).alias("id"), F.posexplode(body).alias("line", "body"))


def _words(body: Column) -> Column:
    text = F.lower(body)
    for space in SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def _parity(ranks: Column, odd: bool = False) -> Column:
    """A bit for each of 64 classes of words, whether the set has an odd number of them; with `odd` for the words with an
    odd seventh bit alone. Two sets that differ in d words differ in at most d bits, over both kinds as well."""
    bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("bigint"), m.bitwiseAND(63).cast("int"))
    merge = lambda bits, m: bits.bitwiseXOR(F.when(m.bitwiseAND(64) != 0, bit(m)).otherwise(F.lit(0).cast("bigint")) if odd else bit(m))
    return F.aggregate(ranks, F.lit(0).cast("bigint"), merge)


def similar_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id and line of every line that an earlier line is similar to; see dedup_lines for what that means."""
    t = similarity
    lines = split_lines(docs, id_col, text_col).filter("id is not null")
    rarity = _rarity(lines)
    # a word's rank is its rarity and its hash in one number; ordered by rank, a line's words begin with the rarest
    rank = lambda h: F.shiftleft(rarity(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))
    marks = F.array_distinct(F.transform(_words(F.col("body")), lambda w: F.xxhash64(w)))
    worded = lines.filter(F.trim("body", F.lit(" " + SPACES)) != "")  # a condition on the ranks would make them twice
    ranked = worded.select("id", "line", F.inline(F.array(F.struct(F.sort_array(F.transform(marks, rank)).alias("ranks")))))
    n = F.size("ranks")
    sets = staged(
        ranked.select(
            "id", "line", n.alias("words"), F.xxhash64("ranks").alias("key"), F.xxhash64("ranks", F.lit(1)).alias("key2"),
            # sets of fewer than four words match equal sets alone
            F.when(n < 4, F.array().cast("array<bigint>")).otherwise(F.slice("ranks", F.lit(1), (n - _least_overlap(n, t) + 1).cast("int"))).alias("prefix"),
            _parity(F.col("ranks")).alias("bits"), F.when(n >= WIDE, _parity(F.col("ranks"), True)).otherwise(0).alias("half"),
        )
    )
    first = F.min(F.struct("id", "line", "words", *BITS, "prefix"))
    classes = staged(sets.groupBy("key", "key2").agg(first.alias("f")).select("key", "key2", "f.*"))

    # a word that no other line has joins nothing
    index = classes.select("id", "line", "words", *BITS, F.posexplode("prefix").alias("at", "mark")).filter(F.shiftright("mark", 56) > _code(F.lit(1)))

    def bits_between(a: str, b: str) -> Column:
        """How many words two sets differ in at least; sets of which both are wide tell it by both halves."""
        every, half = (F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")) for w in BITS)
        return F.when((F.col(f"{a}.words") >= WIDE) & (F.col(f"{b}.words") >= WIDE), F.bit_count(half) + F.bit_count(every.bitwiseXOR(half))).otherwise(F.bit_count(every))

    def may_match(a: str, b: str) -> Column:
        """Whether the lengths, the words before and after the shared one, and the parities allow the similarity, and a
        is earlier. The smaller set has a shared word already among so many as must be common to sets of its size."""
        c = lambda side, name: F.col(f"{side}.{name}")
        needed = F.ceil((c(a, "words") + c(b, "words")) * (t / (1 + t)) - 1e-9)
        possible = F.least(c(a, "at"), c(b, "at")) + F.least(c(a, "words") - c(a, "at"), c(b, "words") - c(b, "at"))
        small_at, small_n = (F.when(c(a, "words") <= c(b, "words"), c(a, x)).otherwise(c(b, x)) for x in ("at", "words"))
        differ = (c(a, "words") + c(b, "words")) * ((1 - t) / (1 + t)) + 1e-9
        near = bits_between(a, b) <= differ
        earlier = (c(a, "id") < c(b, "id")) | ((c(a, "id") == c(b, "id")) & (c(a, "line") < c(b, "line")))
        sizes = (c(a, "words") >= c(b, "words") * t - 1e-9) & (c(b, "words") >= c(a, "words") * t - 1e-9)
        return earlier & sizes & (small_at <= small_n - _least_overlap(small_n, 2 * t / (1 + t))) & (possible >= needed) & near

    pair = [F.col("a.id").alias("a_id"), F.col("a.line").alias("a_line"), F.col("b.id").alias("b_id"), F.col("b.line").alias("b_line")]

    # common words first: each class against the earliest of its part
    part = Window.partitionBy("mark", F.pmod(F.xxhash64("id", "line"), F.lit(PARTS))).orderBy("id", "line")
    common = index.filter(F.shiftright("mark", 56) >= _code(F.lit(COMMON)))
    with_first = common.select(F.struct(*common.columns).alias("b"), F.first(F.struct("id", "line", "words", *BITS, "at")).over(part).alias("a"))
    tried = cut(with_first.filter(may_match("a", "b")).select(*pair).distinct())
    found = cut(_verified(tried, lines, t).select("b_id", "b_line").distinct())
    # then all words, for classes that are left. Of a class's candidates the one with the nearest bits is compared
    # first, so that the join need not hand on every pair
    meet = lambda x, y: x.alias("b").join(y.alias("a"), (F.col("a.mark") == F.col("b.mark")) & may_match("a", "b"))
    nearest = lambda df: df.groupBy("b_id", "b_line").agg(F.min("a").alias("a"))
    without = lambda df, gone: df.join(small(gone.select(F.col("b_id").alias("id"), F.col("b_line").alias("line")), BROADCAST), ["id", "line"], "left_anti")
    parts = []
    for i in range(SLICES):
        of = index.filter(F.pmod("mark", F.lit(SLICES)) == i)
        candidates = meet(without(of, found), of).select(*pair[2:], F.struct(bits_between("a", "b").alias("near"), *pair[:2]).alias("a"))
        parts.append(cut(nearest(candidates)))
    closest = cut(nearest(reduce(DataFrame.unionByName, parts)).select("a.a_id", "a.a_line", "b_id", "b_line"))
    found = cut(found.unionByName(_verified(closest, lines, t).select("b_id", "b_line")).distinct())
    # and for classes that their nearest candidate is not similar to, all other candidates
    left = closest.select("b_id", "b_line").join(found, ["b_id", "b_line"], "left_anti")
    again = cut(index.join(small(cut(left.select(F.col("b_id").alias("id"), F.col("b_line").alias("line"))), BROADCAST), ["id", "line"], "left_semi"))
    there = small(cut(again.select("mark").distinct()), BROADCAST)
    rest = meet(again, index.join(there, "mark", "left_semi")).select(*pair).distinct()
    rest = cut(rest.join(closest, ["a_id", "a_line", "b_id", "b_line"], "left_anti"))
    later = found.unionByName(_verified(rest, lines, t).select("b_id", "b_line")).distinct()
    later = later.select(F.col("b_id").alias("id"), F.col("b_line").alias("line"), F.lit(True).alias("later"))

    verdicts = classes.select("key", "key2", "id", "line").join(later, ["id", "line"], "left").select("key", "key2", F.col("id").alias("first_id"), F.col("line").alias("first_line"), "later")
    return (
        sets.select("key", "key2", "id", "line").join(verdicts, ["key", "key2"])
        .filter(F.col("later") | (F.col("id") != F.col("first_id")) | (F.col("line") != F.col("first_line")))
        .select("id", "line")
    )


def _verified(pairs: DataFrame, lines: DataFrame, t: float) -> DataFrame:
    """The pairs whose sets of words have the similarity t or more.

    Which lines are looked at again is first told by buckets of their places, a broadcast of at most LINES numbers, so
    that of the other lines hardly any text is shuffled."""
    bucket = lambda id_, line: F.pmod(F.xxhash64(id_, line), F.lit(LINES)).cast("int").alias("bucket")
    wanted = pairs.select(bucket("a_id", "a_line")).union(pairs.select(bucket("b_id", "b_line"))).distinct()
    near = lines.withColumn("bucket", bucket("id", "line")).join(F.broadcast(wanted), "bucket", "left_semi").select("id", "line", "body")
    side = lambda s: near.select(F.col("id").alias(f"{s}_id"), F.col("line").alias(f"{s}_line"), F.col("body").alias(f"{s}_body"))
    both = pairs.join(side("a"), ["a_id", "a_line"]).join(side("b"), ["b_id", "b_line"])
    sets = both.select("a_id", "a_line", "b_id", "b_line", F.array_distinct(_words(F.col("a_body"))).alias("x"), F.array_distinct(_words(F.col("b_body"))).alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return sets.filter(common >= (F.size("x") + F.size("y") - common) * t - 1e-9).select("a_id", "a_line", "b_id", "b_line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of `docs`: all its columns, with `text_col` left with the lines that stay, and n_lines and
    n_removed; columns of these two names, in whatever case, are replaced.

    Lines are what stands between newlines. The words of a line are what stands between white space, in lower case, and
    a line is judged on the set of its words. It goes if an earlier line, by id and number, of the same document or
    another, has a Jaccard similarity of `similarity` or more to it; whether that one stays plays no part. Lines
    without a word stay. A null text counts as empty, and so becomes an empty text. Documents with a null id stay as
    they are and are no one's earlier lines. Rows that repeat an id count as one document: a line of one goes only for
    a line with a smaller id or number. A text of very many or very long lines is read as any other. An empty table
    gives an empty result.
    """
    gone = similar_lines(docs, id_col, text_col, similarity).groupBy("id").agg(F.collect_set("line").alias("lines"))
    columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    own = docs.select(F.col(id_col).alias("id"), F.struct(*columns).alias("doc"))
    both = own.join(gone, "id", "left").select("doc", "lines", F.coalesce(F.col(f"doc.{text_col}"), F.lit("")).alias("whole"))
    lines = F.split("whole", "\n", -1)
    # the numbers that stay, in order; a difference of sets of numbers is one pass over both
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "lines")
    text = F.when(F.col("lines").isNull(), F.col("whole")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    return both.select(
        *[text.alias(c) if c == text_col else F.col(f"doc.{c}").alias(c) for c in columns],
        F.size(lines).cast("long").alias("n_lines"), F.when(F.col("lines").isNull(), 0).otherwise(F.size(lines) - F.size(stay)).cast("long").alias("n_removed"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line FROM documents),
sets AS (SELECT doc_id, line, list_sort(list_distinct(list_filter(string_split(translate(lower(body), chr(9) || chr(13) || chr(12) || chr(11), '    '), ' '), lambda w: w <> ''))) AS s FROM lines),
classes AS (SELECT s, min((doc_id, line)) AS f, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
pairs AS (SELECT DISTINCT b.f FROM classes a JOIN classes b ON a.f < b.f AND a.n >= b.n * 0.8 - 1e-9 AND b.n >= a.n * 0.8 - 1e-9
    AND len(list_intersect(a.s, b.s)) >= 0.8 / 1.8 * (a.n + b.n) - 1e-9),
gone AS (SELECT doc_id, line FROM sets JOIN classes USING (s) WHERE (doc_id, line) <> f OR f IN (SELECT f FROM pairs))
SELECT doc_id, count(*) AS n_lines, count(g.line) AS n_removed, sha256(coalesce(string_agg(CASE WHEN g.line IS NULL THEN body END, chr(10) ORDER BY l.line), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g USING (doc_id, line) GROUP BY doc_id
"""
