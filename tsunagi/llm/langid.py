"""Language identification by Bayesian evidence fusion.

Four sources speak for a language: the text (a naive Bayes model of byte trigrams), the language that the markup or
the metadata declares, the suffix of the address, and the host that the text comes from. What a declaration or a
suffix is worth, and what a host usually writes, is counted over the whole corpus by grouped aggregation. The prior of
a host leans on that of its domain, and that one on the whole corpus, the more so the fewer texts it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, small, table

#: The text model is fitted on about so many rows of each declared language, those with the least hashes of id and text
#: (and repeated rows of these); on at least one.
FIT_ROWS = 1_000
#: Buckets of byte trigrams.
BUCKETS = 1 << 13
#: Declared languages that are modelled at most, those of most rows. Other declarations keep their documents.
MOST_LANGUAGES = 200
#: Trigrams that a text counts for at most, as neighbouring trigrams say much the same.
EVIDENCE = 60.0
#: Texts that a host's prior leans on its domain with, and a domain's on the corpus.
LEAN = 20.0
#: Probability below which no language is chosen.
CERTAIN = 0.5
UNKNOWN = "und"
#: Hosts, declarations or suffixes that are broadcast at most.
BROADCAST_ROWS = 200_000


def language_tag(column: Column) -> Column:
    """The language of a declaration such as "en", "EN" or "en-US"; NULL if it is blank."""
    return F.nullif(F.lower(F.regexp_extract(column.cast("string"), r"^\s*([^\s_-]+)", 1)), F.lit(""))


def trigram_buckets(text: str) -> np.ndarray:
    """How often each bucket of byte trigrams occurs, over runs of letters in lower case."""
    words = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) if not text.isascii() else None
    if words is None:
        words = " ".join(text.lower().translate(_ASCII_LETTERS).split())
    raw = np.frombuffer(f" {words} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32) if words else np.empty(0, np.uint32)
    if len(raw) < 3:
        return np.zeros(BUCKETS, np.int64)
    mixed = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA6B) + raw[2:] * np.uint32(0xC2B2AE35)
    return np.bincount((mixed >> np.uint32(19)).astype(np.int64), minlength=BUCKETS)


_ASCII_LETTERS = {i: " " for i in range(128) if not chr(i).isalpha()}


class TextModel:
    """log P(bucket | language): `table` has a row for each bucket and a column for each of `languages`."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table


def fit(docs: DataFrame, id_col: str, text_col: str, declared_col: str, rows: int = FIT_ROWS) -> TextModel:
    """Fits on about `rows` rows of each declared language; the counts, not the texts, come to the driver."""
    labelled = docs.filter(language_tag(F.col(declared_col)).isNotNull() & (F.length(F.trim(F.coalesce(F.col(text_col), F.lit("")))) > 0))
    # all rows that declare a language are counted; the share of the hashes that goes in follows from that
    place = F.xxhash64(id_col, text_col)
    labelled = labelled.select(language_tag(F.col(declared_col)).alias("language"), F.col(text_col).alias("body"), place.alias("place"))
    found = labelled.groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("least"))
    last = {r["language"]: max(r["least"], min((1 << 63) - 1, (rows << 64) // r["n"] - (1 << 63))) for r in found.orderBy(F.desc("n"), "language").limit(MOST_LANGUAGES).collect()}
    limits = F.create_map(*[F.lit(x) for pair in last.items() for x in pair]) if last else F.lit(None).cast("map<string,bigint>")
    picked = labelled.filter(F.col("place") <= limits[F.col("language")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, text in zip(batch.column("language").to_pylist(), batch.column("body").to_pylist(), strict=True):
                sums[language] = sums.get(language, 0) + trigram_buckets(text)
        for language, counts in sums.items():
            yield pa.RecordBatch.from_pydict({"language": [language] * BUCKETS, "bucket": np.arange(BUCKETS, dtype=np.int32), "n": counts}).cast(pa.schema([("language", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]))

    shares = cut(picked.select("language", "body"))
    languages = sorted(last)
    table = np.full((BUCKETS, max(1, len(languages))), 0.5)
    counted = map_arrow(shares, run, "language string, bucket int, n long") if languages else None
    if counted is not None:
        for language, bucket, n in counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")).filter("n > 0").collect():  # languages x buckets
            table[bucket, languages.index(language)] += n
    return TextModel(languages, np.log(table / table.sum(axis=0)))


def text_evidence(docs: DataFrame, model: TextModel, text_col: str, columns: dict[str, Column]) -> DataFrame:
    """`columns`, n_grams and `evidence`, the log likelihoods of the text by language."""
    sent = docs.sparkSession.sparkContext.broadcast(model.table)
    source = docs.select(*[c.alias(k) for k, c in columns.items()], F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = sent.value
        for batch in batches:
            counts, scores = [], []
            for text in batch.column("body").to_pylist():
                buckets = trigram_buckets(text)
                n = int(buckets.sum())
                used = np.flatnonzero(buckets)
                counts.append(n)
                scores.append((buckets[used] @ log_p[used] * min(1.0, EVIDENCE / n) if n else np.zeros(log_p.shape[1])).tolist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(counts, pa.int64()), pa.array(scores, pa.list_(pa.float64()))], names=[*names, "n_grams", "evidence"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.drop("body").schema)
    return map_arrow(source, run, f"{kinds}, n_grams long, evidence array<double>")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", url_col: str | None = None, model: TextModel | None = None) -> DataFrame:
    """One row per row of `docs`: the id, language, probability, kept, text_language (what the text alone says),
    declared and host.

    With `url_col` the host is that of the address, its domain the last two labels, and the suffix the first language
    code of the path or else the top domain. A row is rejected (not kept, language "und") if it has no letters, or no
    language of a probability of CERTAIN; a text whose declaration isn't modelled is then kept as what it declares. A null or empty text has no letters; a null declaration, host or address
    says nothing; a declaration counts by its language alone, whatever its case and region. Repeated rows are judged each for itself; an empty table gives an empty result; extra columns are
    ignored.
    """
    model = model or fit(docs, id_col, text_col, declared_col)
    languages = model.languages
    nothing = F.lit(None).cast("string")
    address = F.lower(F.col(url_col)) if url_col else nothing
    host = F.nullif(F.regexp_extract(address, r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1), F.lit("")) if url_col else (F.col(host_col).cast("string") if host_col else nothing)
    suffix = F.coalesce(F.nullif(F.regexp_extract(address, r"^[^?#]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)", 1), F.lit("")), F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit(""))) if url_col else nothing
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1) if url_col else host
    rows = text_evidence(docs, model, text_col, {"id": F.col(id_col), "declared": language_tag(F.col(declared_col)) if declared_col else nothing, "host": host, "domain": domain, "suffix": suffix})
    ordered = F.array(*[F.lit(x) for x in languages]) if languages else F.array(nothing)
    best = lambda scores: F.when(F.col("n_grams") > 0, F.get(ordered, (F.array_position(scores, F.array_max(scores)) - 1).cast("int")))
    rows = cut(rows.withColumn("text_language", best(F.col("evidence"))))

    counts = [F.count_if(F.col("text_language") == x).alias(f"n{i}") for i, x in enumerate(languages)] or [F.count(F.lit(1)).alias("rows")]
    names = [f"n{i}" for i in range(len(languages))]
    totals = rows.agg(*counts).first() if languages else []
    prior = [(totals[i] + 1) / (sum(totals) + len(languages)) for i in range(len(languages))]
    vector = lambda parts: F.array(*parts) if parts else F.array(F.lit(0.0))

    def said(column: str) -> DataFrame:
        """For each value of a column the log of how likely texts of each language have it."""
        values = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(*counts)
        return small(cut(values.select(column, vector([F.log((F.col(n) + 0.5) / F.lit(totals[i] + 1.0)) for i, n in enumerate(names)]).alias(f"{column}_says"))), BROADCAST_ROWS)

    hosts = rows.filter("host is not null").groupBy("host", "domain").agg(*counts)
    domains = hosts.groupBy("domain").agg(*[F.sum(n).alias(f"d{n}") for n in names]) if names else None
    if names:
        total = lambda prefix: sum((F.col(f"{prefix}{n}") for n in names), F.lit(0))
        of_domain = [(F.col(f"d{n}") + LEAN * prior[i]) / (total("d") + LEAN) for i, n in enumerate(names)]
        of_host = [F.log((F.col(n) + LEAN * of_domain[i]) / (total("") + LEAN)) for i, n in enumerate(names)]
        hosts = hosts.join(domains, "domain").select("host", vector(of_host).alias("host_says"))
    else:
        hosts = hosts.select("host", vector([]).alias("host_says"))
    fused = rows.join(small(cut(hosts), BROADCAST_ROWS), "host", "left")
    evidence = [F.col("evidence"), F.coalesce("host_says", vector([F.lit(float(np.log(p))) for p in prior]))]
    for column in ("declared", "suffix"):
        fused = fused.join(said(column), column, "left")
        evidence.append(F.coalesce(f"{column}_says", vector([F.lit(0.0)] * len(languages))))
    sums = evidence[0]
    for other in evidence[1:]:
        sums = F.zip_with(sums, other, lambda a, b: a + b)
    fused = fused.withColumn("sums", sums).withColumn("highest", F.array_max("sums"))
    weight = F.aggregate(F.transform("sums", lambda x: F.exp(x - F.col("highest"))), F.lit(0.0), lambda a, b: a + b)
    fused = fused.withColumn("probability", F.when(F.col("n_grams") > 0, 1 / weight).otherwise(F.lit(0.0)))
    certain = (F.col("n_grams") > 0) & (F.col("probability") >= CERTAIN) & F.lit(bool(languages))
    other = F.coalesce(~F.col("declared").isin(languages), F.lit(False))
    kept = certain | ((F.col("n_grams") > 0) & other)
    language = F.when(certain, best(F.col("sums"))).when(kept, F.col("declared")).otherwise(F.lit(UNKNOWN))
    return fused.select(F.col("id").alias(id_col), language.alias("language"), "probability", kept.alias("kept"), "text_language", "declared", "host")


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs`, all columns, but for rejected ones; rows with a null id stay."""
    rejected = cut(identify(docs, id_col, **how).filter("not kept").select(id_col).distinct())
    return docs.join(small(rejected, 1_000_000), id_col, "left_anti").select(docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).withColumn("probability", F.round("probability", 6))
