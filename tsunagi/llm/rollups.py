"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are never counted anew. A batch brings signed rows: +1 document and
+n tokens for an insert, -1 and -n for a delete, and both for a revised count (a new text or another tokenizer). As
totals are additive, a batch's rows are summed before they are shuffled and written, and the totals are the sums over
committed batches.

A batch is committed under an id: its sums are written first, then its entry in the ledger. A batch that is in the
ledger is not applied again, and the sums of one that failed before its entry are overwritten when it is retried.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsunagi.sources.staging import new_folder

from .common import WORD, table

KEYS = ("source", "lang", "tokenizer")

#: Tokenizer versions that DataFrame functions can count: white-space words; and runs of letters, of digits and single marks.
TOKENIZERS = {"words-1": WORD, "marks-2": r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"}


def counted(docs: DataFrame, tokenizer: str | Column, sign: int = 1, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Signed rows for `docs`: source, lang, tokenizer, docs (+1 or -1) and tokens. `tokenizer` is a version, or a
    column of versions. A null text has no tokens; null sources and languages are groups of their own. Repeated rows count
    each for itself, an empty table gives no rows, other columns are ignored whatever their names. An unknown version is
    an error: here if it is a text, in the task that meets it if it is a column."""
    if isinstance(tokenizer, str) and tokenizer not in TOKENIZERS:
        raise ValueError(f"not a tokenizer version: {tokenizer!r}")
    version = F.lit(tokenizer) if isinstance(tokenizer, str) else tokenizer
    text = F.coalesce(F.col(text_col), F.lit(""))
    tokens = F.raise_error(F.concat(F.lit("not a tokenizer version: "), F.coalesce(version, F.lit("null")))).cast("int")
    for name, pattern in TOKENIZERS.items():
        tokens = F.when(version == name, F.regexp_count(text, F.lit(pattern))).otherwise(tokens)
    rows = docs.select(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), version.alias("tokenizer"), F.lit(sign).cast("long").alias("docs"), (tokens * sign).cast("long").alias("tokens"))
    return rows


def revised(docs: DataFrame, old: str | Column, new: str, **columns) -> DataFrame:
    """Signed rows that take the count by version `old` back and add that by `new`."""
    return counted(docs, old, -1, **columns).unionByName(counted(docs, new, 1, **columns))


class Rollup:
    """The totals kept in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def committed(self) -> list[str]:
        try:
            return sorted(r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/ledger/*").distinct().collect())
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies signed rows under the id `batch` (letters, digits, - and _); False if that was done before."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self.committed():
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        sums.write.mode("overwrite").parquet(f"{self.folder}/sums/{batch}")
        entry = self.spark.range(1).select(F.lit(batch).alias("batch"))
        entry.write.mode("overwrite").parquet(f"{self.folder}/ledger/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs and n_tokens of what is there, over all committed batches."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        batches = self.committed()
        sums = self.spark.read.schema(schema).parquet(*[f"{self.folder}/sums/{b}" for b in batches]) if batches else self.spark.createDataFrame([], schema)
        totals = sums.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return totals.filter("n_docs <> 0 or n_tokens <> 0")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents by both versions, come to by way of revisions and deletions: all documents are counted by
    the first version; every fifth is counted anew by the second; every eleventh is deleted, by the version it was last
    counted with; these are put back, the fifth are revised back, and all are counted by the second version too. Two
    batches come twice."""
    docs = table(spark, sf_dir, "documents")
    fifth, eleventh = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)), F.coalesce(F.col("doc_id") % 11 == 3, F.lit(False))
    batches = [
        ("load", counted(docs, "words-1")),
        ("revise", revised(docs.filter(fifth), "words-1", "marks-2")),
        ("delete", counted(docs.filter(eleventh), F.when(fifth, "marks-2").otherwise("words-1"), -1)),
        ("restore", counted(docs.filter(eleventh), "words-1").unionByName(revised(docs.filter(fifth & ~eleventh), "marks-2", "words-1"))),
        ("second", counted(docs, "marks-2")),
    ]
    rollup = Rollup(spark, new_folder(spark))
    for name, changes in [*batches, batches[1], batches[2]]:
        rollup.commit(name, changes)
    return rollup.totals()


SQL = r"""
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM (
    SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents
    UNION ALL SELECT source, lang, 'marks-2', len(regexp_extract_all(coalesce(text, ''), '\p{L}+|\p{N}+|[^\s\p{L}\p{N}]')) FROM documents) GROUP BY ALL
"""
