"""From raw documents to token ids, in five stages, each of which works on all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsunagi.llm import bpe, decontaminate, langid, line_dedup, near_dedup
from tsunagi.llm.common import staged, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language was found, all columns. Rows whose text is null, empty or without letters go, as no
    language is found in it, and all rows of one id go together; rows with a null id stay. Columns that the method has not
    asked for stay, whatever their names; an empty table gives an empty one."""
    return langid.drop_unidentified(docs)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line is similar to; a document may be left empty. `n_chars` is that of
    what is left, other columns stay, whatever their names. A null text becomes an empty one; rows with a null id stay as
    they are; repeated rows of one id count as one document. Lines of very long texts are read as any others."""
    done = line_dedup.dedup_lines(docs)
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates, all columns. Documents without words are alike if
    their texts are equal; rows with a null id stay, and repeated rows of an id that stays all stay."""
    return near_dedup.drop_near_duplicates(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, all columns; without items all stay, and so do rows with a null id. An empty or
    null text holds nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of the decoded bytes; a null or empty text has no
    ids. One row a row, repeated ones and those with a null id too."""
    coded = bpe.coded(docs, ("doc_id", "lang", "source"))
    return bpe.digests(coded, "doc_id", "lang", "source", "ids")


STAGES = [("language", identified), ("lines", lines_once), ("near_duplicates", one_of_each), ("benchmark", clean), ("tokens", tokens)]

#: The aligned near-duplicate candidates and the merges of BPE are beyond SQL; a brute-force version stands in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = staged(docs)
    return docs
