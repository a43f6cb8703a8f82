"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsunagi.sources.staging import new_folder, shared_folder

#: White space as the contracts define it; every other character belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow, on executors that may not have this package installed: it is sent to them once a session."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        path = f"{tempfile.mkdtemp(prefix='package-')}/{package.name}_package.zip"
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return df.mapInArrow(function, schema)


@contextmanager
def _no_shuffle_files_left(spark: SparkSession) -> Iterator[None]:
    """What is shuffled inside is removed when it has been written, as no one reads it again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of `df` with a reliable checkpoint, in the shared folder that the session names in
    spark.checkpoint.dir. On a cluster one must be named; in local mode a folder is made where none is."""
    shared_folder(df.sparkSession)
    with _no_shuffle_files_left(df.sparkSession):
        return df.select("*").checkpoint()  # the setting holds for queries that are made under it


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marks `df` for a broadcast if it has at most `rows` rows, which bounds what is sent to the executors;
    otherwise Spark is left to join by a shuffle. `df` should be cheap to count (cut or read from a table)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def staged(df: DataFrame) -> DataFrame:
    """Like cut, but written as Parquet, which takes less room for wide rows."""
    path = new_folder(df.sparkSession)
    with _no_shuffle_files_left(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
