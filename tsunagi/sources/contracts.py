"""Declared schemas of tables: what a table must have, what older generations of it lack, and what is an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the tables that are read from outside. Those from `ADDED` on were added later, so older files lack them.
TALENTS = "talent_id BIGINT, email_id BIGINT, display_name STRING, affiliation STRING, desired_rate INT, available_from STRING, work_style STRING, nearest_station STRING, skills ARRAY<STRING>, status STRING, created_at TIMESTAMP, is_foreign_national BOOLEAN, commerce_flow STRING, summary STRING"
PROJECTS = "project_id BIGINT, email_id BIGINT, title STRING, required_skills ARRAY<STRING>, preferred_skills ARRAY<STRING>, rate_min INT, rate_max INT, location STRING, work_style STRING, start_date STRING, status STRING, created_at TIMESTAMP, foreign_nationality_ng BOOLEAN, commerce_flow_limit STRING, summary STRING"
CONTRACTS = {"talents": TALENTS, "projects": PROJECTS}
ADDED = {"talents": ("is_foreign_national", "commerce_flow", "summary"), "projects": ("foreign_nationality_ng", "commerce_flow_limit", "summary")}
#: Types that may stand for others, as no value is lost.
WIDENS = {"bigint": ("int", "smallint", "tinyint"), "int": ("smallint", "tinyint"), "double": ("float",), "timestamp": ("timestamp_ntz",)}


def contract(name: str) -> T.StructType:
    return T.StructType.fromDDL(CONTRACTS[name])


class ContractError(ValueError):
    """A table is not what its contract says."""


def conform(df: DataFrame, name: str) -> DataFrame:
    """`df` with the columns of the contract, in its order. Columns that were added later are null where they lack; other
    missing columns, and types that would have to be guessed, are an error. Columns that the contract does not know go."""
    fields, there, wrong = contract(name), dict(df.dtypes), []
    for field in fields:
        want = field.dataType.simpleString()
        if field.name not in there:
            if field.name not in ADDED[name]:
                wrong.append(f"{field.name} is missing")
        elif there[field.name] != want and there[field.name] not in WIDENS.get(want, ()):
            wrong.append(f"{field.name} is {there[field.name]}, not {want}")
    if wrong:
        raise ContractError(f"{name}: {'; '.join(wrong)}")
    known = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields if f.name in there])
    return df.sparkSession.createDataFrame([], fields).unionByName(known, allowMissingColumns=True)


def load(spark: SparkSession, name: str, *paths: str) -> DataFrame:
    """A table from folders of Parquet files, each of one generation. The files' own schemas are read, so a wrong type is
    told before any row is; each generation keeps its pushed filters and read columns."""
    found = None
    for path in paths:
        part = conform(spark.read.parquet(path), name)
        found = part if found is None else found.unionByName(part)
    return found


def load_jdbc(spark: SparkSession, name: str, url: str, table: str, key: str, partitions: int, **options: str) -> DataFrame:
    """A table from a database, read in `partitions` ranges of `key`, whose bounds one query tells; lists come as JSON text."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    low, high = reader.option("query", f"SELECT min({key}) AS low, max({key}) AS high FROM {table}").load().first()
    rows = reader.option("dbtable", table)
    if low is not None:
        rows = rows.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions))
    df = rows.load()
    lists = [f.name for f in contract(name) if isinstance(f.dataType, T.ArrayType) and dict(df.dtypes).get(f.name) == "string"]
    return conform(df.withColumns({c: F.from_json(c, "array<string>") for c in lists}) if lists else df, name)
