"""Secret scans with corpus-wide ownership frequency.

Every text is scanned for the three base kinds. The value of each finding is then counted over the whole corpus by
distinct owners and distinct repositories (a document stands for one): a value that several owners have, in enough
repositories, is a copied example; one that a single owner has and that looks random is likely a live credential, in
however many of the owner's repositories it is. Both become spans of their own kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

# The patterns of the base kinds, in the order in which the kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "live", "copied")
ASSIGN_LEAST = 6
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|1234567"
# End of fixed values.

#: A value that at least so many owners have in at least so many repositories is a copied example.
OWNERS, REPOSITORIES = 2, 3


def _scan(text: Column) -> Column:
    """For each kind that occurs: its number, the matches, their values, and the pieces of text before each match."""

    def kind(number: int, pattern: str, group: int, there: Column) -> Column:
        return F.when(
            there & text.rlike(pattern),
            F.struct(
                F.lit(number).alias("kind"),
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
                F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
                F.split(text, pattern, -1).alias("before"),
            ),
        )

    found = F.array(
        kind(0, ASSIGN, 1, F.lit(True)),
        kind(1, ACCESS, 0, text.contains("AKIA")),
        kind(2, HEX, 0, F.lit(True)),
    )
    return F.filter(found, lambda x: x.isNotNull())


def live_looking(value: Column) -> Column:
    """Long, with letters and digits, of many different characters, and without a word of a placeholder."""
    return (
        (F.length(value) >= 16)
        & value.rlike("[0-9]")
        & value.rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("."), F.lit(0)))) >= 8)
        & ~value.rlike(PLACEHOLDER)
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", owners: int = OWNERS, repositories: int = REPOSITORIES) -> tuple[DataFrame, DataFrame]:
    """(docs, spans): `docs` has one row per input row (row, id), `spans` one row per finding: row, kind, start, end
    (code points, end exclusive) and the value, with n_owners and n_repositories, which count the value's distinct
    owners and distinct (owner, document) pairs over the corpus. Kinds 3 (live) and 4 (copied) cover the value.

    A null text counts as empty and has no spans; a null owner counts as an owner of its own. Repeated rows are
    scanned each for itself. Extra columns are ignored, and an empty table gives empty results.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("\0")).alias("owner"), _scan(text).alias("found"))
    rows = rows.select("row", "id", "owner", F.explode_outer("found").alias("f"))
    # the piece after the last match has no match beside it and plays no part
    rows = rows.select("row", "id", "owner", "f.kind", F.posexplode_outer(F.arrays_zip("f.before", "f.match", "f.value")).alias("place", "x"))
    rows = cut(rows.select("row", "id", "owner", "kind", "place", F.length("x.before").alias("gap"), F.col("x.match").alias("match"), F.col("x.value").alias("value")).filter("place is null or match is not null"))

    so_far = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = (
        rows.filter("match is not null")
        .withColumn("end", F.sum(F.col("gap") + F.length("match")).over(so_far))
        .withColumn("start", F.col("end") - F.length("match"))
        .filter((F.col("kind") != 0) | (F.length("value") >= ASSIGN_LEAST))
        .withColumn("mark", F.sha2("value", 256))
        .select("row", "id", "owner", "kind", "start", "end", "value", "mark")
    )
    # distinct first, so that a value that is everywhere leaves one row per owner or repository and task
    by_owner = base.select("mark", "owner", "id").distinct().groupBy("mark", "owner").agg(F.count(F.lit(1)).alias("n"))
    wide = by_owner.groupBy("mark").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories"))
    base = base.join(wide, "mark")
    method = F.when((F.col("n_owners") >= owners) & (F.col("n_repositories") >= repositories), 4).when((F.col("n_owners") == 1) & live_looking(F.col("value")), 3)
    added = base.withColumn("kind", method).filter("kind is not null").withColumn("start", F.col("end") - F.length("value")).distinct()
    spans = base.unionByName(added).select("row", "kind", "start", "end", "value", "n_owners", "n_repositories")
    return rows.select("row", "id").distinct(), spans


def _listed(kinds: Column | None = None) -> Column:
    """The spans of a row as text, by start, then kind as listed."""
    spans = F.array_sort(F.collect_list(F.when(F.lit(True) if kinds is None else kinds, F.struct("start", "kind", "end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, spans = scan_secrets(table(spark, sf_dir, "documents"))
    per_row = spans.groupBy("row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{KINDS[k]}") for k in range(5)],
        F.sha2(_listed(F.col("kind") < 3), 256).alias("base_sha256"),
        _listed().alias("spans"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return docs.join(per_row, "row", "left").select(
        F.col("id").alias("doc_id"), zero("n_assign"), zero("n_access"), zero("n_hex"),
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        zero("n_live"), zero("n_copied"),
    )


def _sql() -> str:
    def kind(number: int, pattern: str, group: int) -> str:
        p = pattern.replace("'", "''")
        return f"""SELECT row, doc_id, owner, {number} AS kind, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS found,
            regexp_extract_all(t, '{p}', {group}) AS vals FROM docs WHERE regexp_matches(t, '{p}')"""

    names = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    listed = f"string_agg({names} || ':' || b || ':' || e, ',' ORDER BY b, kind, e)"
    least, live = f"kind <> 0 OR length(v) >= {ASSIGN_LEAST}", PLACEHOLDER.replace("'", "''")
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, chr(0)) AS owner, coalesce(text, '') AS t FROM documents),
hits AS ({kind(0, ASSIGN, 1)} UNION ALL {kind(1, ACCESS, 0)} UNION ALL {kind(2, HEX, 0)}),
each AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM hits),
base AS (SELECT * FROM (SELECT row, doc_id, owner, kind, vals[i] AS v, e - length(found[i]) AS b, e FROM (
    SELECT *, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(found[1:i], lambda x: length(x))) AS e FROM each))
    WHERE {least}),
wide AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, doc_id)) AS repositories FROM base GROUP BY v),
added AS (SELECT DISTINCT row, doc_id, kind, e - length(v) AS b, e FROM (
    SELECT row, doc_id, v, e, CASE WHEN owners >= {OWNERS} AND repositories >= {REPOSITORIES} THEN 4
        WHEN owners = 1 AND length(v) >= 16 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(regexp_extract_all(v, '.'))) >= 8
             AND NOT regexp_matches(v, '{live}') THEN 3 END AS kind
    FROM base JOIN wide USING (v)) WHERE kind IS NOT NULL),
spans AS (SELECT row, kind, b, e FROM base UNION ALL SELECT row, kind, b, e FROM added),
per_row AS (SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    count(*) FILTER (kind = 3) AS n_live, count(*) FILTER (kind = 4) AS n_copied,
    {listed} FILTER (kind < 3) AS base, {listed} AS spans FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN per_row USING (row)
"""


SQL = _sql()
