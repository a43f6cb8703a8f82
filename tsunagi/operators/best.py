"""The best pairs of all by bounds: talents and projects fall into classes, a pair of classes tells the most points that a
pair of theirs can have, and pairs are made class by class from the highest bound down, until none that is left can enter.

A class is what the parts of a score but the skills see: month, style, nationality, and the rate by tens; of the skills it
knows whether there are any. So the number of classes depends on what the fields can say and hardly on how many rows say it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsunagi.functions import scoring as S
from tsunagi.operators import matching as M
from tsunagi.sources.staging import staged

#: Pairs that the first round makes at least, if there are as many.
FIRST = 100_000
#: Rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Width of a rate class, in the unit of rates.
TENS = 10
_NONE = "-"


@dataclass
class Best:
    """The best pairs, and how many were made for them of how many there are."""

    pairs: DataFrame
    made: int
    total: int


def _key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(_NONE)) for p in parts])


def _when_text(text: Column) -> Column:
    """What availability reads of a text besides its month."""
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(text.contains("即日"), "即日").otherwise("?")


def _talent_class(left: DataFrame) -> DataFrame:
    rate, style = F.floor(F.col("desired_rate") / TENS).cast("int"), F.col("talent_style")
    parts = {"t_rate": rate, "t_month": F.col("available_month"), "t_text": _when_text(F.col("available_from")), "t_style": style, "t_foreign": F.coalesce("is_foreign_national", F.lit(False)), "t_none": F.col("n_own") == 0}
    return left.withColumns(parts).withColumn("t_class", _key(F.col("t_rate"), F.col("t_month"), F.col("t_text"), style["given"], style["remote"], style["onsite"], F.col("t_foreign"), F.col("t_none")))


def _project_class(right: DataFrame) -> DataFrame:
    a, b, style = F.coalesce("rate_min", "rate_max"), F.coalesce("rate_max", "rate_min"), F.col("project_style")
    tens = lambda c: F.floor(c / TENS).cast("int")
    parts = {
        "p_low": tens(F.least(a, b)), "p_high": tens(F.greatest(a, b)), "p_month": F.col("start_month"), "p_text": _when_text(F.col("start_date")), "p_style": style,
        "p_ng": F.coalesce("foreign_nationality_ng", F.lit(False)), "p_required": F.col("n_required") > 0, "p_preferred": F.col("n_preferred") > 0,
    }
    names = ("p_low", "p_high", "p_month", "p_text", "p_ng", "p_required", "p_preferred")
    return right.withColumns(parts).withColumn("p_class", _key(*[F.col(c) for c in names], style["given"], style["remote"], style["onsite"]))


def rate_bound(talent: Column, low: Column, high: Column) -> Column:
    """The most points that a rate in class `talent` can have with a range from class `low` to class `high`."""
    least_over = (talent - high - 1) * TENS + 1
    return (
        F.when(talent.isNull() | low.isNull(), 17).when((talent >= low) & (talent <= high), 30).when(talent < low, 27)
        .when(least_over <= 5, 23).when(least_over <= 10, 15).otherwise(0)
    )


def class_bounds(talents: DataFrame, projects: DataFrame) -> DataFrame:
    """t_class, p_class, bound and n (pairs) of each pair of classes. `talents` and `projects` carry their classes."""
    t_parts, p_parts = ([c for c in df.columns if c.startswith(f"{x}_") and c != f"{x}_class"] for df, x in ((talents, "t"), (projects, "p")))
    of = lambda df, key, parts, n: df.groupBy(key).agg(*[F.first(c).alias(c) for c in parts], F.count(F.lit(1)).alias(n))
    left, right = of(talents, "t_class", t_parts, "t_n"), staged(of(projects, "p_class", p_parts, "p_n"))
    both = left.crossJoin(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right)  # classes, not rows
    skill = lambda some, most: F.when(~F.col(some), most // 2).when(F.col("t_none"), 0).otherwise(most)
    points = (
        rate_bound(F.col("t_rate"), F.col("p_low"), F.col("p_high"))
        + S.availability_points(F.col("t_text"), F.col("p_text"), F.col("t_month"), F.col("p_month"))
        + S.style_points(F.col("t_style"), F.col("p_style"))
        + skill("p_required", S.REQUIRED_POINTS) + skill("p_preferred", S.PREFERRED_POINTS)
    )
    bound = F.when(F.col("t_foreign") & F.col("p_ng"), 0).otherwise(F.least(F.lit(100), points))
    return both.select("t_class", "p_class", bound.alias("bound"), (F.col("t_n") * F.col("p_n")).alias("n"))


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def best_pairs(talents: DataFrame, projects: DataFrame, limit: int, first: int = FIRST) -> Best:
    """The `limit` best pairs of all, with parts, bands and the texts of hits: by score, then by ids. The same rows as if
    all pairs were made. A first round makes the pairs of the highest bounds; the last of its best pairs tells which
    bounds can still enter (equal ones can, by their ids), and a second round makes those. What comes to the driver is
    one count for each number of points."""
    left, right = M.features(talents, projects)
    left, right = staged(_talent_class(left)), staged(_project_class(right))
    bounds = staged(class_bounds(left, right))
    counts = sorted(((r["bound"], r["n"]) for r in bounds.groupBy("bound").agg(F.sum("n").alias("n")).collect()), reverse=True)
    total = sum(n for _, n in counts)
    bits = any(x.startswith("m") and x[1:].isdigit() for x in left.columns)
    shed = lambda df: df.drop(*[c for c, kind in df.dtypes if kind == "array<string>" and bits], *[c for c in df.columns if c[:2] in ("t_", "p_") and c[2:] != "class"])
    narrow_left, narrow_right = shed(left), shed(right)

    def scored(chosen: DataFrame) -> DataFrame:
        """Scores of the pairs of some pairs of classes. Talents stay where they are unless the projects that their
        classes meet are many."""
        met = staged(chosen.select("t_class", "p_class").join(narrow_right, "p_class"))
        return M.score(narrow_left.join(_few(met), "t_class")).select(*M.PAIR, "score")

    def top(df: DataFrame) -> DataFrame:
        return df.orderBy(F.col("score").desc(), *M.PAIR).limit(limit)

    made, least = 0, 101
    for bound, n in counts:
        if made >= max(first, limit):
            break
        made, least = made + n, bound
    best = staged(top(scored(bounds.filter(F.col("bound") >= least))))
    worst = best.agg(F.min("score"), F.count(F.lit(1))).first()
    reach = worst[0] if worst[1] == limit else 0  # equal bounds can still enter, by their ids
    if any(reach <= bound < least for bound, _ in counts):
        more = scored(bounds.filter((F.col("bound") >= reach) & (F.col("bound") < least)))
        made += sum(n for bound, n in counts if reach <= bound < least)
        best = staged(top(best.unionByName(more)))
    pairs = F.broadcast(best.select(*M.PAIR))  # `limit` rows
    shown = M.score(left.join(pairs, "talent_id").join(right, "project_id"))
    return Best(M.with_hits(F.broadcast(shown), left, right), made, total)
