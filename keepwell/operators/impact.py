"""What-if impact of lower churn per segment and per level of a significant column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions.scalar import col, half_even, no_nan, ratio
from keepwell.operators.clean import tall

# Relative cuts, smallest group, smallest lift, longest list.
SCENARIOS = (("reduce_10pct", 0.10), ("reduce_25pct", 0.25))
MIN_GROUP = 30
MIN_LIFT = 1.1
OTHER = "Other"


def _sums(y: str, revenue: str | None) -> list[Column]:
    money = (F.coalesce(no_nan(col(revenue).cast("double")), F.lit(0.0)) if revenue
             else F.lit(None).cast("double"))
    return [F.count("*").alias("customers"), F.sum(col(y)).alias("churners"),
            F.sum(F.when(col(y) == 1, money)).alias("_risk")]


def _finish(groups: DataFrame, df: DataFrame, y: str, has_revenue: bool) -> DataFrame:
    total = F.broadcast(df.agg(F.count("*").alias("_n"), F.avg(col(y)).alias("_rate")))
    j = groups.crossJoin(total)
    rate = F.col("churners") / F.col("customers")
    risk = F.coalesce("_risk", F.lit(0.0)) if has_revenue else F.col("_risk")
    j = j.withColumn("_risk", risk)
    scenarios = F.array(*[F.struct(
        F.lit(k).alias("scenario"), half_even(F.col("churners") * share, 1).alias("churners_saved"),
        half_even(F.round(F.col("_risk") * share, 6), 2).alias("revenue_saved"))
        for k, share in SCENARIOS])
    return j.select("id", "kind", "label", "customers", (F.col("customers") / F.col("_n"))
                    .alias("share"), "churners", rate.alias("churn_rate"),
                    ratio(rate, F.col("_rate")).alias("lift"),
                    half_even(F.round("_risk", 6), 2).alias("revenue_at_risk"),
                    F.explode(scenarios).alias("_s")).select("*", "_s.*").drop("_s")


def group_impact(df: DataFrame, group: str, y: str, revenue: str | None = None,
                 kind: str = "segment") -> DataFrame:
    """Size, churners, lift, revenue at risk and the two savings of every group."""
    g = df.groupBy(col(group).cast("string").alias("_g")).agg(*_sums(y, revenue))
    named = g.select(F.concat(F.lit(f"{kind}_"), "_g").alias("id"), F.lit(kind).alias("kind"),
                     F.col("_g").alias("label"), "customers", "churners", "_risk")
    return _finish(named, df, y, revenue is not None)


def impact_by_segment(df: DataFrame, segment: str, y: str, revenue: str | None = None
                      ) -> DataFrame:
    return group_impact(df, segment, y, revenue).where(F.col("customers") >= MIN_GROUP)


def impact_by_level(df: DataFrame, columns: Sequence[str], y: str, revenue: str | None = None,
                    merged_other: Sequence[str] = ()) -> DataFrame:
    """Levels with at least 30 customers and a lift of at least 1.1, all columns in one pass. The
    folded level of the columns in `merged_other` is left out."""
    keep = [y] + ([revenue] if revenue else [])
    long = tall(df, {c: col(c).cast("string") for c in columns}, ("variable", "level"), keep=keep)
    long = long.where("level is not null")
    if merged_other:
        long = long.where(~(F.col("variable").isin(*merged_other) & (F.col("level") == OTHER)))
    g = long.groupBy("variable", "level").agg(*_sums(y, revenue))
    g = g.where(F.col("customers") >= MIN_GROUP)
    named = g.select(F.concat("variable", F.lit("="), "level").alias("id"),
                     F.lit("category").alias("kind"),
                     F.concat("variable", F.lit(" = "), "level").alias("label"),
                     "customers", "churners", "_risk")
    return _finish(named, df, y, revenue is not None).where(F.col("lift") >= MIN_LIFT)


def significant_columns(tests: DataFrame) -> DataFrame:
    return tests.where((F.col("kind") == "categorical") & F.col("significant")).select("variable")


def overall_impact(df: DataFrame, y: str, revenue: str | None = None) -> DataFrame:
    g = df.agg(*_sums(y, revenue)).select(
        F.lit("overall").alias("id"), F.lit("overall").alias("kind"),
        F.lit("All customers").alias("label"), "customers", "churners", "_risk")
    return _finish(g, df, y, revenue is not None)


def impact_top(items: DataFrame, overall: DataFrame, limit: int | None = None
               ) -> DataFrame:
    """The items (all, or the `limit` with most churners; each with its scenarios) and the overall row."""
    if limit is None:
        return items.unionByName(overall)
    best = (items.select("id", "churners").distinct().orderBy(F.desc("churners"), "id")
            .limit(limit).select("id"))
    return items.join(F.broadcast(best), "id", "left_semi").unionByName(overall)
