"""Ad-hoc questions over the customer table and the result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.ordered import ranged, running_over, value_counts
from keepwell.functions.scalar import col
from keepwell.operators.filters import Filter, FilterError, as_number, question_predicate

# Filters per question, groups shown, page size.
PAGE_SIZE = 50
METRICS = ("count", "mean", "median", "sum", "churn_rate")


def filter_and_aggregate(df: DataFrame, metric: str, *, filters: Sequence[Filter] = (),
                         column: str | None = None, group_by: str | None = None,
                         target: str | None = None, ids: Sequence[str] = (),
                         most: int | None = None) -> DataFrame:
    """group, n, value (and, per row, how many groups there are and whether the list is cut: it is only
    where the caller asks for the first `most`, in name order). Without a group: one row with a null
    group."""
    if metric not in METRICS:
        raise FilterError(f"Unknown metric '{metric}'.")
    if metric in ("mean", "median", "sum") and not column:
        raise FilterError(f"Metric '{metric}' needs a numeric column.")
    used = [f.column for f in filters] + [c for c in (group_by, column) if c]
    unknown = sorted({c for c in used if c not in df.columns or c in ids})
    if unknown:
        raise FilterError(f"Unknown column(s): {', '.join(unknown)}.")
    if metric == "churn_rate" and (not target or target not in df.columns):
        raise FilterError("The churn column is not available.")
    data = df.where(question_predicate(df, filters))
    source = target if metric == "churn_rate" else column
    value = as_number(df, source) if source else F.lit(None).cast("double")
    group = (F.coalesce(col(group_by).cast("string"), F.lit("nan")) if group_by
             else F.lit(None).cast("string"))
    rows = data.select(group.alias("group"), value.alias("_v"))
    if source and metric != "churn_rate" and rows.limit(1).count() and not rows.where(
            F.col("_v").isNotNull()).limit(1).count():
        raise FilterError(f"Column '{column}' is not numeric.")
    made = {"count": F.count("*").cast("double"), "mean": F.avg("_v"), "sum": F.sum("_v"),
            "churn_rate": F.avg("_v"), "median": F.lit(None).cast("double")}[metric]
    g = rows.groupBy("group").agg(F.count("*").alias("n"), made.alias("value"))
    shown = g if most is None else g.orderBy("group").limit(most)
    if metric == "median":
        middle = _medians(rows).withColumnRenamed("group", "_g")
        shown = shown.join(middle, shown["group"].eqNullSafe(middle["_g"]), "left").select(
            "group", "n", F.col("_m").alias("value"))
    total = F.broadcast(g.agg(F.count("*").alias("groups_total")))  # one row
    cut = F.lit(False) if most is None else F.col("groups_total") > most
    return shown.crossJoin(total).withColumn("truncated", cut)


def _medians(rows: DataFrame) -> DataFrame:
    """group, _m: the middle value, or the mean of the two, of every group, from running counts of
    distinct values; no group is held in one place."""
    counts = value_counts(rows, ["group"], "_v", {"c": F.count("*")})
    cut = ranged(counts, ["group"], ["_v"])
    sizes = cut.groupBy(F.col("group").alias("_of")).agg(F.sum("c").alias("size"))
    ran = running_over(cut, ["group"], "_v", {"upto": "c"})
    ran = ran.join(sizes, ran["group"].eqNullSafe(sizes["_of"]))
    low, high = (F.min(F.when(F.col("upto") > rank, F.col("_v"))) for rank in (
        F.floor((F.col("size") - 1) / 2), F.ceil((F.col("size") - 1) / 2)))
    return ran.groupBy("group").agg(((low + high) / 2).alias("_m"))


def customer_frame(clean: DataFrame, predictions: DataFrame, id_column: str) -> DataFrame:
    """Cleaned rows with the customer's probability and band (null when not scored)."""
    first = predictions.groupBy(F.col("customer_id").cast("string").alias("_id")).agg(
        F.max(F.struct("churn_probability", "risk_band")).alias("_p"))
    keep = [c for c in clean.columns if c not in ("churn_probability", "risk_band")]
    j = clean.join(first, col(id_column).cast("string") == first["_id"], "left")
    return j.select(*[clean[c] for c in keep], "_p.churn_probability", "_p.risk_band")


def customer_risk(predictions: DataFrame, customer_id: object) -> DataFrame:
    """One customer's score; the filter reaches the file scan."""
    return predictions.where(F.col("customer_id") == customer_id)


def lookup(table: DataFrame, column: str, value: str) -> DataFrame:
    """The row of a result table with this (case-insensitive) name."""
    return table.where(F.lower(col(column).cast("string")) == str(value).lower())


def predictions_page(predictions: DataFrame, nbo: DataFrame | None = None, *,
                     band: str | None = None, query: str | None = None, page: int = 1,
                     size: int = PAGE_SIZE) -> DataFrame:
    """One page in score order. Only the page itself is joined to the offers."""
    shown = _matching(predictions, band, query)
    rows = (shown.orderBy(F.desc("churn_probability"), "customer_id")
            .offset((page - 1) * size).limit(size))
    if nbo is None:
        return rows
    best = nbo.select("customer_id", "best_offer", "expected_value", "runner_up", "runner_up_value")
    return rows.join(best, "customer_id", "left").orderBy(F.desc("churn_probability"),
                                                          "customer_id")


def _matching(predictions: DataFrame, band: str | None, query: str | None) -> DataFrame:
    out = predictions
    if band:
        out = out.where(F.col("risk_band") == band)
    if query and query.strip():
        out = out.where(F.lower(F.col("customer_id").cast("string"))
                        .contains(query.strip().lower()))
    return out


def page_count(predictions: DataFrame, *, band: str | None = None, query: str | None = None,
               size: int = PAGE_SIZE) -> DataFrame:
    n = F.count("*")
    return _matching(predictions, band, query).agg(
        n.alias("total"), F.greatest(F.lit(1), F.ceil(n / size)).alias("pages"))


def offer_detail(nbo: DataFrame, predictions: DataFrame, customer_id: object) -> DataFrame:
    """A customer's best offer with the band and reasons of the score."""
    p = customer_risk(predictions, customer_id)
    extra = [c for c in p.columns if c not in nbo.columns]
    return nbo.where(F.col("customer_id") == customer_id).join(
        p.select("customer_id", *extra), "customer_id")
