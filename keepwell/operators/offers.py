"""Retention offers: any layout to one long table, then effectiveness and bias checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions.scalar import DELIMITER_PATTERN, col, flag, ratio, squeeze, to_time
from keepwell.operators.clean import all_spelling_changes, apply_spellings
from keepwell.operators.hypothesis import TEST_SCHEMA, chi_square_row
from keepwell.roles import OfferRoles

# Cutoff-column names, date share, size of a testable offer, bias gap.
CUTOFF_NAME = r"snapshot|as_?of|cutoff|observation|extract"
DATE_SHARE = 0.95
MIN_SHOWN = 20
BIAS_GAP = 0.05


def is_flag_column(df: DataFrame, column: str) -> bool:
    """Every filled cell reads as yes or no (and there is at least one)."""
    text = squeeze(col(column).cast("string"))
    row = df.agg(F.count(text).alias("n"),
                 F.bool_and(F.when(text.isNotNull(), flag(column).isNotNull())).alias("f")).first()
    return row["n"] > 0 and bool(row["f"])


def _names(column: str) -> Column:
    parts = F.split(F.trim(col(column).cast("string")), DELIMITER_PATTERN)
    clean = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.array_distinct(F.filter(clean, lambda p: p != ""))


def reshape_offers(df: DataFrame, roles: OfferRoles, id_column: str, row_id: str) -> DataFrame:
    """customer_id, offer, accepted, offer_date: one row per customer and offer shown, the first
    in row order. Exploding happens before any shuffle and each customer keeps few rows."""
    date = to_time(roles.date) if roles.date and df.schema[roles.date].dataType.typeName() \
        == "string" else col(roles.date).cast("timestamp") if roles.date \
        else F.lit(None).cast("timestamp")
    if isinstance(roles.shown, str):
        offered = _names(roles.shown)
        if roles.accepted is None:
            took = F.transform(offered, lambda o: F.struct(o.alias("offer"),
                                                           F.lit(0).alias("accepted")))
        elif is_flag_column(df, str(roles.accepted)):
            yes = F.coalesce(flag(str(roles.accepted)), F.lit(0))
            took = F.transform(offered, lambda o: F.struct(o.alias("offer"), yes.alias("accepted")))
        else:
            taken = F.coalesce(F.transform(_names(str(roles.accepted)), F.lower),
                               F.array().cast("array<string>"))
            took = F.transform(offered, lambda o: F.struct(
                o.alias("offer"), F.array_contains(taken, F.lower(o)).cast("int").alias("accepted")))
    else:
        pairs = list(zip(roles.shown, roles.accepted or [None] * len(roles.shown), strict=True))
        took = F.array_compact(F.array(*[
            F.when(flag(s) == 1, F.struct(
                F.lit(re.sub(r"\s+", " ", s).strip()).alias("offer"),
                (F.coalesce(flag(a), F.lit(0)) if a else F.lit(0)).alias("accepted")))
            for s, a in pairs]))
    long = df.select(col(id_column).cast("string").alias("customer_id"), col(row_id).alias("_row"),
                     date.alias("offer_date"), F.posexplode(took).alias("_pos", "_o")).select(
        "customer_id", "_row", "_pos", "offer_date", "_o.offer", "_o.accepted")
    named = canonical_offers(long)
    first = F.min(F.struct("_row", "_pos", "accepted", "offer_date")).alias("_f")
    return named.groupBy("customer_id", "offer").agg(first).select(
        "customer_id", "offer", "_f.accepted", "_f.offer_date")


def canonical_offers(long: DataFrame) -> DataFrame:
    """Offer names that differ only in case take the most common spelling."""
    return apply_spellings(long, all_spelling_changes(long, ["offer"]), ["offer"])


def offer_catalog(long: DataFrame) -> DataFrame:
    return long.groupBy("offer").agg(F.count("*").alias("customers_shown"),
                                     F.sum("accepted").alias("accepted"))


def customers_offered(long: DataFrame) -> DataFrame:
    return long.agg(F.count_distinct("customer_id").alias("customers_offered"))


def cutoff_column(df: DataFrame, barred: set[str] = frozenset()) -> str | None:
    """First observation-date column (by name) that is nearly always a date."""
    named = [c for c in df.columns if c not in barred and re.search(CUTOFF_NAME, c, re.I)]
    if not named:
        return None
    kinds = {c: df.schema[c].dataType.typeName() for c in named}
    reads = [col(c).isNotNull() if kinds[c] in ("timestamp", "timestamp_ntz", "date")
             else to_time(c).isNotNull() for c in named]
    row = df.agg(*[F.avg(r.cast("int")).alias(f"r{i}") for i, r in enumerate(reads)]).first()
    return next((c for i, c in enumerate(named) if (row[f"r{i}"] or 0) > DATE_SHARE), None)


def drop_after_cutoff(long: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Offers sent after their customer's observation date are left out; unknown dates stay.
    `cutoffs` has one row per customer: customer_id, cutoff."""
    j = long.join(cutoffs, "customer_id", "left")
    late = F.coalesce(F.col("offer_date") > F.col("cutoff"), F.lit(False))
    return j.where(~late).select(*long.columns)


def _cells(churned: str = "churned") -> list[Column]:
    took, y = F.col("accepted") == 1, col(churned)
    out = [F.count("*").alias("shown"), F.sum("accepted").alias("accepted"),
           F.avg("accepted").alias("acceptance_rate")]
    for name, cond in (("acceptors", took), ("decliners", ~took)):
        n, x = F.count(F.when(cond, y)), F.sum(F.when(cond, y))
        out += [n.alias(f"{name}_n"), F.coalesce(x, F.lit(0)).alias(f"{name}_churned"),
                F.avg(F.when(cond, y)).alias(f"{name}_churn_rate")]
    return out


def offer_effectiveness(long: DataFrame, customers: DataFrame, segment: str | None = None
                        ) -> DataFrame:
    """Acceptance and churn of acceptors and decliners per offer, and per (offer, segment) when a
    segment is given: both levels in one aggregate. `customers`: customer_id, churned[, segment]."""
    j = long.join(customers, "customer_id", "left")
    if segment is None:
        return j.groupBy("offer").agg(*_cells())
    level = F.grouping_id().alias("_level")
    g = j.groupingSets([["offer", segment], ["offer"]], "offer", segment).agg(*_cells(), level)
    return g.where((F.col("_level") != 0) | col(segment).isNotNull()).withColumn(
        "scope", F.when(F.col("_level") == 0, "segment").otherwise("offer")).drop("_level")


def offer_counts(long: DataFrame, customers: DataFrame) -> DataFrame:
    """Accepted-by-churned counts per offer large enough to test."""
    j = long.join(customers.select("customer_id", "churned"), "customer_id")
    took, left = F.col("accepted") == 1, F.col("churned") == 1
    g = j.groupBy("offer").agg(
        F.count_if(took & ~left).alias("accepted_retained"),
        F.count_if(took & left).alias("accepted_churned"),
        F.count_if(~took & ~left).alias("declined_retained"),
        F.count_if(~took & left).alias("declined_churned"))
    a, b, c, d = (F.col(x) for x in ("accepted_retained", "accepted_churned", "declined_retained",
                                     "declined_churned"))
    return g.where((a + b + c + d >= MIN_SHOWN) & (a + b > 0) & (c + d > 0) & (a + c > 0)
                   & (b + d > 0))


def offer_tests(long: DataFrame, customers: DataFrame) -> DataFrame:
    """Accepted against declined per offer, to join the test family before its correction."""
    rows = [chi_square_row(f"Offer: {r['offer']}", "offer", {
        "Accepted": (r["accepted_retained"], r["accepted_churned"]),
        "Declined": (r["declined_retained"], r["declined_churned"])})
        for r in offer_counts(long, customers).orderBy("offer").collect()]  # one row per offer
    return long.sparkSession.createDataFrame(rows, TEST_SCHEMA)


def with_offered(customers: DataFrame, long: DataFrame) -> DataFrame:
    ids = long.select("customer_id").distinct().withColumn("_o", F.lit(True))
    return customers.join(ids, "customer_id", "left").withColumn(
        "offered", F.coalesce("_o", F.lit(False))).drop("_o")


def never_offered(customers: DataFrame, long: DataFrame) -> DataFrame:
    """Churn of customers with and without any offer."""
    return with_offered(customers, long).groupBy("offered").agg(
        F.count("churned").alias("n"), F.sum("churned").alias("churned"),
        F.avg("churned").alias("churn_rate"))


def selection_bias(predictions: DataFrame, long: DataFrame) -> DataFrame:
    """Mean predicted risk of offered and never-offered customers; flagged beyond the gap."""
    m = with_offered(predictions, long).agg(
        F.avg(F.when(F.col("offered"), F.col("churn_probability"))).alias("offered_mean_risk"),
        F.avg(F.when(~F.col("offered"), F.col("churn_probability"))).alias("never_offered_mean_risk"))
    gap = F.col("offered_mean_risk") - F.col("never_offered_mean_risk")
    return m.select("*", gap.alias("gap"), (gap >= BIAS_GAP).alias("flagged"))
