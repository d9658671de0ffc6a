"""Customer features from event logs: usage trends, contact roll-ups, offers, price gaps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions.ordered import previous_values
from keepwell.functions.scalar import col, ratio

# Window of the contact roll-up, repeat window, downtrade share.
ROLLUP_DAYS = 90
REPEAT_DAYS = 7
DOWNTRADE_SHARE = 0.85


def usage_trend(usage: DataFrame, last_month: dt.date, value: str) -> DataFrame:
    """Mean of the last three months against the three before, and the change in percent."""
    now = F.add_months(F.lit(last_month), -3)
    before = F.add_months(F.lit(last_month), -6)
    recent = (F.col("month") > now) & (F.col("month") <= F.lit(last_month))
    earlier = (F.col("month") > before) & (F.col("month") <= now)
    g = usage.where((F.col("month") > before) & (F.col("month") <= F.lit(last_month))).groupBy(
        "customer_id").agg(F.avg(F.when(recent, col(value))).alias("recent"),
                           F.avg(F.when(earlier, col(value))).alias("previous"))
    return g.withColumn("change_pct", F.round(
        100 * (ratio(F.col("recent"), F.col("previous")) - 1), 1))


def downtrade(recent: Column, previous: Column, share: float = DOWNTRADE_SHARE) -> Column:
    return F.when(recent < share * previous, "Yes").otherwise("No")


def repeat_contacts(contacts: DataFrame, customer: str, category: str, time: str, tie: str, *,
                    days: int = REPEAT_DAYS) -> DataFrame:
    """Adds `is_repeat`: the customer's previous contact had the same category and was at most
    `days` whole days ago. A very active customer is cut into time ranges."""
    p = previous_values(contacts, [customer], [time, tie], {"_was": category, "_when": time})
    gap = F.floor((F.unix_micros(col(time).cast("timestamp"))
                   - F.unix_micros(F.col("_when").cast("timestamp"))) / F.lit(86_400_000_000))
    again = (F.col("_was") == col(category)) & (gap <= days)
    return p.withColumn("is_repeat", F.coalesce(again, F.lit(False))).drop("_was", "_when")


def contact_rollup(contacts: DataFrame, customers: DataFrame, customer: str, category: str,
                   time: str, until: dt.datetime, categories: list[str], score: str,
                   days: int = ROLLUP_DAYS) -> DataFrame:
    """Counts by category, repeats, resolution share and mean score of the last days; customers
    without contacts get zeros. `contacts` carries is_repeat and resolved."""
    since = F.lit(until) - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = contacts.where((col(time) > since) & (col(time) <= F.lit(until)))
    g = recent.groupBy(col(customer).alias("customer_id")).agg(
        F.count("*").alias("contacts"),
        *[F.count_if(col(category) == c).alias(f"n_{c}") for c in categories],
        F.count_if("is_repeat").alias("repeats"),
        F.round(F.avg(F.col("resolved").cast("int")), 2).alias("resolution_rate"),
        F.round(F.avg(col(score)), 2).alias("mean_score"))
    counts = ["contacts", *[f"n_{c}" for c in categories], "repeats"]
    out = customers.select("customer_id").join(g, "customer_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})


def modal_value(df: DataFrame, customer: str, value: str) -> DataFrame:
    """Most frequent value per customer, ties to the first in order; two combined aggregates and no
    window, so one very active customer costs nothing extra."""
    counts = df.groupBy(col(customer), col(value)).agg(F.count("*").alias("_n"))
    return counts.groupBy(col(customer)).agg(F.min(F.struct(
        (-F.col("_n")).alias("o"), col(value).alias("v"))).alias("_b")).select(
        col(customer), F.col("_b.v").alias("modal"))


def offers_received(customers: DataFrame, offers: DataFrame) -> DataFrame:
    n = offers.groupBy("customer_id").agg(F.count("*").alias("_n"))
    return customers.select("customer_id").join(n, "customer_id", "left").select(
        "customer_id", F.coalesce("_n", F.lit(0)).alias("offers_received"))


def price_gap(customers: DataFrame, prices: DataFrame, place: str, paid: str) -> DataFrame:
    """Percent gap to the price of the customer's place (a small lookup)."""
    j = customers.join(prices, place, "left")
    return j.select("customer_id", F.round(100 * (ratio(col(paid), F.col("price")) - 1), 1)
                    .alias("price_gap_pct"))
