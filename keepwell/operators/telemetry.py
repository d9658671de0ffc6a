"""Roll-ups of run events: latency per step, busy time, token cost, history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepwell.functions.ordered import greatest_before


def latency_by_step(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Total latency, runs, last status and retries of every step."""
    return events.groupBy("node").agg(
        F.sum("latency_ms").alias("latency_ms"), F.count("*").alias("runs"),
        F.max_by("status", F.struct("started_at", order)).alias("status"),
        F.sum("retries").alias("retries"))


def busy_time(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Milliseconds covered by at least one interval. Each interval adds only what reaches beyond
    the latest end before it, so the union needs one running maximum and one sum."""
    start = F.unix_micros(F.col("started_at").cast("timestamp")).cast("double") / 1000
    spans = events.select("started_at", order, start.alias("_start"),
                          (start + F.col("latency_ms")).alias("_end"))
    ran = greatest_before(spans, [], ["started_at", order], "_end", "_before")
    since = F.greatest(F.col("_start"), F.coalesce("_before", F.col("_start")))
    return ran.agg(F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("_end") - since)), F.lit(0.0))
                   .alias("busy_ms"))


def token_cost(events: DataFrame, prices: DataFrame, default_in: float = 0.0,
               default_out: float = 0.0) -> DataFrame:
    """Tokens and cost per model; `prices`: model, input_per_1m, output_per_1m."""
    t = events.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"),
                                    F.sum("output_tokens").alias("output_tokens"))
    j = t.join(prices, "model", "left")
    cost = (F.col("input_tokens") * F.coalesce("input_per_1m", F.lit(default_in))
            + F.col("output_tokens") * F.coalesce("output_per_1m", F.lit(default_out))) / 1_000_000
    return j.select("model", "input_tokens", "output_tokens", cost.alias("cost"))


def run_history(runs: DataFrame, workspace: object, limit: int = 50, column: str = "workspace",
                order: str = "id") -> DataFrame:
    """Newest runs of a workspace."""
    return runs.where(F.col(column) == workspace).orderBy(F.desc(order)).limit(limit)
