"""Times the headline stages and queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
BENCH_COPIES=n repeats the customer base n times (new ids) for a larger run of the stages.
Stages read a stored customer table, as a pipeline does; queries start from the raw files.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from keepwell import get_session  # noqa: E402
from keepwell.operators import (business, clean, describe, hypothesis, metrics, nbo,  # noqa: E402
                                segment, survival)
from keepwell.plans import registry, views  # noqa: E402
from keepwell.plans.catalogue.offers import CATALOGUE  # noqa: E402
from keepwell.roles import Roles  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COPIES = int(os.environ.get("BENCH_COPIES", "1"))
NUM = ["balance", "n_orders", "revenue", "avg_order", "tenure", "recency"]
CAT = ["region", "nation", "segment"]
HEADLINE = ("view_customers", "impact_by_level", "kaplan_meier", "next_best_offer_measured",
            "next_best_offer_assumed", "offer_effectiveness_by_segment", "analyse_experiment",
            "results_checks", "deciles", "facts_table", "repeat_within_7d", "busy_time")
ROLES = Roles("Churn", "Yes", ("customer_id",), types={
    "customer_id": "id", "segment": "categorical", "balance": "numeric", "region": "categorical",
    "last_order": "datetime"})


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def copies(df, key="customer_id"):
    if COPIES == 1:
        return df
    many = df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    wide = F.col(key).cast("long") + F.col("_c") * 10_000_000
    out = many.withColumn(key, wide.cast(df.schema[key].dataType)).drop("_c")
    return out.repartition(4 * int(CPUS))  # a large table is many files


def stages(spark, folder):
    def stored(name):
        return spark.read.parquet(f"{folder}/{name}")

    def cleaning():
        run(clean.clean(stored("dirty"), ROLES, "row_id").frame)

    def exploratory():
        df = stored("base")
        steps = (lambda: describe.overview(df, "churned"),
                 lambda: describe.numeric_summary(df, NUM, "churned"),
                 lambda: describe.histogram(df, NUM),
                 lambda: describe.category_rates(df, CAT, "churned"),
                 lambda: describe.correlation_matrix(df, NUM),
                 lambda: describe.tenure_bands(df, "tenure", "churned"))
        with ThreadPoolExecutor(6) as pool:  # independent tables, as in the analysis chain
            list(pool.map(lambda step: run(step()), steps))

    def segmentation():
        run(segment.segment(stored("base"), NUM, "customer_id", "tenure").frame)

    def surviving():
        df = survival.durations(stored("base"), "tenure")
        steps = (lambda: survival.downsample(survival.kaplan_meier(df, "tenure", "churned")),
                 lambda: survival.logrank_tests(survival.logrank_counts(
                     df, ["region", "segment"], "tenure", "churned")))
        with ThreadPoolExecutor(2) as pool:
            list(pool.map(lambda step: run(step()), steps))

    def testing():
        run(hypothesis.run_tests(stored("base"), CAT, NUM, "churned"))

    def measured_offers():
        c, long = stored("base"), stored("offers")
        run(nbo.score_next_best_offers(c, nbo.offer_rates(long, c), None,
                                       nbo.declined_recently(long), revenue="avg_order"))

    def business_recompute():
        t = business.next_best_offer(stored("base"), "churn_probability", "avg_order", CATALOGUE)
        run(business.business_kpis(t))

    def model_metrics():
        long = metrics.long_scores(stored("base"), "churned", {"raw": "churn_probability"},
                                   "customer_id")
        run(metrics.evaluate(long))
        run(metrics.deciles(long))

    return {"stage_cleaning": cleaning, "stage_exploratory": exploratory,
            "stage_segmentation": segmentation, "stage_survival": surviving,
            "stage_hypothesis": testing, "stage_next_best_offer": measured_offers,
            "stage_business": business_recompute, "stage_metrics": model_metrics}


def main() -> None:
    spark = get_session("keepwell-bench", master=f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false"})
    folder = tempfile.mkdtemp(prefix="keepwell-bench-")
    p = views.predictions(spark, SF).select("customer_id", "churn_probability", "risk_band")
    base = views.planted(spark, SF, returns=False).join(p, "customer_id")
    copies(base).write.parquet(f"{folder}/base")
    copies(views.dirty(spark, SF)).write.parquet(f"{folder}/dirty")
    copies(views.offer_history(spark, SF)).write.parquet(f"{folder}/offers")
    times: dict[str, float] = {}
    for name, step in stages(spark, folder).items():
        best = None
        for _ in range(3 if COPIES == 1 else 1):
            start = time.perf_counter()
            step()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
            spark.catalog.clearCache()
        times[name] = round(best, 3)
    if COPIES == 1:
        known = registry.queries()
        for name in HEADLINE:
            best = None
            for _ in range(2):
                start = time.perf_counter()
                run(known[name](spark, SF))
                took = time.perf_counter() - start
                best = took if best is None else min(best, took)
                spark.catalog.clearCache()
            times[name] = round(best, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": os.path.basename(SF.rstrip("/")),
                      "cpus": int(CPUS), "copies": COPIES}))
    spark.stop()


if __name__ == "__main__":
    main()
