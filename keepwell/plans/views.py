"""Customer, offer, score and experiment tables derived from the star-schema files.

Every view has a Spark builder and the same definition as DuckDB SQL (`CTES`), so each operator
can be checked on equal input. Only the sources a caller's columns need are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.functions.scalar import half_even, hash_unit, risk_band

SNAPSHOT = "2001-02-01"
DAYS_PER_MONTH = 30.4375
EXPERIMENT = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unit(prefix: str, key: str):
    return hash_unit(F.lit(prefix), F.col(key))


def _order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = F.lit(SNAPSHOT).cast("timestamp")
    seen = F.col("o_orderdate") <= snap
    o = table(spark, sf_dir, "orders")
    f = o.groupBy("o_custkey").agg(
        F.nullif(F.count_if(seen), F.lit(0)).alias("n_orders"),
        F.round(F.sum(F.when(seen, F.col("o_totalprice"))), 2).alias("revenue"),
        F.min(F.when(seen, F.col("o_orderdate"))).alias("first_order"),
        F.max(F.when(seen, F.col("o_orderdate"))).alias("last_order"),
        F.max(~seen).alias("later"))
    return f.select(
        "o_custkey", "n_orders", "revenue", "later",
        (F.col("revenue") / F.col("n_orders")).alias("avg_order"),
        (F.datediff(snap, "first_order") / DAYS_PER_MONTH).alias("tenure"),
        F.datediff(snap, "last_order").cast("double").alias("recency"))


def _return_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = F.lit(SNAPSHOT).cast("timestamp")
    lines = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count("*").alias("c")))
    o = (table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= snap)
         .select("o_orderkey", "o_custkey"))
    return (o.join(lines, o["o_orderkey"] == lines["l_orderkey"]).groupBy("o_custkey")
            .agg((F.sum("r") / F.sum("c")).alias("returned_share"))
            .withColumnRenamed("o_custkey", "_rk"))


def customers(spark: SparkSession, sf_dir: str, returns: bool = True) -> DataFrame:
    """One row per customer. `returns=False` leaves out the line-item join."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = (nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
              .select("n_nationkey", F.col("n_name").alias("nation"),
                      F.col("r_name").alias("region")))
    c = table(spark, sf_dir, "customer")
    f = _order_features(spark, sf_dir)
    out = (c.join(F.broadcast(places), c["c_nationkey"] == places["n_nationkey"])
           .join(f, c["c_custkey"] == f["o_custkey"], "left"))
    cols = [c["c_custkey"].alias("customer_id"), "region", "nation",
            c["c_mktsegment"].alias("segment"), c["c_acctbal"].alias("balance"), "n_orders",
            "revenue", "avg_order"]
    if returns:
        r = _return_shares(spark, sf_dir)
        out = out.join(r, c["c_custkey"] == r["_rk"], "left")
        cols.append("returned_share")
    churned = F.when(F.coalesce(F.col("later"), F.lit(False)), 0).otherwise(1)
    return out.select(*cols, "tenure", "recency", churned.alias("churned"))


def planted(spark: SparkSession, sf_dir: str, returns: bool = True) -> DataFrame:
    """Customers with a planted outcome: the building segment and high balances leave more."""
    base = customers(spark, sf_dir, returns)
    stats = table(spark, sf_dir, "customer").agg(F.avg("c_acctbal").alias("_m"),
                                                 F.stddev_pop("c_acctbal").alias("_s"))
    z = (F.col("balance") - F.col("_m")) / F.col("_s")
    lift = F.when(F.col("segment") == "BUILDING", 1.2).otherwise(0.0)
    p = 1 / (1 + F.exp(-(F.lit(-1.0) + lift + 0.5 * z)))
    return (base.crossJoin(F.broadcast(stats))
            .withColumn("churned", (unit("y", "customer_id") < p).cast("int")).drop("_m", "_s"))


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-text copy with planted faults and the original row order in `row_id`."""
    base = customers(spark, sf_dir, returns=False)
    cid = F.col("customer_id")
    seg = (F.when(cid % 43 == 0, "  ").when(cid % 41 == 0, F.concat(F.lit(" "), "segment", F.lit("  ")))
           .when(cid % 37 == 0, F.lower("segment")).otherwise(F.col("segment")))
    bal = F.when(cid % 47 == 0, " ").when(cid % 53 == 0, "1d").otherwise(F.format_number("balance", 2))
    last = F.to_date(F.lit(SNAPSHOT)) - F.col("recency").cast("int")
    shape = F.when(cid % 59 == 0, F.date_format(last, "M/d/yyyy")).when(
        cid % 61 == 0, F.date_format(last, "d MMM yyyy")).when(
        cid % 67 == 0, F.date_format(last, "MMM d, yyyy")).otherwise(F.date_format(last, "yyyy-MM-dd"))
    copies = F.when(cid % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.select(
        F.explode(copies).alias("copy"), cid, seg.alias("segment"), bal.alias("balance"),
        F.col("region"), shape.alias("last_order"),
        F.when(F.col("churned") == 1, "Yes").otherwise("No").alias("Churn")).select(
        (cid * 2 + F.col("copy")).alias("row_id"), cid.cast("string").alias("customer_id"),
        "segment", "balance", "region", "last_order", "Churn")


def offer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min(F.struct("o_orderdate", "o_orderkey", "o_orderstatus")).alias("f")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(first)
    return o.select(F.col("o_custkey").alias("customer_id"),
                    F.col("o_orderpriority").alias("offer"),
                    (F.col("f.o_orderstatus") == "F").cast("int").alias("accepted"),
                    F.col("f.o_orderdate").alias("offer_date"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score per customer with its band; the outcome is the observed one."""
    base = customers(spark, sf_dir, returns=False)
    p = half_even(unit("p", "customer_id"), 3)
    return base.select("customer_id", p.alias("churn_probability"),
                       risk_band(p).alias("risk_band"), F.col("churned").alias("actual_churn"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with ties and an outcome that follows them."""
    p = F.floor(unit("s", "id") * 50) / F.lit(50.0)
    return (table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
            .select("id", (unit("y", "id") < p).cast("int").alias("y"), p.alias("p")))


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer")
    arm = F.when(hash_unit(F.lit(EXPERIMENT), F.col("c_custkey")) < 0.5, "control")
    segs = F.array_compact(F.array(
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("building")),
        F.when(F.col("c_acctbal") >= 5000, F.lit("rich"))))
    return base.select(F.lit(EXPERIMENT).cast("long").alias("experiment_id"),
                       F.col("c_custkey").alias("customer_id"),
                       arm.otherwise("treatment").alias("arm"), segs.alias("segments"))


def outcomes(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    a = assignment(spark, sf_dir)
    if broken:
        a = a.where((F.col("arm") == "treatment") | (unit("b", "customer_id") < 2 / 3))
    took = (F.col("arm") == "treatment") & (unit("a", "customer_id") < 0.45)
    rate = F.when(took, 0.149).otherwise(0.26)
    return a.select(
        "experiment_id", "customer_id", "arm", "segments",
        F.when(F.col("arm") == "treatment", took.cast("int")).alias("offer_accepted"),
        (unit("c", "customer_id") < rate).cast("int").alias("churned"),
        (F.lit(70.0) + 12 * (unit("r", "customer_id") - 0.5)).alias("revenue"),
        (unit("m", "customer_id") < 0.1).cast("int").alias("complaints"))


def usage_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "orders")
            .groupBy(F.col("o_custkey").alias("customer_id"),
                     F.trunc("o_orderdate", "month").alias("month"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("spend"), F.count("*").alias("orders")))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.concat(F.lit("model-"), (F.col("user_id") % 3).cast("string"))
    status = F.when(F.col("event_type") == "error", "failed").otherwise("done")
    return table(spark, sf_dir, "events").select(
        F.col("event_id"), F.col("event_type").alias("node"), F.col("ts").alias("started_at"),
        (F.col("value") * 1000).alias("latency_ms"), status.alias("status"),
        model.alias("model"), (F.col("user_id") % 4).alias("retries"), "user_id")


# The same views as DuckDB SQL, with the views each one reads.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "customers": ((), """
  SELECT c.c_custkey AS customer_id, r.r_name AS region, n.n_name AS nation,
         c.c_mktsegment AS segment, c.c_acctbal AS balance, f.n_orders, f.revenue,
         f.revenue / f.n_orders AS avg_order, s.returned_share,
         date_diff('day', f.first_order, TIMESTAMP '2001-02-01') / 30.4375::DOUBLE AS tenure,
         date_diff('day', f.last_order, TIMESTAMP '2001-02-01')::DOUBLE AS recency,
         CASE WHEN coalesce(f.later, false) THEN 0 ELSE 1 END::INTEGER AS churned
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (
    SELECT o_custkey,
           nullif(count(*) FILTER (o_orderdate <= TIMESTAMP '2001-02-01'), 0) AS n_orders,
           round(sum(o_totalprice) FILTER (o_orderdate <= TIMESTAMP '2001-02-01'), 2) AS revenue,
           min(o_orderdate) FILTER (o_orderdate <= TIMESTAMP '2001-02-01') AS first_order,
           max(o_orderdate) FILTER (o_orderdate <= TIMESTAMP '2001-02-01') AS last_order,
           bool_or(o_orderdate > TIMESTAMP '2001-02-01') AS later
    FROM orders GROUP BY 1) f ON f.o_custkey = c.c_custkey
  LEFT JOIN (
    SELECT o_custkey, count(*) FILTER (l_returnflag = 'R')::DOUBLE / count(*) AS returned_share
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderdate <= TIMESTAMP '2001-02-01' GROUP BY 1) s ON s.o_custkey = c.c_custkey"""),
    "planted": (("customers",), """
  SELECT k.* EXCLUDE (churned), (unit('y:' || customer_id) < 1 / (1 + exp(-(-1.0
           + CASE WHEN segment = 'BUILDING' THEN 1.2 ELSE 0 END
           + 0.5 * (balance - m.m) / m.s))))::INTEGER AS churned
  FROM customers k CROSS JOIN
       (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer) m"""),
    "dirty": (("customers",), """
  SELECT customer_id * 2 + copy AS row_id, customer_id::VARCHAR AS customer_id,
         CASE WHEN customer_id % 43 = 0 THEN '  '
              WHEN customer_id % 41 = 0 THEN ' ' || segment || '  '
              WHEN customer_id % 37 = 0 THEN lower(segment) ELSE segment END AS segment,
         CASE WHEN customer_id % 47 = 0 THEN ' ' WHEN customer_id % 53 = 0 THEN '1d'
              ELSE format('{:,.2f}', balance) END AS balance,
         region, CASE WHEN customer_id % 59 = 0 THEN strftime(DATE '2001-02-01' - recency::INTEGER, '%-m/%-d/%Y')
              WHEN customer_id % 61 = 0 THEN strftime(DATE '2001-02-01' - recency::INTEGER, '%-d %b %Y')
              WHEN customer_id % 67 = 0 THEN strftime(DATE '2001-02-01' - recency::INTEGER, '%b %-d, %Y')
              ELSE strftime(DATE '2001-02-01' - recency::INTEGER, '%Y-%m-%d') END
           AS last_order,
         CASE WHEN churned = 1 THEN 'Yes' ELSE 'No' END AS "Churn"
  FROM customers JOIN (VALUES (0), (1)) v(copy) ON copy = 0 OR customer_id % 50 = 0"""),
    "offer_history": ((), """
  SELECT o_custkey AS customer_id, o_orderpriority AS offer,
         (o_orderstatus = 'F')::INTEGER AS accepted, o_orderdate AS offer_date
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority
                                         ORDER BY o_orderdate, o_orderkey) = 1"""),
    "predictions": (("customers",), """
  SELECT customer_id, p AS churn_probability,
         CASE WHEN p >= 0.6 THEN 'High' WHEN p >= 0.3 THEN 'Medium' ELSE 'Low' END AS risk_band,
         churned AS actual_churn
  FROM (SELECT *, round_even(unit('p:' || customer_id), 3) AS p FROM customers)"""),
    "scored": ((), """
  SELECT id, (unit('y:' || id) < p)::INTEGER AS y, p
  FROM (SELECT c_custkey AS id, floor(unit('s:' || c_custkey) * 50) / 50.0::DOUBLE AS p
        FROM customer)"""),
    "assignment": ((), """
  SELECT 1::BIGINT AS experiment_id, c_custkey AS customer_id,
         CASE WHEN unit('1:' || c_custkey) < 0.5 THEN 'control' ELSE 'treatment' END AS arm,
         list_filter([CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' END,
                      CASE WHEN c_acctbal >= 5000 THEN 'rich' END], lambda x: x IS NOT NULL)
           AS segments
  FROM customer"""),
    "outcomes": (("assignment",), """
  SELECT experiment_id, customer_id, arm, segments,
         CASE WHEN arm = 'treatment' THEN took::INTEGER END AS offer_accepted,
         (unit('c:' || customer_id) < CASE WHEN took THEN 0.149 ELSE 0.26 END)::INTEGER AS churned,
         70.0::DOUBLE + 12 * (unit('r:' || customer_id) - 0.5) AS revenue,
         (unit('m:' || customer_id) < 0.1)::INTEGER AS complaints
  FROM (SELECT *, arm = 'treatment' AND unit('a:' || customer_id) < 0.45 AS took
        FROM assignment)"""),
    "outcomes_broken": (("outcomes",), """
  SELECT * FROM outcomes
  WHERE arm = 'treatment' OR unit('b:' || customer_id) < 2.0::DOUBLE / 3"""),
    "usage_monthly": ((), """
  SELECT o_custkey AS customer_id, date_trunc('month', o_orderdate)::DATE AS "month",
         round(sum(o_totalprice), 2) AS spend, count(*) AS orders
  FROM orders GROUP BY 1, 2"""),
    "intervals": ((), """
  SELECT event_id, event_type AS node, ts AS started_at, value * 1000 AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status,
         'model-' || (user_id % 3) AS model, user_id % 4 AS retries, user_id
  FROM events"""),
}

_UNIT = ("('0x' || substr(sha256({}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0")


def _expand_units(sql: str) -> str:
    """Write out unit(key) calls; a key never contains a closing bracket."""
    while "unit(" in sql:
        head, rest = sql.split("unit(", 1)
        key, tail = rest.split(")", 1)
        sql = f"{head}({_UNIT.format(key)}){tail}"
    return sql


def oracle(views: str, body: str) -> str:
    """SELECT text preceded by the definitions of the views it reads, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in views.split():
        visit(name)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        body, lead = body[5:], ", "
    else:
        lead = " "
    heads = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order)
    if not heads:
        return _expand_units(("WITH " if lead == ", " else "") + body)
    return _expand_units(f"WITH {heads}{lead if lead == ', ' else chr(10)}{body}")
