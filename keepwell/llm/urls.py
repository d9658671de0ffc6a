"""URL filter rules by a sort-merge range join.

Host labels in reverse order ("net.example.") turn "this host and all its subdomains" into an
interval of keys: from the key itself to the key whose last dot is the next character. Rule hosts
and the distinct url hosts are sorted together by key; a sweep keeps, per number of labels, the rule
host that began last, which is the stack of nested rule hosts, and an entry is active while its
interval lasts. The stack at the end of each range is carried to the next. Of the active rules whose
path the url's path starts with, the longest wins.

Defined cases: a url that is null or has no "://" has an empty host and path, and no rule fits it;
rules without a host fit nothing; a null rule path fits any path; of equally long rules the one with
the longer host wins, then block over allow; repeated rows each get their verdict; an empty table
gives an empty result; other columns stay out. The path rules of one host travel as one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.llm.store import shared_folder, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def interval_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _events(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule hosts (kind 0, before equal keys) and url hosts (kind 1), dealt into sorted ranges."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    starts = rules.where("host <> ''").select(
        host.alias("host"), F.struct(
            (F.length(host) + F.length(path)).alias("size"), F.length(host).alias("host_size"),
            F.col("action"), F.concat(host, path).alias("rule"), path.alias("path")).alias("one"))
    starts = starts.groupBy("host").agg(F.collect_set("one").alias("rules"))
    key = interval_key(F.col("host"))
    starts = starts.select(
        key.alias("key"), F.lit(0).alias("kind"), "host", F.size(F.split("host", r"\.")).alias("depth"),
        F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")).alias("end"), "rules")
    points = hosts.select(key.alias("key"), F.lit(1).alias("kind"), "host")
    both = points.unionByName(starts, allowMissingColumns=True)
    return both.repartitionByRange("key", "kind").withColumn("range", F.spark_partition_id())


def active_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: the rules of every enclosing rule host, for each of the distinct hosts."""
    folder = shared_folder(hosts.sparkSession)
    events = stored(_events(hosts, rules), folder, "events")
    depths = [r[0] for r in events.where("kind = 0").select("depth").distinct().sort("depth").collect()]
    if not depths:
        return hosts.select("host", F.array().cast(
            "array<struct<size:int,host_size:int,action:string,rule:string,path:string>>").alias("rules"))
    begun = {d: F.when((F.col("kind") == 0) & (F.col("depth") == d), F.struct("end", "rules"))
             for d in depths}
    place = F.struct("key", "kind")
    ends = events.groupBy("range").agg(*[
        F.max_by(begun[d], F.when(begun[d].isNotNull(), place)).alias(f"open_{d}") for d in depths])
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("range", *[F.last(f"open_{d}", ignorenulls=True).over(before)
                                     .alias(f"carried_{d}") for d in depths])
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    swept = events.select("range", "key", "kind", "host", *[
        F.last(begun[d], ignorenulls=True).over(sweep).alias(f"open_{d}") for d in depths])
    stack = F.array(*[F.coalesce(f"open_{d}", f"carried_{d}") for d in depths])
    active = F.filter(stack, lambda x: x.isNotNull() & (x["end"] > F.col("key")))
    return swept.where("kind = 1").join(carried, "range").select(
        "host", F.flatten(F.transform(active, lambda x: x["rules"])).alias("rules"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row; rules: host, path, action."""
    host, path = host_and_path(url_col)
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    found = active_rules(urls.select("host").distinct(), rules).where(F.size("rules") > 0)
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(fits)  # by size, size of the host, action
    return urls.join(found, "host", "left").withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"))
