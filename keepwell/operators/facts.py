"""Results as facts, and checks of claimed numbers against them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepwell.functions.scalar import col

# Tolerances, the number pattern.
REL_TOL, ABS_TOL = 0.01, 0.005
NUMBER_PATTERN = (r"(?i)(?:<\s*|less than\s+)?(?<![A-Za-z0-9_.])[$₹£€]?"
                  r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
                  r"\s*(?:%|×|x\b)?(?![A-Za-z0-9])")
DIGITS_PATTERN = r"(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
IMPACT_SECTION = "impact"


def significant_digits(x: Column, digits: int = 4) -> Column:
    """Value rounded to a number of significant digits."""
    size = F.abs(x)
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(size)))
    return F.when(x.isNull() | (x == 0), x).otherwise(F.bround(x * scale, 0) / scale)


def to_facts(df: DataFrame, section: str, prefix: str, key: Column, values: dict[str, str],
             label: Column | None = None, group: Column | None = None) -> DataFrame:
    """One fact per value column of each result row: section, key, value, label, group_id."""
    name = label if label is not None else key
    rows = F.array(*[F.struct(
        F.concat_ws(".", F.lit(prefix), key, F.lit(path)).alias("key"),
        col(c).cast("double").alias("value"),
        F.concat_ws(": ", name, F.lit(path)).alias("label")) for path, c in values.items()])
    owner = group if group is not None else F.lit(None).cast("string")
    return (df.select(owner.alias("group_id"), F.explode(rows).alias("f"))
            .where(F.col("f.value").isNotNull())
            .select(F.lit(section).alias("section"), "f.key",
                    significant_digits(F.col("f.value")).alias("value"), "f.label", "group_id"))


def facts_table(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def health_facts(health: DataFrame) -> DataFrame:
    return to_facts(health, "data_health", "data_health", F.lit("summary"), {
        c: c for c in ("rows_after", "health_score", "duplicates_removed", "positive_rate")})


def category_facts(rates: DataFrame) -> DataFrame:
    """Rate and size of every level of every column."""
    return to_facts(rates, "churn_by_category", "categorical", F.concat_ws(".", "feature", "level"),
                    {"churn_rate": "churn_rate", "n": "n"},
                    F.concat_ws(" = ", "feature", "level"))


def digest(facts: DataFrame, per_section: int) -> DataFrame:
    """A short list for a reader: of each section the facts of the largest values, as many as the
    caller asks for, and how many the section has. Claims are never checked against it."""
    order = Window.partitionBy("section").orderBy(F.desc(F.abs("value")), "key")
    sizes = facts.groupBy("section").agg(F.count("*").alias("facts_total"))
    top = facts.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_section)
    return top.drop("_k").join(sizes, "section")


def segment_facts(profile: DataFrame) -> DataFrame:
    s = F.col("segment").cast("string")
    return to_facts(profile, "segments", "segments", s,
                    {"size": "size", "churn_rate": "churn_rate", "churn_lift": "lift"}, F.col("label"),
                    F.concat(F.lit("segment_"), s))


def test_facts(tests: DataFrame) -> DataFrame:
    return to_facts(tests, "hypothesis_tests", "tests", F.col("variable"),
                    {"p_adjusted": "p_adjusted", "effect": "effect"})


def model_facts(evaluation: DataFrame, bands: DataFrame) -> DataFrame:
    scores = to_facts(evaluation, "model", "model", F.col("kind"),
                      {"roc_auc": "roc_auc", "pr_auc": "pr_auc", "brier": "brier"})
    return scores.unionByName(to_facts(bands, "model", "bands", F.col("risk_band"), {"n": "n"}))


def driver_facts(drivers: DataFrame) -> DataFrame:
    return to_facts(drivers, "drivers", "drivers", F.col("feature"), {
        c: c for c in ("permutation_rank", "mean_abs", "odds_ratio", "or_ci_lower", "or_ci_upper")})


def survival_facts(summary: DataFrame, logrank: DataFrame | None = None) -> DataFrame:
    out = to_facts(summary, "survival", "survival", F.lit("overall"), {
        "median": "median", "at_6": "s6", "at_12": "s12", "at_24": "s24"})
    if logrank is not None:
        out = out.unionByName(to_facts(logrank, "survival", "survival", F.col("variable"),
                                       {"logrank_p": "p_value"}))
    return out


def impact_facts(items: DataFrame) -> DataFrame:
    """Numbers and savings of every group (`items`: one row per group and scenario). One pass: the
    numbers that scenarios share are the same in each of their rows and are kept once."""
    plain = ("customers", "churners", "churn_rate", "revenue_at_risk")
    wide = items.groupBy("id", "label", *plain).agg(F.collect_list(F.struct(
        "scenario", "churners_saved", "revenue_saved")).alias("saved"))
    own = F.array(*[F.struct(F.lit(c).alias("path"), col(c).cast("double").alias("v")) for c in plain])
    saved = F.flatten(F.transform("saved", lambda x: F.array(*[F.struct(
        F.concat_ws(".", x["scenario"], F.lit(c)).alias("path"), x[c].cast("double").alias("v"))
        for c in ("churners_saved", "revenue_saved")])))
    each = wide.select("id", "label", F.explode(F.concat(own, saved)).alias("f")).where("f.v IS NOT NULL")
    last = F.element_at(F.split("f.path", r"\."), -1)
    return each.select(
        F.lit(IMPACT_SECTION).alias("section"),
        F.concat_ws(".", F.lit("impact"), "id", "f.path").alias("key"),
        significant_digits(F.col("f.v")).alias("value"), F.concat_ws(": ", "label", last).alias("label"),
        F.col("id").alias("group_id"))


def offer_facts(effectiveness: DataFrame) -> DataFrame:
    return to_facts(effectiveness, "offers", "offers", F.col("offer"), {
        "shown": "shown", "acceptance_rate": "acceptance_rate",
        "acceptors.churn_rate": "acceptors_churn_rate",
        "decliners.churn_rate": "decliners_churn_rate"})


def resolve_paths(facts: DataFrame, paths: DataFrame) -> DataFrame:
    """Value behind each requested key (null when nothing was computed)."""
    return paths.select("key").distinct().join(facts.select("key", "value"), "key", "left")


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(ABS_TOL), REL_TOL * F.abs(b))


def matches(claimed: Column, actual: Column) -> Column:
    """Equal within tolerance, also across fraction and percent."""
    return close(claimed, actual) | close(claimed, actual * 100) | close(claimed / 100, actual)


def check_figures(claims: DataFrame, facts: DataFrame, sizes: bool = False) -> DataFrame:
    """Every claim (item, key, claimed) with its problem, null when it holds. With `sizes`, a drop
    may be stated as its magnitude."""
    known = facts.select("key", F.col("value").alias("actual"))
    j = claims.join(known, "key", "left")
    ok = matches(F.col("claimed"), F.col("actual"))
    if sizes:
        ok = ok | ((F.col("actual") < 0) & matches(F.col("claimed"), -F.col("actual")))
    problem = (F.when(F.col("actual").isNull(), "no such fact")
               .when(F.col("claimed").isNull() | ~ok, "value does not match"))
    return j.select("item", "key", "claimed", "actual", problem.alias("problem"))


def numbers_in(texts: DataFrame) -> DataFrame:
    """Standalone numbers of each text: item, number, less_than. Digits glued to letters belong to
    names and are left out."""
    found = F.regexp_extract_all("text", F.lit(NUMBER_PATTERN), F.lit(0))
    each = texts.select("item", F.explode(found).alias("t"))
    digits = F.regexp_replace(F.regexp_extract("t", DIGITS_PATTERN, 1), ",", "")
    lead = F.lower(F.col("t")).startswith("less") | F.col("t").startswith("<")
    return each.select("item", digits.cast("double").alias("number"), lead.alias("less_than"))


def _place(v: Column) -> Column:
    """Cell of a number on a scale that is linear near zero and logarithmic beyond one."""
    far = 100 + F.floor(F.log(F.greatest(F.abs(v), F.lit(1.0))) / 0.01)
    return F.when(F.abs(v) <= 1, F.floor(v / 0.01)).otherwise(
        F.when(v > 0, far).otherwise(-far)).cast("long")


def check_text_numbers(texts: DataFrame, figures: DataFrame) -> DataFrame:
    """Numbers in a text that no declared figure of the same item explains.

    Numbers and figures meet in cells as wide as the tolerance, through an anti join, so an item
    with very many numbers and figures never becomes a table of pairs."""
    numbers = numbers_in(texts).distinct().withColumn("_cell", _place(F.col("number")))
    declared = figures.select("item", F.col("value").cast("double").alias("d")).distinct()
    small = F.greatest(F.lit(ABS_TOL), REL_TOL * F.abs("d"))
    big = F.greatest(F.lit(100 * ABS_TOL), F.abs("d"))
    spans = F.flatten(F.array(
        F.sequence(_place(F.col("d") - small) - 1, _place(F.col("d") + small) + 1),
        F.sequence(_place(F.col("d") * 100 - big) - 1, _place(F.col("d") * 100 + big) + 1)))
    cells = declared.select(F.col("item").alias("_item"), "d",
                            F.explode(F.array_distinct(spans)).alias("_c"))
    left = numbers.join(cells, (numbers["item"] == cells["_item"]) & (numbers["_cell"] == cells["_c"])
                        & matches(numbers["number"], cells["d"]), "left_anti")
    least = declared.groupBy("item").agg(F.min("d").alias("_least"))
    j = left.join(least, "item", "left")
    return j.where(~(F.col("less_than") & F.coalesce(F.col("_least") < F.col("number"),
                                                     F.lit(False)))).select("item", "number")


def check_impact_group(claims: DataFrame, facts: DataFrame) -> DataFrame:
    """Problems of recommendations (item, role 'impact' or 'customers', key): the impact must be an
    impact fact and both must speak of the same group."""
    j = claims.join(facts.select("key", "section", "group_id"), "key", "left")
    impact, people = F.col("role") == "impact", F.col("role") == "customers"
    g = j.groupBy("item").agg(
        F.bool_and(F.when(impact, F.coalesce(F.col("section") == IMPACT_SECTION, F.lit(False))))
        .alias("_from_impact"),
        F.max(F.when(impact, F.col("group_id"))).alias("impact_group"),
        F.max(F.when(people, F.col("group_id"))).alias("customer_group"))
    problem = (F.when(~F.coalesce("_from_impact", F.lit(True)), "impact is not an impact estimate")
               .when(F.col("impact_group") != F.col("customer_group"),
                     "impact and customers are of different groups"))
    return g.select("item", "impact_group", "customer_group", problem.alias("problem"))


def validation_report(items: DataFrame, problems: DataFrame) -> DataFrame:
    bad = problems.select("item").distinct().withColumn("_bad", F.lit(True))
    j = items.select("item").distinct().join(bad, "item", "left")
    return j.agg(F.count("*").alias("checked"), F.count_if(F.col("_bad").isNull()).alias("passed"),
                 F.count("_bad").alias("failed"))


def valid_items(items: DataFrame, problems: DataFrame) -> DataFrame:
    return items.join(problems.select("item"), "item", "left_anti")
