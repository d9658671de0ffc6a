"""Cleaning: types, spellings, duplicates, target, faults, health. Each step is a small plan."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepwell.functions.quantiles import quantiles
from keepwell.functions.scalar import col, half_even, no_nan, squeeze, to_number, to_time
from keepwell.roles import Roles

# Cleaning limits.
UNKNOWN = "Unknown"
IQR_FACTOR = 1.5
Z_LIMIT = 3.0
NEGATIVE_SHARE = 0.005
SIGNED_NAME = (r"(?i)change|chg|delta|diff|pct|percent|growth|balance|trend|gap|score|sentiment|net")


class CleaningError(ValueError):
    """The table cannot be analysed."""


def tall(df: DataFrame, exprs: dict[str, Column], names: tuple[str, str] = ("column", "value"),
         keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, column) without a shuffle."""
    pairs = F.array(*[F.struct(F.lit(c).alias(names[0]), e.alias(names[1]))
                      for c, e in exprs.items()])
    return (df.select(*map(col, keep), F.explode(pairs).alias("_p"))
            .select(*map(col, keep), f"_p.{names[0]}", f"_p.{names[1]}"))


def spread(wide: DataFrame, groups: dict[str, dict[str, str]], key: str = "column") -> DataFrame:
    """Turn one wide aggregate row into one row per group: {group: {output: wide column}}."""
    rows = F.array(*[F.struct(F.lit(g).alias(key), *[col(c).alias(o) for o, c in outs.items()])
                     for g, outs in groups.items()])
    fields = next(iter(groups.values()))
    return wide.select(F.explode(rows).alias("_r")).select(f"_r.{key}", *[f"_r.{o}" for o in fields])


def numeric_issues(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: blank cells and cells that are no number."""
    aggs, groups = [], {}
    for i, c in enumerate(columns):
        text = F.regexp_replace(F.trim(col(c)), ",", "")
        aggs += [F.count_if(text == "").alias(f"_b{i}"),
                 F.count_if((text != "") & to_number(c).isNull()).alias(f"_u{i}")]
        groups[c] = {"blanks": f"_b{i}", "unparseable": f"_u{i}"}
    return spread(df.agg(*aggs), groups)


def date_issues(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs, groups = [], {}
    for i, c in enumerate(columns):
        aggs.append(F.count_if(col(c).isNotNull() & to_time(c).isNull()).alias(f"_d{i}"))
        groups[c] = {"unparseable": f"_d{i}"}
    return spread(df.agg(*aggs), groups)


def spelling_changes(df: DataFrame, column: str) -> DataFrame:
    """Spellings to replace: spelling, canonical (the most frequent of those equal but for case,
    the first in order on a tie) and the cells each replacement touches."""
    counts = (df.select(squeeze(column).alias("spelling")).where("spelling is not null")
              .groupBy("spelling").agg(F.count("*").alias("n")))
    best = counts.groupBy(F.lower("spelling").alias("_k")).agg(
        F.min(F.struct((-F.col("n")).alias("rank"), "spelling")).alias("_b"), F.count("*").alias("_c"))
    best = best.where(F.col("_c") > 1).select("_k", F.col("_b.spelling").alias("canonical"))
    return (counts.join(best, F.lower(counts["spelling"]) == best["_k"])
            .where(F.col("spelling") != F.col("canonical")).select("spelling", "canonical", "n"))


def unify_case(df: DataFrame, column: str) -> DataFrame:
    """Squeezed text with case variants merged. Only the variants are joined, so a hot level that
    is already canonical never meets a matching key."""
    changes = spelling_changes(df, column).select("spelling", "canonical")
    source = df.withColumn(column, squeeze(column))
    joined = source.join(changes, source[column] == changes["spelling"], "left")
    return joined.select(*[F.coalesce(changes["canonical"], source[column]).alias(c)
                           if c == column else source[c] for c in source.columns])


def whitespace_changes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    aggs = [F.count_if(col(c) != squeeze(c)).alias(f"_w{i}") for i, c in enumerate(columns)]
    return spread(df.agg(*aggs), {c: {"rows_affected": f"_w{i}"} for i, c in enumerate(columns)})


def drop_exact_duplicates(df: DataFrame, row_id: str) -> DataFrame:
    """First copy of every fully equal row (combined before the shuffle, so copies cost nothing)."""
    data = [c for c in df.columns if c != row_id]
    return (df.groupBy(*map(col, data)).agg(F.min(col(row_id)).alias(row_id))
            .select(*map(col, df.columns)))


def duplicate_rows(df: DataFrame, row_id: str) -> DataFrame:
    data = [c for c in df.columns if c != row_id]
    return (df.groupBy(*map(col, data)).agg(F.count("*").alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")))


def shared_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Rows whose id occurs more than once."""
    return (df.groupBy(col(id_column)).agg(F.count("*").alias("_n")).where("_n > 1")
            .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_affected")))


def target_value(column: str, positive: str) -> Column:
    text = F.trim(col(column).cast("string"))
    return F.when(text == positive, 1).when(text != "", 0)


def map_target(df: DataFrame, column: str, positive: str) -> DataFrame:
    """0/1 outcome; rows without an outcome are dropped."""
    return df.withColumn(column, target_value(column, positive)).where(col(column).isNotNull())


def negative_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: negatives, filled cells and whether the negatives count as faults."""
    aggs, groups = [], {}
    for i, c in enumerate(columns):
        aggs += [F.count_if(col(c) < 0).alias(f"_n{i}"), F.count(col(c)).alias(f"_f{i}")]
        groups[c] = {"negatives": f"_n{i}", "filled": f"_f{i}"}
    out = spread(df.agg(*aggs), groups)
    share = F.col("negatives") / F.nullif(F.col("filled"), F.lit(0))
    fault = ~F.col("column").rlike(SIGNED_NAME) & (share > 0) & (share <= NEGATIVE_SHARE)
    return out.withColumn("invalid", F.coalesce(fault, F.lit(False)))


def null_invalid_negatives(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    bad = [r["column"] for r in negative_shares(df, columns).where("invalid").collect()]
    return df.withColumns({c: F.when(col(c) >= 0, col(c)) for c in bad}) if bad else df, bad


@dataclass(frozen=True)
class Limits:
    low: float | None
    high: float | None
    mean: float | None
    sd: float | None


def outlier_limits(df: DataFrame, columns: Sequence[str]) -> dict[str, Limits]:
    """Fences and moments per column (a few numbers each). Columns with fewer than four values or
    three distinct ones have none."""
    aggs = []
    for i, c in enumerate(columns):
        v = col(c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"),
                 F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    q = {r["variable"]: r["q"] for r in quantiles(df, columns, [0.25, 0.75]).collect()}
    # A third distinct value exists when something lies strictly between the two ends.
    inner = df.agg(*[F.bool_or((col(c) > row[f"lo{i}"]) & (col(c) < row[f"hi{i}"])).alias(f"x{i}")
                     if row[f"n{i}"] else F.lit(False).alias(f"x{i}")
                     for i, c in enumerate(columns)]).first()
    out = {}
    for i, c in enumerate(columns):
        if row[f"n{i}"] < 4 or not inner[f"x{i}"]:
            out[c] = Limits(None, None, None, None)
            continue
        q1, q3 = q[c]
        reach = IQR_FACTOR * (q3 - q1)
        sd = row[f"s{i}"]
        out[c] = Limits(q1 - reach, q3 + reach, row[f"m{i}"], sd if sd else None)
    return out


def outlier_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds <column>_iqr and <column>_z flags; values are never changed."""
    added = {}
    for c, lim in outlier_limits(df, columns).items():
        v = col(c)
        fence = (v < lim.low) | (v > lim.high) if lim.low is not None else F.lit(False)
        far = F.abs(v - lim.mean) / lim.sd > Z_LIMIT if lim.sd else F.lit(False)
        added[f"{c}_iqr"] = F.coalesce(fence, F.lit(False))
        added[f"{c}_z"] = F.coalesce(far, F.lit(False))
    return df.withColumns(added)


def outlier_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    flagged = outlier_flags(df, columns)
    aggs, groups = [F.count("*").alias("_rows")], {}
    for i, c in enumerate(columns):
        a, b = col(f"{c}_iqr"), col(f"{c}_z")
        aggs += [F.count_if(a).alias(f"_i{i}"), F.count_if(b).alias(f"_z{i}"),
                 F.count_if(a | b).alias(f"_e{i}")]
        groups[c] = {"iqr": f"_i{i}", "zscore": f"_z{i}", "either": f"_e{i}", "rows": "_rows"}
    out = spread(flagged.agg(*aggs), groups)
    return out.select("column", "iqr", "zscore", "either",
                      F.try_divide(F.col("iqr"), F.col("rows")).alias("iqr_share"))


def fill_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(col(c), F.lit(UNKNOWN)) for c in columns})


def missing_report(df: DataFrame, columns: Sequence[str], name: str = "missing_pct") -> DataFrame:
    aggs = [F.round(100 * F.avg(col(c).isNull().cast("int")), 2).alias(f"_m{i}")
            for i, c in enumerate(columns)]
    return spread(df.agg(*aggs), {c: {name: f"_m{i}"} for i, c in enumerate(columns)})


def class_balance(df: DataFrame, target: str) -> DataFrame:
    t = col(target)
    return df.agg(F.count_if(t == 1).alias("positive"), F.count_if(t == 0).alias("negative"),
                  half_even(F.avg(t), 4).alias("positive_rate"))


def health_score(missing_pct: Column, duplicates: Column, rows_before: Column,
                 outlier_share: Column, minority: Column) -> Column:
    """0-100 score: mean missing percent, duplicate rows, mean outlier share, minority share."""
    m = F.coalesce(missing_pct, F.lit(0.0)) / 100
    d = F.least(F.lit(1.0), F.coalesce(F.try_divide(10.0 * duplicates, rows_before), F.lit(0.0)))
    o = F.least(F.lit(1.0), 5 * F.coalesce(outlier_share, F.lit(0.0)))
    b = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 - minority) / 0.45)
    raw = 100 - 40 * m - 20 * d - 20 * o - 20 * b
    return half_even(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw)), 0).cast("int")


@dataclass
class Cleaned:
    frame: DataFrame
    log: DataFrame
    health: DataFrame
    kept: DataFrame | None = None

    def release(self) -> None:
        """Give back the executors' copy once the cleaned table is stored."""
        if self.kept is not None:
            self.kept.unpersist()


def all_spelling_changes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spelling replacements of every (already squeezed) text column from one count: column,
    spelling, canonical, n."""
    counts = (tall(df, {c: col(c) for c in columns}, ("column", "spelling"))
              .where("spelling is not null").groupBy("column", "spelling")
              .agg(F.count("*").alias("n")))
    best = counts.groupBy(F.col("column").alias("_c"), F.lower("spelling").alias("_k")).agg(
        F.min(F.struct((-F.col("n")).alias("rank"), "spelling")).alias("_b"),
        F.count("*").alias("_n"))
    best = best.where("_n > 1").select("_c", "_k", F.col("_b.spelling").alias("canonical"))
    joined = counts.join(best, (counts["column"] == best["_c"])
                         & (F.lower(counts["spelling"]) == best["_k"]))
    return joined.where(F.col("spelling") != F.col("canonical")).select(
        "column", "spelling", "canonical", "n")


def apply_spellings(df: DataFrame, changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace spellings column by column; each column meets only its own few variants."""
    out = df
    for c in columns:
        mine = changes.where(F.col("column") == c).select(
            F.col("spelling").alias("_spelling"), F.col("canonical").alias("_canonical"))
        joined = out.join(mine, out[c] == mine["_spelling"], "left")
        out = joined.select(*[F.coalesce(mine["_canonical"], out[x]).alias(x) if x == c else out[x]
                              for x in out.columns])
    return out


def clean(df: DataFrame, roles: Roles, row_id: str, min_rows: int = 100) -> Cleaned:
    """The whole cleaning pass. `df` carries an explicit row number.

    The input is scanned three times: for the counts of faults, for the spellings, and for the
    deduplicated table, which is kept on the executors for the checks that follow."""
    spark = df.sparkSession
    columns = [c for c in df.columns if c != row_id]
    if roles.target not in columns:
        raise CleaningError(f"Target column '{roles.target}' is missing from the data.")
    others = [c for c in columns if c != roles.target]
    is_text = {c: df.schema[c].dataType.typeName() == "string" for c in columns}
    words = [c for c in others if is_text[c]
             and roles.kind(c) in ("categorical", "binary", "text", "id")]
    numeric = [c for c in others if roles.kind(c) == "numeric"]
    as_text = [c for c in numeric if is_text[c]]
    dates = [c for c in others if roles.kind(c) == "datetime"]
    offers = set(roles.offers.columns()) if roles.offers else set()
    log: list[tuple[str, str | None, int, str]] = []

    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count_if(col(c).isNull()).alias(f"miss{i}"))
    for i, c in enumerate(as_text):
        text = F.regexp_replace(F.trim(col(c)), ",", "")
        aggs += [F.count_if(text == "").alias(f"blank{i}"),
                 F.count_if((text != "") & to_number(c).isNull()).alias(f"bad{i}")]
    for i, c in enumerate(dates):
        aggs.append(F.count_if(col(c).isNotNull() & to_time(c).isNull()).alias(f"date{i}"))
    for i, c in enumerate(words):
        aggs.append(F.count_if(col(c) != squeeze(c)).alias(f"space{i}"))
    raw = df.agg(*aggs).first()
    for i, c in enumerate(as_text):
        log += [("blank_to_missing", c, raw[f"blank{i}"], "Blank text became missing."),
                ("coerce_numeric", c, raw[f"bad{i}"], "Text that is no number became missing.")]
    for i, c in enumerate(dates):
        log.append(("coerce_datetime", c, raw[f"date{i}"], "Unreadable dates became missing."))
    for i, c in enumerate(words):
        log.append(("trim_whitespace", c, raw[f"space{i}"], "Trimmed or collapsed spaces."))

    typed = df.withColumns({
        **{c: to_number(c) for c in as_text}, **{c: to_time(c) for c in dates},
        **{c: squeeze(c) for c in words},
        **{c: no_nan(col(c)) for c in numeric
           if df.schema[c].dataType.typeName() in ("float", "double")}})
    if words:
        changes = all_spelling_changes(typed, words)
        touched = {r["column"]: r["n"] for r in
                   changes.groupBy("column").agg(F.sum("n").alias("n")).collect()}
        log += [("unify_case", c, n, "Merged spellings that differ only in case.")
                for c, n in touched.items()]
        typed = apply_spellings(typed, changes, sorted(touched))
    grouped = typed.groupBy(*map(col, columns)).agg(F.min(col(row_id)).alias(row_id),
                                                    F.count("*").alias("_copies"))
    ids = [c for c in roles.ids if c in columns]
    if not ids:
        grouped = typed.withColumn("_copies", F.lit(1).cast("long"))
    value = target_value(roles.target, str(roles.positive))
    marked = grouped.withColumn(roles.target, value).persist()

    t = col(roles.target)
    aggs = [F.sum("_copies").alias("before"), F.count("*").alias("unique"),
            F.count_if(t.isNull()).alias("lost"), F.count_if(t == 1).alias("positive"),
            F.count_if(t == 0).alias("negative")]
    known = t.isNotNull()
    for i, c in enumerate(numeric):
        aggs += [F.count_if(known & (col(c) < 0)).alias(f"neg{i}"),
                 F.count_if(known & col(c).isNotNull()).alias(f"filled{i}")]
    fill = [c for c in words if roles.kind(c) in ("categorical", "binary")
            and c != roles.time and c not in offers]
    for i, c in enumerate(fill):
        aggs.append(F.count_if(known & col(c).isNull()).alias(f"gap{i}"))
    seen = marked.agg(*aggs).first()
    dups = seen["before"] - seen["unique"]
    if ids:
        log.append(("drop_duplicates", None, dups, "Removed exact copies of rows."))
        for c in ids:
            log.append(("duplicate_ids", c, shared_ids(marked, c).first()[0],
                        "Rows share an id but differ elsewhere; kept."))
    else:
        log.append(("possible_duplicates", None, duplicate_rows(typed, row_id).first()[0],
                    "Equal rows kept: without an id they may be different customers."))
    total = seen["positive"] + seen["negative"]
    log += [("drop_missing_target", roles.target, seen["lost"],
             "Removed rows without a target value."),
            ("map_target", roles.target, total,
             "Mapped the positive label to 1 and the other value to 0.")]
    kept = marked.where(known).drop("_copies")
    faulty = [c for i, c in enumerate(numeric) if seen[f"neg{i}"] and not re.search(SIGNED_NAME, c)
              and seen[f"neg{i}"] / seen[f"filled{i}"] <= NEGATIVE_SHARE]
    kept = kept.withColumns({c: F.when(col(c) >= 0, col(c)) for c in faulty}) if faulty else kept
    shares: list[float] = []
    flagged = ({r["column"]: r for r in outlier_counts(kept, numeric).collect()}
               if numeric and total else {})
    for i, c in enumerate(numeric):
        if c in faulty:
            log.append(("invalid_negative", c, seen[f"neg{i}"],
                        "Negatives in a never-negative column became missing."))
        if c in flagged:
            log.append(("flag_outliers", c, flagged[c]["either"], "Flagged, not changed."))
            shares.append(flagged[c]["iqr_share"])
        gone = total - seen[f"filled{i}"] + (seen[f"neg{i}"] if c in faulty else 0)
        log.append(("missing_left_for_model", c, gone,
                    "Left missing; the model fills the training median."))
    log += [("fill_unknown", c, seen[f"gap{i}"], f"Missing values became '{UNKNOWN}'.")
            for i, c in enumerate(fill)]
    frame = fill_unknown(kept, fill) if fill else kept

    if total < min_rows:
        raise CleaningError(f"Only {total} rows remain after cleaning; at least {min_rows} are "
                            "needed.")
    if not seen["positive"] or not seen["negative"]:
        raise CleaningError(f"The target '{roles.target}' has one class after cleaning.")
    missing = [round(100 * raw[f"miss{i}"] / raw["rows"], 2) for i in range(len(columns))]
    removed = dups if ids else 0
    row = (raw["rows"], total, removed, seen["positive"] / total,
           min(seen["positive"], seen["negative"]) / total, sum(missing) / len(missing),
           sum(shares) / len(shares) if shares else 0.0)
    facts = spark.createDataFrame([row], "rows_before long, rows_after long, duplicates_removed "
                                  "long, rate double, minority double, missing double, far double")
    health = facts.select("rows_before", "rows_after", "duplicates_removed",
                          half_even(F.col("rate"), 4).alias("positive_rate"),
                          health_score(F.col("missing"), F.col("duplicates_removed"),
                                       F.col("rows_before"), F.col("far"),
                                       F.col("minority")).alias("health_score"))
    table = spark.createDataFrame([x for x in log if x[2]],
                                  "step string, column string, rows_affected long, detail string")
    return Cleaned(frame, table, health, marked)
