"""Column expressions shared by the operators. Everything stays inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that count as yes and as no in an offer cell.
TRUE_WORDS = ("1", "1.0", "yes", "y", "true", "t", "accepted", "redeemed")
FALSE_WORDS = ("0", "0.0", "no", "n", "false", "f")
# Fixed value: offer-list delimiters.
DELIMITER_PATTERN = r"\s*[;,|\n]\s*"
# Fixed value: a discount written in an offer name.
DISCOUNT_PATTERN = r"(\d+(?:\.\d+)?)\s*%\s*(?:loyalty\s*)?(?:discount|off)"
# Fixed value: characters that make a spreadsheet read a cell as a formula.
FORMULA_PATTERN = r"^[=+\-@\t\r]"
# What a number looks like; month names by their first three letters.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_CLOCK = r"(?:[ T]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?: ?[zZ]|[+-]\d{2}:?\d{2})?))?$"
#: Shapes of a date, each with the groups that hold year, month and day.
DATE_SHAPES = ((r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", (1, 2, 3)),
               (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})", (3, 1, 2)),
               (r"^(\d{1,2})[ -]([A-Za-z]{3})[a-z]*\.?,?[ -](\d{4})", (3, 2, 1)),
               (r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})", (3, 1, 2)))


def col(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def hash_unit(*parts: Column) -> Column:
    """Uniform number in [0, 1) from the first 64 bits of SHA-256 of the ':'-joined parts."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    head = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return head.cast("double") / F.lit(float(2 ** 64))


def blank_to_null(c: str | Column) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def squeeze(c: str | Column) -> Column:
    """Trimmed text with single inner spaces; blank becomes null."""
    return F.nullif(F.trim(F.regexp_replace(col(c), r"\s+", " ")), F.lit(""))


def to_number(c: str | Column) -> Column:
    """Text to double: trimmed, thousands commas dropped, anything unreadable null (never NaN).
    The engine's own cast would also read suffixes such as 1d."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), ",", "")
    return no_nan(F.when(text.rlike(NUMBER), text.try_cast("double")))


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def to_time(c: str | Column) -> Column:
    """Lenient date parsing: year first, month first (day first where the first number is no month)
    or with the month's name, each with or without a time of day. The shape of the text says where
    the parts are, so a cell is read once and never by trial and error."""
    text = F.trim(col(c).cast("string"))
    names = F.create_map(*[F.lit(x) for k, m in enumerate(MONTHS) for x in (m, f"{k + 1}")])
    out = None
    for shape, (year, month, day) in DATE_SHAPES:
        full = shape + _CLOCK
        y, m, d = (F.regexp_extract(text, full, k) for k in (year, month, day))
        if "A-Z" in shape:
            m = F.coalesce(names[F.lower(m)], F.lit("0"))
        elif year == 3:
            turned = m.cast("int") > 12
            m, d = F.when(turned, d).otherwise(m), F.when(turned, m).otherwise(d)
        iso = F.concat(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")),
                       F.regexp_replace(F.concat(F.lit(" "), F.regexp_extract(text, full, 4)), r" $", ""))
        when = F.when if out is None else out.when
        out = when(text.rlike(full), iso.try_cast("timestamp"))
    return out


def flag(c: str | Column) -> Column:
    """Yes/no cell to 1/0; any other text is null."""
    text = F.lower(squeeze(col(c).cast("string")))
    return F.when(text.isin(*TRUE_WORDS), 1).when(text.isin(*FALSE_WORDS), 0)


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def risk_band(p: Column, high: float = 0.6, medium: float = 0.3) -> Column:
    if not 0 < medium < high < 1:
        raise ValueError("Risk thresholds must satisfy 0 < medium < high < 1.")
    return F.when(p >= high, "High").when(p >= medium, "Medium").otherwise("Low")


# Upper limits of the effect-size words by kind of effect.
EFFECT_LIMITS = {
    "cramers_v": (0.1, 0.3, 0.5),
    "cohens_d": (0.2, 0.5, 0.8),
    "rank_biserial": (0.1, 0.3, 0.5),
}


def effect_band(value: Column, kind: str) -> Column:
    low, mid, high = EFFECT_LIMITS[kind]
    size = F.abs(value)
    return (F.when(value.isNull(), None).when(size < low, "negligible").when(size < mid, "small")
            .when(size < high, "medium").otherwise("large"))


def offer_discount(name: str | Column) -> Column:
    """Discount share named in an offer, null when the name carries none."""
    text = F.regexp_extract(F.lower(col(name)), DISCOUNT_PATTERN, 1)
    return F.nullif(text, F.lit("")).cast("double") / 100


def smoothed(successes: Column, trials: Column, strength: float = 1.0) -> Column:
    return (successes + strength) / (trials + 2 * strength)


def formula_safe(c: str | Column) -> Column:
    return F.when(col(c).rlike(FORMULA_PATTERN), F.concat(F.lit("'"), col(c))).otherwise(col(c))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero or null."""
    return F.when(b != 0, a.cast("double") / b)


def wilson(successes: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Score interval of a proportion."""
    p = successes / n
    denom = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / denom
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / denom
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def median_of(c: str | Column) -> Column:
    return F.percentile(col(c), 0.5)
