"""Column expressions shared by every builder and mart.

All functions return ``pyspark.sql.Column`` built from JVM-side
functions, so they stay inside whole-stage codegen.  No Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for identical results)
# ---------------------------------------------------------------------------
# Cabin spellings, after trimming and upper-casing, and their cabin class.
CABIN_SPELLINGS: dict[str, str] = {
    "E": "ECONOMY",
    "ECON": "ECONOMY",
    "ECONOMY": "ECONOMY",
    "P": "PREMIUM",
    "PREMIUM": "PREMIUM",
    "PREMIUM ECONOMY": "PREMIUM",
    "B": "BUSINESS",
    "BUS": "BUSINESS",
    "BUSINESS": "BUSINESS",
}
# Loyalty-card values (trimmed, upper-cased) that mark a VIP passenger.
VIP_CARD_VALUES: list[str] = ["Y", "YES", "TRUE", "1", "VIP"]
VIP_LABEL = "VIP"
NON_VIP_LABEL = "Non-VIP"
# Age bands: exclusive upper bound in years and label; last band is open.
AGE_BANDS: list[tuple[int, str]] = [(25, "Under 25"), (35, "25-34"), (50, "35-49"), (65, "50-64")]
AGE_BAND_OPEN = "65+"
AGE_BAND_UNKNOWN = "Unknown"
ROUTE_LABEL_SEPARATOR = " -> "
# Lenient text layouts.  A double is decimal digits with optional
# exponent, or inf/infinity/nan; a timestamp is a date, optionally with
# a space or 'T' and hh:mm:ss plus an optional fraction.
NUMBER_PATTERN = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\z"
# Months, days and hours may have one digit, as they may in the layouts
# %m, %d and %H; minutes and seconds have two.
TIMESTAMP_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}:\d{2}(\.\d{1,9})?)?\z"
# The Unicode White_Space characters, stripped at both ends of text.
WHITESPACE_CHARS = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(numerator: str | Column, denominator: str | Column) -> Column:
    """Null when the denominator is null or zero (EXP1)."""
    return F.try_divide(col(numerator), col(denominator))


def zero_if_null(c: str | Column) -> Column:
    """EXP2: null to 0."""
    return F.coalesce(col(c), F.lit(0.0))


def sum0(c: str | Column) -> Column:
    """Sum of doubles that is 0 (not null) over no non-null value (N7).

    NaN and infinity go into the sum as in any sum of doubles; nothing is
    left out or rounded.
    """
    return F.coalesce(F.sum(col(c)).cast("double"), F.lit(0.0))


def exact_sum(c: str | Column, scale: int = 4) -> Column:
    """Sum that does not depend on the order of rows: an option, not used by
    the marts.  Values are summed as decimals of ``scale`` places; a value
    that this type cannot hold (NaN, infinity, too large) is an error."""
    value = col(c)
    finite = F.when(
        F.isnan(value) | (F.abs(value) == float("inf")),
        F.raise_error(F.lit("exact_sum: a value is not finite")).cast(f"decimal(30,{scale})"),
    ).otherwise(value.cast(f"decimal(30,{scale})"))
    return F.sum(finite)


def strip_whitespace(c: str | Column) -> Column:
    """Remove Unicode white space at both ends (N1); plain F.trim keeps tabs.

    ``btrim`` with an explicit character set is a codegen'd scan of the
    string ends, cheaper than a regular expression per row.
    """
    return F.btrim(col(c), F.lit(WHITESPACE_CHARS))


def lenient_double(c: str | Column) -> Column:
    """Text to double; anything that is not a plain number becomes null (N2)."""
    text = col(c).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def lenient_timestamp(c: str | Column) -> Column:
    """Text in one of the five layouts to timestamp_ntz, else null (N3)."""
    text = col(c)
    return F.when(text.rlike(TIMESTAMP_PATTERN), text.try_cast("timestamp_ntz"))


def utc_wall_time(c: str | Column) -> Column:
    """Zoned timestamp to its wall time in UTC, whatever the session's zone."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), col(c).cast("timestamp_ntz"))


def cabin_class(c: str | Column) -> Column:
    """EXP7: nine spellings to three classes, other values upper-cased."""
    key = F.upper(strip_whitespace(col(c).cast("string")))
    expr = None
    for spelling_class in ("ECONOMY", "PREMIUM", "BUSINESS"):
        spellings = [k for k, v in CABIN_SPELLINGS.items() if v == spelling_class]
        cond = key.isin(spellings)
        expr = F.when(cond, F.lit(spelling_class)) if expr is None else expr.when(cond, F.lit(spelling_class))
    return expr.otherwise(key)


def age_band(age: str | Column) -> Column:
    """EXP13: difference of years to a band; null age is Unknown."""
    a = col(age)
    expr = None
    for upper, label in AGE_BANDS:
        expr = F.when(a < upper, F.lit(label)) if expr is None else expr.when(a < upper, F.lit(label))
    return expr.when(a.isNotNull(), F.lit(AGE_BAND_OPEN)).otherwise(F.lit(AGE_BAND_UNKNOWN))


def vip_segment(card: str | Column) -> Column:
    """EXP14: VIP when the trimmed upper card value is a VIP marker."""
    key = F.upper(strip_whitespace(col(card).cast("string")))
    return F.when(key.isin(VIP_CARD_VALUES), F.lit(VIP_LABEL)).otherwise(F.lit(NON_VIP_LABEL))


def year_month(c: str | Column) -> Column:
    """EXP11: 'yyyy-MM' text of a timestamp."""
    return F.date_format(col(c), "yyyy-MM")


def distinct_count_with_null(c: str | Column) -> Column:
    """Distinct count that counts null as one more value (N8)."""
    x = col(c)
    has_null = F.coalesce(F.max(F.when(x.isNull(), F.lit(1)).otherwise(F.lit(0))), F.lit(0))
    return F.count_distinct(x) + has_null


def route_label(origin_city: Column, origin: Column, dest_city: Column, dest: Column) -> Column:
    """City (or code when the city is null) of both ends; null if both are null."""
    return F.concat(
        F.coalesce(origin_city, origin), F.lit(ROUTE_LABEL_SEPARATOR), F.coalesce(dest_city, dest)
    )


def thousands_text(c: str | Column, decimals: int = 0) -> Column:
    """EXP19: number with thousands separators, half-even like Python's
    format (money and counts: 0 decimals; yields: 2)."""
    return F.format_number(col(c).cast("double"), decimals)


def percent_text(c: str | Column) -> Column:
    """EXP19: share as percent with one decimal and no grouping ("12.3%")."""
    scaled = col(c).cast("double") * 100
    return F.concat(F.call_function("format_number", scaled, F.lit("0.0")), F.lit("%"))
