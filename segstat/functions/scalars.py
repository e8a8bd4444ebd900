"""Column expressions: tolerant numbers, recodes, text helpers, portable hashing."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the numeric code that means "missing" in the source tables.
SENTINEL = 9999.0

# Cluster identifiers that count as missing.
MISSING_IDS = ("", "9999", "nan", "None")

DOUBLE_MAX = 1.7976931348623157e308


def finite(value: Column) -> Column:
    """NULL, NaN and infinities are not finite."""
    return F.coalesce(value.between(-DOUBLE_MAX, DOUBLE_MAX), F.lit(False))


def as_double(value: Column) -> Column:
    return value.try_cast("double")


def numeric_or_null(value: Column) -> Column:
    """Non-numeric, non-finite and sentinel values become NULL."""
    number = as_double(value)
    return F.when(finite(number) & (number != SENTINEL), number)


def number_error(token: Column) -> Column:
    """Why a token is not a strict finite number; NULL when it is one."""
    text = F.lower(F.trim(token.cast("string")))
    number = as_double(token.cast("string"))
    return (
        F.when(token.isNull() | (text == ""), F.lit("blank"))
        .when(text.isin("true", "false"), F.lit("boolean"))
        .when(number.isNull(), F.lit("not_numeric"))
        .when(~finite(number), F.lit("not_finite"))
    )


def strict_double(token: Column) -> Column:
    """The token as double, only where ``number_error`` is NULL."""
    return F.when(number_error(token).isNull(), as_double(token.cast("string")))


def flag(value: Column) -> Column:
    """'true'/'False'/booleans to boolean; anything else NULL."""
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text == "true", F.lit(True)).when(text == "false", F.lit(False))


def site_of(code: Column) -> Column:
    """Provenance code: the text before the first underscore."""
    return F.trim(F.substring_index(code, "_", 1))


def valid_cluster(value: Column) -> Column:
    return value.isNotNull() & ~F.trim(value.cast("string")).isin(*MISSING_IDS)


def yes_no(value: Column) -> Column:
    """1 = yes, 2 = no to 1/0; other codes NULL."""
    return F.when(value == 1, F.lit(1)).when(value == 2, F.lit(0)).cast("int")


def presence(count: Column) -> Column:
    """A non-negative count to presence; negative counts NULL."""
    return F.when(count > 0, F.lit(1)).when(count == 0, F.lit(0)).cast("int")


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))


def logit(p: Column, floor: float = 1e-6) -> Column:
    bounded = clip(p, floor, 1 - floor)
    return F.log(bounded / (1 - bounded))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in doubles with NULL for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def keyed_md5(seed: int | Column, *parts: Column) -> Column:
    """md5 of 'seed|part|...' as hex text; the same in every SQL engine."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", head, *[p.cast("string") for p in parts]))


def hash_below(digest: Column, bound: Column) -> Column:
    """An integer in [0, bound) from the first 12 hex digits of a digest."""
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint"), bound)


def r6(value: Column) -> Column:
    """Rounding to 6 decimals, for results compared across engines."""
    return F.round(value.cast("double"), 6)


def correlation(n: Column, sa: Column, sb: Column, saa: Column, sbb: Column, sab: Column) -> Column:
    """Pearson correlation from sums; 0 when a side is constant or n < 2."""
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    # Sums of equal values leave rounding dust, so "constant" is judged relative to the sums.
    constant = (va <= F.abs(saa) * 1e-12) | (vb <= F.abs(sbb) * 1e-12)
    return F.when((n < 2) | constant, F.lit(0.0)).otherwise(
        F.try_divide(sab - sa * sb / n, F.sqrt(F.greatest(va, F.lit(0.0)) * F.greatest(vb, F.lit(0.0)))))
