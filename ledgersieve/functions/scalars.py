"""Scalar functions on columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.config import RoundTier, ScreenConfig

MICROS_PER_DAY = 86_400_000_000
# Printable ASCII words with single blanks between them
PLAIN_NAME = "^[!-~]++(?: [!-~]++)*+$"


def rint_to(value: Column, places: int) -> Column:
    """Round half to even on the binary value, as numpy does."""
    scale = 10.0**places
    return F.rint(value * scale) / scale


def money(value: Column) -> Column:
    """Fixed-point form for sums, so that totals do not depend on row order.

    Null from 10^24 on; see ``total``.
    """
    return value.try_cast("decimal(28,4)")


def total(value: Column) -> Column:
    """Sum, 0 when there is nothing to add, of amounts rounded to four places.

    Amounts up to 10^24 are added in fixed point, whatever their order. Larger ones are
    added as they are, rounded to twelve significant digits, since their last digits
    would depend on the order.
    """
    fixed = F.coalesce(F.sum(money(value)).cast("double"), F.lit(0.0))
    huge = F.sum(F.when(money(value).isNull(), value))
    digits = F.expr("12") - F.ceil(F.log10(F.abs(huge))).cast("int")
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    rounded = F.when(F.abs(huge) < 1e300, F.rint(huge * scale) / scale).otherwise(huge)
    return F.when(huge.isNull() | (huge == 0), fixed).otherwise(fixed + rounded)


def leading_digit(amount: Column) -> Column:
    """First significant digit, sign ignored; null for zero and for missing."""
    # The shortest decimal text of a double starts with its significant digits
    # once zeros and the point are stripped, also in exponent form.
    digits = F.ltrim(F.abs(amount).cast("string"), F.lit("0."))
    return F.when(amount != 0, F.substring(digits, 1, 1).try_cast("int"))


def expected_share(digit: int) -> float:
    return math.log10(1 + 1 / digit)


def conformity_label(mad: Column) -> Column:
    chain = F.when(mad.isNull(), F.lit(None).cast("string"))
    for bound, label in fv.CONFORMITY_BOUNDS:
        chain = chain.when(mad < bound, label)
    return chain.otherwise(fv.NONCONFORMITY)


def roundness_tier(amount: Column, tiers: Sequence[RoundTier]) -> Column:
    """Label of the highest tier the amount is a multiple of, else null."""
    size = F.abs(amount)
    chain = F.lit(None).cast("string")
    for tier in sorted(tiers, key=lambda t: t.multiple):
        chain = F.when(
            (size >= tier.multiple) & (size % F.lit(float(tier.multiple)) == 0), tier.label
        ).otherwise(chain)
    return chain


def normalised_name(name: Column) -> Column:
    """Case-folded name with single blanks; '' for missing."""
    text = name.cast("string")
    lowered = F.lower(text)
    folded = F.replace(F.translate(lowered, *fv.FOLDED_LETTERS), F.lit(fv.SHARP_S), F.lit("ss"))
    blanked = F.trim(F.regexp_replace(folded, r"(?U)[\s\x1c-\x1f]+", " "))
    # Most names need no more than lower case, which one search tells. The check is kept
    # short: a long one swells the generated code of the pass it is part of.
    return F.coalesce(F.when(text.rlike(PLAIN_NAME), lowered).otherwise(blanked), F.lit(""))


def is_weekend(date: Column) -> Column:
    return F.weekday(date) >= 5


def is_after_hours(date: Column, cfg: ScreenConfig) -> Column:
    hour = F.hour(date)
    return (hour < cfg.business_start_hour) | (hour >= cfg.business_end_hour)


def clock_micros(date: Column) -> Column:
    """Microseconds since 1970-01-01 of the wall clock, with or without a zone."""
    seconds = F.hour(date) * 3600 + F.minute(date) * 60 + F.second(date)
    # zones differ by whole seconds, and a decimal for each row would take longer than all the rest
    fine = F.pmod(F.unix_micros(date.cast("timestamp")), F.lit(1_000_000))
    return F.unix_date(date.cast("date")).cast("long") * MICROS_PER_DAY + (
        seconds.cast("long") * 1_000_000 + fine
    )


def month_bucket(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def risk_rating(score: Column) -> Column:
    lowest = fv.RATING_BOUNDS[-1][1]
    chain = F.when(F.lit(False), lowest)
    for bound, label in fv.RATING_BOUNDS:
        chain = chain.when(score >= bound, label)
    return chain.otherwise(lowest)


def percent_text(share: Column) -> Column:
    return F.concat(F.rint(share * 100).cast("int").cast("string"), F.lit("%"))


def float_text(value: Column) -> Column:
    """Decimal text without an exponent where the magnitude allows it."""
    plain = value.cast("string")
    size = F.abs(value)
    expanded = F.rtrim(plain.cast("decimal(38,21)").cast("string"), F.lit("0"))
    expanded = F.when(expanded.endswith("."), F.concat(expanded, F.lit("0"))).otherwise(expanded)
    needs = plain.contains("E") & (size >= 1e-4) & (size < 1e16)
    return F.when(needs, expanded).otherwise(plain)
