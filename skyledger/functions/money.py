"""Money as whole minor units, and price changes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currencies without minor digits.
WHOLE_CURRENCIES = ("JPY", "KRW")


def decimal_to_minor(major: Column, currency: Column) -> Column:
    """Round a non-negative decimal HALF_UP to minor units of its currency."""
    scale = F.when(currency.isin(*WHOLE_CURRENCIES), F.lit(1)).otherwise(F.lit(100))
    exact = major.cast("decimal(38,18)")
    return F.round(F.when(exact >= 0, exact) * scale.cast("decimal(3,0)"), 0).try_cast("bigint")


def to_minor_units(raw: Column, currency: Column) -> Column:
    """Minor units of a price text such as ``CNY 2,180``; null when not a price."""
    digits = F.regexp_replace(raw, r"[^0-9.\-]", "")
    return decimal_to_minor(digits.try_cast("decimal(38,18)"), currency)


def percent_change(current: Column, previous: Column) -> Column:
    """Change in percent; null without a base or with a zero base."""
    base = F.when(previous != 0, previous.cast("double"))
    return (current.cast("double") - base) / base * F.lit(100.0)


def drop_basis_points(current: Column, previous: Column) -> Column:
    """Drop in 1/100 percent, cut toward zero; 0 without a usable base."""
    base = F.when(previous != 0, previous)
    scaled = ((base - current) * F.lit(10000)).cast("double") / base.cast("double")
    return F.coalesce(scaled.cast("bigint"), F.lit(0).cast("bigint"))


def average(total: Column, count: Column) -> Column:
    """Sum over count as a double; null when the count is 0."""
    return total.cast("double") / F.when(count != 0, count.cast("double"))
