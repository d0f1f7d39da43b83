"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fact_value(text: Column, scale: Column, sign: Column) -> Column:
    """Digits and points of the text, times ten to the scale, negated by a ``-`` sign; null without digits."""
    digits = F.regexp_replace(text, "[^0-9.]", "")
    lead = F.regexp_extract(digits, r"^(\d*\.?\d*)", 1)
    value = lead.try_cast("double") * F.pow(F.lit(10.0), F.coalesce(scale.try_cast("int"), F.lit(0)))
    return F.when(sign == "-", -value).otherwise(value)


def year_on_year(current: Column, prior: Column) -> Column:
    return F.try_divide(current - prior, F.nullif(F.abs(prior), F.lit(0.0)))


def percent(n: Column, total: Column) -> Column:
    """Whole percents, halves up; 0 of nothing."""
    return F.when(total == 0, F.lit(0)).otherwise(F.floor(n * 100.0 / total + 0.5)).cast("bigint")


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, held within -1 and 1."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + F.coalesce(x, F.lit(0.0)))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


#: Steps of compact numbers, and signs of currencies (fixed values).
STEPS = [(1e12, "T", 2), (1e9, "B", 2), (1e6, "M", 1), (1e3, "K", 1)]
SIGNS = {"USD": "$", "EUR": "€", "GBP": "£", "JPY": "¥", "CNY": "CN¥"}


def compact(size: Column, digits: int) -> Column:
    """A size without its sign as ``1.25B``, ``3.4M``; below a thousand with so many digits."""
    plain = F.format_string(f"%.{digits}f", size)
    return F.coalesce(*[F.when(size >= least, F.concat(F.format_string(f"%.{n}f", size / least), F.lit(mark))) for least, mark, n in STEPS], plain)


def currency_sign(code: Column) -> Column:
    """What stands before an amount; dollars without a code, a code without a sign as it is."""
    return F.coalesce(*[F.when(code == c, F.lit(sign)) for c, sign in SIGNS.items()], F.concat(code, F.lit(" ")), F.lit("$"))


def money(value: Column, prefix: str | Column = "$") -> Column:
    """Compact amounts for reports: ``$1.25B``, ``$3.4M``."""
    before = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(F.when(value < 0, "-").otherwise(""), before, compact(F.abs(value), 2))


def value_text(value: Column, unit: Column, currency: Column) -> Column:
    """A value as its unit wants it shown: an amount, one for each share, a number of shares, a share of one; else as it is."""
    sign = currency_sign(currency)
    return (
        F.when(unit == "USD", money(value, sign)).when(unit == "USD/shares", F.concat(sign, F.format_string("%.2f", value)))
        .when(unit == "shares", compact(F.abs(value), 0)).when(unit == "pure", F.format_string("%.1f%%", value * 100)).otherwise(value.cast("string"))
    )


def signed_percent(change: Column) -> Column:
    return F.concat(F.when(change > 0, "+").otherwise(""), F.format_string("%.1f%%", change * 100))
