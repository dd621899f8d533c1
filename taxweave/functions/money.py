"""Money columns. The core counts in satang (1/100 THB) as long integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxweave.rules import VAT_PERCENT


def whole_div(dividend: Column, divisor: int) -> Column:
    """Integer division that stays in long arithmetic."""
    return F.call_function("div", dividend, F.lit(divisor).cast("long"))


def parse_money(text: Column) -> Column:
    """'THB 1,234.50', '฿1,234.50' or '1234.5' to satang; unreadable text to NULL."""
    plain = F.trim(F.regexp_replace(text, "THB |,|฿", ""))
    return (plain.try_cast("decimal(18,2)") * 100).cast("long")


def vat_inside(amount: Column, percent: int = VAT_PERCENT) -> Column:
    """VAT contained in a price that includes it, to the satang.

    Rounds half away from zero. At 7 % no tie can occur: 14*c is even and
    107*(2k+1) is odd.
    """
    whole = 100 + percent
    size = whole_div(F.abs(amount) * (2 * percent) + whole, 2 * whole)
    return F.when(amount < 0, -size).otherwise(size)


def baht(amount: Column) -> Column:
    return amount / F.lit(100.0)


def millions_label(amount: Column) -> Column:
    """'1.85 M' for satang, rounded half away from zero."""
    hundredths = whole_div(F.abs(amount) + 500_000, 1_000_000)
    sign = F.when((amount < 0) & (hundredths > 0), "-").otherwise("")
    return F.concat(
        sign,
        whole_div(hundredths, 100).cast("string"),
        F.lit("."),
        F.lpad((hundredths % 100).cast("string"), 2, "0"),
        F.lit(" M"),
    )


def grouped_label(amount: Column) -> Column:
    """'1,234.50' for satang."""
    return F.format_number(amount.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)"), 2)
