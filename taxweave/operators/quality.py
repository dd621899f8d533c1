"""Findings about order exports. Each returns a table and stops nothing.

Lines are first reduced to counts per source and period by a hash aggregate,
which combines before the shuffle; lists of years are built from those counts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxweave.functions import calendar
from taxweave.operators.lines import SOURCE, is_open, per_platform
from taxweave.session import settle


def profile(lines: DataFrame) -> DataFrame:
    """Lines counted by source, month, order and status, with the gaps among them.

    All findings can be made from it in place of the lines, so that they are read once.
    """
    return lines.groupBy(*SOURCE, "year", "month", "order_no", "status").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(name) for name, c in GAPS.items()]
    )


GAPS = {"no_amount": "item_c", "no_discount": "disc_c", "no_shipping": "ship_c"}


def _rows_per_period(lines: DataFrame) -> DataFrame:
    rows = F.sum("rows") if "rows" in lines.columns else F.count(F.lit(1))
    return lines.groupBy(*SOURCE, "year", "month").agg(rows.alias("rows"))


def _rows_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("rows")).otherwise(0))


def _years_text(condition: Column) -> Column:
    return F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("year").cast("string")))), ", ")


def incomplete_orders(lines: DataFrame, by=("year", "month")) -> DataFrame:
    """Per source and period: distinct orders not completed yet, and distinct
    statuses among them (an unknown status counts as one).

    Lines are made distinct first, so that counting two columns at once
    multiplies orders and not lines.
    """
    return (
        lines.filter(is_open())
        .select(*SOURCE, *by, "order_no", F.coalesce("status", F.lit("")).alias("status"))
        .distinct()
        .groupBy(*SOURCE, *by)
        .agg(F.countDistinct("order_no").alias("open_orders"), F.countDistinct("status").alias("open_statuses"))
    )


def missing_columns(headers: DataFrame, required: list[str]) -> DataFrame:
    """Files whose header lacks required columns.

    `headers` has one row per file: file_path, header (array of names).
    """
    wanted = F.array(*[F.lit(c) for c in required])
    return (
        headers.select("file_path", F.array_except(wanted, "header").alias("absent"))
        .filter(F.size("absent") > 0)
        .select("file_path", F.array_join(F.sort_array("absent"), ", ").alias("missing"))
    )


def wrong_period_sources(lines: DataFrame, year: int) -> DataFrame:
    """Sources with rows, none of them in the chosen year."""
    outside = F.col("year") != year
    return (
        _rows_per_period(lines)
        .groupBy(*SOURCE)
        .agg(
            _rows_where(outside).alias("outside_rows"),
            _rows_where(F.col("year") == year).alias("inside_rows"),
            _years_text(outside).alias("years"),
        )
        .filter((F.col("outside_rows") > 0) & (F.col("inside_rows") == 0))
        .drop("inside_rows")
    )


def reject_wrong_period(lines: DataFrame, year: int, counted: DataFrame | None = None) -> DataFrame:
    """Lines of sources that pass `wrong_period_sources`, which is told from `counted` (a profile) if there is one.

    The findings are written first, so Spark knows their size when it joins the lines.
    """
    wrong = wrong_period_sources(lines if counted is None else counted, year).select(*SOURCE)
    return lines.join(settle(wrong, "wrong_period"), SOURCE, "left_anti")


def reject_missing_months(lines: DataFrame, year: int, as_of: dt.date, counted: DataFrame | None = None) -> DataFrame:
    """Lines of sources whose platform wants every month and whose months are all there."""
    missing = missing_months(lines if counted is None else counted, year, as_of).filter("severity = 'reject'").select(*SOURCE)
    return lines.join(settle(missing, "missing_months"), SOURCE, "left_anti")


def foreign_period_rows(lines: DataFrame, year: int, month: int | None = None) -> DataFrame:
    """Rows of other periods per source. With a month, `foreign_rows` counts
    rows with another year or month and `foreign_rows_both` those where both
    differ."""
    other_year = F.col("year") != year
    if month is None:
        either = both = other_year
    else:
        either = other_year | (F.col("month") != month)
        both = other_year & (F.col("month") != month)
    return (
        _rows_per_period(lines)
        .groupBy(*SOURCE)
        .agg(
            _rows_where(either).alias("foreign_rows"),
            _rows_where(both).alias("foreign_rows_both"),
            _years_text(other_year).alias("other_years"),
        )
        .filter(F.col("foreign_rows") > 0)
    )


def missing_months(lines: DataFrame, year: int, as_of: dt.date) -> DataFrame:
    """Expected months of the year a source has no rows in, with a severity.

    The months seen are kept as bits of one integer, which Spark combines in
    the hash aggregate before the shuffle.
    """
    last = calendar.expected_months(year, as_of)
    bit = F.call_function("shiftleft", F.lit(1), F.col("month"))
    absent = F.filter(
        F.sequence(F.lit(1), F.lit(last)),
        lambda m: F.col("seen").bitwiseAND(F.call_function("shiftleft", F.lit(1), m)) == 0,
    )
    severity = per_platform(lambda rule: F.lit(rule.missing_month))
    return (
        lines.filter(calendar.in_period(year))
        .groupBy(*SOURCE)
        .agg(F.bit_or(bit).alias("seen"))
        .withColumn("absent", absent)
        .filter(F.size("absent") > 0)
        .select(
            *SOURCE,
            F.array_join(F.transform("absent", lambda m: m.cast("string")), ", ").alias("missing_months"),
            severity.alias("severity"),
        )
    )


def unreadable_lines(lines: DataFrame) -> DataFrame:
    """Per source: lines set aside or read with a gap, by reason."""
    if "rows" in lines.columns:
        return _unreadable_of_profile(lines)
    uses_discount = F.col("platform").isin("Shopee", "TikTok")
    counts = {
        "no_order_no": F.col("order_no").isNull(),
        "no_date": F.col("order_date").isNull(),
        "no_amount": F.col("item_c").isNull(),
        "no_discount": uses_discount & F.col("disc_c").isNull(),
        "no_shipping": uses_discount & F.col("ship_c").isNull(),
    }
    bad = F.lit(False)
    for condition in counts.values():
        bad = bad | condition
    return (
        lines.filter(bad)
        .groupBy(*SOURCE)
        .agg(*[F.count_if(condition).alias(name) for name, condition in counts.items()])
    )


def _unreadable_of_profile(counted: DataFrame) -> DataFrame:
    uses_discount = F.col("platform").isin("Shopee", "TikTok")
    counts = {
        "no_order_no": F.when(F.col("order_no").isNull(), F.col("rows")).otherwise(0),
        "no_date": F.when(F.col("year").isNull(), F.col("rows")).otherwise(0),
        "no_amount": F.col("no_amount"),
        "no_discount": F.when(uses_discount, F.col("no_discount")).otherwise(0),
        "no_shipping": F.when(uses_discount, F.col("no_shipping")).otherwise(0),
    }
    sums = counted.groupBy(*SOURCE).agg(*[F.sum(c).alias(name) for name, c in counts.items()])
    return sums.filter(F.greatest(*counts) > 0)
