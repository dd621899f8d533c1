"""Threshold job: from order lines to daily sales, running total and verdict.

Every step after the order totals works on at most one row per source and day.
All groupings are sums or minima, which Spark combines before the shuffle, so
a source, order or taxpayer with a third of all lines does not end up in one
task. The two windows run over at most 366 rows per partition.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxweave.functions import calendar, money
from taxweave.operators.lines import SOURCE, daily_weight, per_platform
from taxweave.rules import AMBER_SATANG, RULES, THRESHOLD_SATANG

#: Stores of a taxpayer that have columns of their own in the numbered report.
MOST_STORES = 3


def order_discount(first: str, total: str) -> Column:
    """The discount of an order: first line's, sum of lines, or none."""
    pick = {"first": F.col(first), "sum": F.col(total), "none": F.lit(0).cast("long")}
    return F.coalesce(per_platform(lambda rule: pick[rule.discount]), F.lit(0))


def order_shipping(first: str) -> Column:
    no_revenue = F.lit(0).cast("long")
    return F.coalesce(
        per_platform(lambda rule: F.col(first) if rule.shipping else no_revenue), F.lit(0)
    )


def has_order(lines: DataFrame) -> DataFrame:
    """Lines that can be summed: those without an order number count only where
    the platform's daily sum does not group by order."""
    whole_day = [rule.name for rule in RULES.values() if rule.discount == "none"]
    return lines.filter(F.col("order_no").isNotNull() | F.col("platform").isin(*whole_day))


def order_totals_by_day(lines: DataFrame) -> DataFrame:
    """Per source, day and order: item sum less discount, and the shipping."""
    weight = daily_weight(lines)
    return (
        has_order(lines)
        .filter(F.col("order_date").isNotNull())
        .groupBy(*SOURCE, "order_date", "order_no")
        .agg(
            F.sum(F.col("item_c") * weight).alias("items"),
            F.sum(F.col("disc_c") * weight).alias("disc_total"),
            F.min_by("disc_c", "line_ord").alias("disc_first"),
            F.min_by("ship_c", "line_ord").alias("ship_first"),
        )
        .select(
            *SOURCE,
            "order_date",
            "order_no",
            (F.coalesce("items", F.lit(0)) - order_discount("disc_first", "disc_total")).alias("order_c"),
            order_shipping("ship_first").alias("ship_c"),
        )
    )


def daily_sales(order_totals: DataFrame) -> DataFrame:
    return order_totals.groupBy(*SOURCE, F.col("order_date").alias("date")).agg(
        F.sum("order_c").alias("order_c"), F.sum("ship_c").alias("ship_c")
    )


def _fill_days(rows: DataFrame, keys: list[str], measures: list[str], as_of: dt.date | None, running: dict[str, str] | None = None) -> DataFrame:
    """One row per day of each year that a key has rows in; new days hold 0.

    `running` names measures to be summed up over the year, and the new columns. They are summed over the rows
    there are and carried on to the filled days, which so need not be sorted.

    Each row fills the gap up to the next row's day, the first one also the
    days since 1 January. That takes one shuffle on key and year and reads the
    input once, where a join with a generated calendar would read it twice.
    """
    rows = rows.withColumn("year", F.year("date"))
    end = calendar.year_end(F.col("year"))
    if as_of is not None:
        last = F.lit(calendar.last_counted_day(as_of))
        rows = rows.filter((F.col("year") != as_of.year) | (F.col("date") <= last))
        end = F.when(F.col("year") == as_of.year, last).otherwise(end)
    by_day = Window.partitionBy(*keys, "year").orderBy("date")
    first = F.lag("date").over(by_day).isNull()
    filled = rows.withColumns(
        {
            "fill_from": F.when(first, calendar.year_start(F.col("year"))).otherwise(F.col("date")),
            "fill_to": F.coalesce(F.date_sub(F.lead("date").over(by_day), 1), end),
            **{name: F.sum(m).over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)) for m, name in (running or {}).items()},
        }
    ).withColumn("day", F.explode(F.sequence("fill_from", "fill_to")))
    own_day = F.col("day") == F.col("date")
    return filled.select(
        *keys,
        "year",
        F.col("day").alias("date"),
        *[F.when(own_day, F.col(m)).otherwise(F.lit(0)).alias(m) for m in measures],
        *[F.when(F.col("day") >= F.col("date"), F.col(name)).otherwise(F.lit(0)).alias(name) for name in (running or {}).values()],
    )


def dense_calendar(daily: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Daily sales with one row for each calendar day of the year, 0 where
    nothing was sold. With `as_of`, the running year stops where
    `exclude_open_month` stops."""
    return _fill_days(daily, SOURCE, ["order_c", "ship_c"], as_of)


def row_total(daily: DataFrame) -> DataFrame:
    """Per taxpayer and day: the sum over all stores, platforms and measures."""
    return daily.groupBy("taxpayer_id", "date").agg(F.sum(F.col("order_c") + F.col("ship_c")).alias("sum_c"))


def dense_row_total(totals: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    return _fill_days(totals, ["taxpayer_id"], ["sum_c"], as_of)


def grand_total(daily: DataFrame) -> DataFrame:
    """Per taxpayer and year: order value plus shipping."""
    return daily.groupBy("taxpayer_id", F.year("date").alias("year")).agg(
        F.sum(F.col("order_c") + F.col("ship_c")).alias("total_c")
    )


def running_total(totals: DataFrame) -> DataFrame:
    """Cumulative daily total of each taxpayer, restarting every year."""
    by_day = (
        Window.partitionBy("taxpayer_id", "year").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return totals.withColumn("year", F.year("date")).withColumn("cum_c", F.sum("sum_c").over(by_day))


def threshold_status(
    running: DataFrame, threshold: int = THRESHOLD_SATANG, amber: int = AMBER_SATANG
) -> DataFrame:
    """Per taxpayer and year: red with the first day at or over the threshold,
    amber between the two limits, else green; and the year's total."""
    return (
        running.groupBy("taxpayer_id", "year")
        .agg(
            F.min(F.when(F.col("cum_c") >= threshold, F.col("date"))).alias("reached_on"),
            F.max("cum_c").alias("top_c"),
            F.sum("sum_c").alias("total_c"),
        )
        .select(
            "taxpayer_id",
            "year",
            F.when(F.col("reached_on").isNotNull(), "red").when(F.col("top_c") > amber, "amber").otherwise("green").alias("status"),
            "reached_on",
            F.date_format("reached_on", "dd MMM yyyy").alias("reached_label"),
            "total_c",
            money.millions_label(F.col("total_c")).alias("total_label"),
        )
    )


def daily_matrix(daily: DataFrame, stores: list[str], platforms=tuple(RULES), *more: Column) -> DataFrame:
    """One row per taxpayer and day, one column pair per store and platform, and `more` aggregates.

    The columns are named by the caller, so no job has to look for them, and
    conditional sums need one shuffle where pivot() takes two. For the long
    form of many stores use `daily_sales`.
    """
    sums = []
    for store in stores:
        for platform in platforms:
            here = (F.col("store") == store) & (F.col("platform") == platform)
            for measure, name in (("order_c", "order_value"), ("ship_c", "shipping_value")):
                value = F.sum(F.when(here, F.col(measure)).otherwise(F.lit(0)))
                sums.append(value.alias(f"{store}_{platform.lower()}_{name}"))
    return daily.groupBy("taxpayer_id", "date").agg(*sums, *more)


def store_numbers(daily: DataFrame) -> DataFrame:
    """taxpayer_id, store, number: the stores of each taxpayer, counted by name."""
    by_name = Window.partitionBy("taxpayer_id").orderBy("store")
    return daily.select("taxpayer_id", "store").distinct().withColumn("number", F.row_number().over(by_name))


def numbered(daily: DataFrame, numbers: DataFrame) -> DataFrame:
    """Daily sales with the number of their store in place of its name."""
    return daily.join(numbers, ["taxpayer_id", "store"]).drop("store")


def numbered_report(of_numbers: DataFrame, most: int = MOST_STORES, as_of: dt.date | None = None) -> DataFrame:
    """`daily_report` by the number of the store (`numbered`): its width is the same however many taxpayers and names
    there are. Sum and running total are those of all stores; stores behind the first `most` are in `further_stores`."""
    first = of_numbers.withColumn("store", F.when(F.col("number") <= most, F.concat(F.lit("store"), F.col("number").cast("string"))))
    return daily_report(first, [f"store{k + 1}" for k in range(most)], as_of)


def further_stores(of_numbers: DataFrame, most: int = MOST_STORES) -> DataFrame:
    """The daily sales of the stores that have no columns in `numbered_report`, a row for each source and day."""
    return of_numbers.filter(F.col("number") > most)


def daily_report(daily: DataFrame, stores: list[str], as_of: dt.date | None = None) -> DataFrame:
    """The threshold job's report: every day with all measures, their sum and
    the running total. Sum and running total are those of all stores and platforms, also of
    stores that are not named and so have no columns."""
    wide = daily_matrix(daily, stores, tuple(RULES), F.sum(F.col("order_c") + F.col("ship_c")).alias("sum_c"))
    measures = [c for c in wide.columns if c not in ("taxpayer_id", "date")]
    return _fill_days(wide, ["taxpayer_id"], measures, as_of, {"sum_c": "cum_c"})
