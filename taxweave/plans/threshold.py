"""Threshold check for many taxpayers and years in one job."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from taxweave.operators import daily, inputs, lines, quality
from taxweave.rules import AMBER_SATANG, THRESHOLD_SATANG
from taxweave.session import settle


@dataclass(frozen=True)
class ThresholdCheck:
    daily: DataFrame  # per source and day with sales
    status: DataFrame  # per taxpayer and year
    report: DataFrame  # per taxpayer and calendar day, one column pair per source


def counted_lines(order_lines: DataFrame, year: int | None = None, as_of: dt.date | None = None) -> DataFrame:
    """Lines the job counts. The status and period filters run before copies
    are dropped: both are part of what makes rows equal, so the result is the
    same and fewer rows are shuffled."""
    kept = lines.drop_cancelled(order_lines)
    if year is not None:
        kept = lines.filter_period(kept, year)
    if as_of is not None:
        kept = lines.exclude_open_month(kept, as_of)
    return lines.without_copies(kept)


def daily_from_lines(order_lines: DataFrame, year: int | None = None, as_of: dt.date | None = None) -> DataFrame:
    return daily.daily_sales(order_totals_from_lines(order_lines, year, as_of))


def order_totals_from_lines(order_lines: DataFrame, year: int | None = None, as_of: dt.date | None = None) -> DataFrame:
    return daily.order_totals_by_day(counted_lines(order_lines, year, as_of))


def status_from_lines(
    order_lines: DataFrame,
    year: int | None = None,
    as_of: dt.date | None = None,
    threshold: int = THRESHOLD_SATANG,
    amber: int = AMBER_SATANG,
) -> DataFrame:
    """The verdict alone: order totals are summed straight to taxpayer and day,
    which saves the shuffle by source and day."""
    orders = order_totals_from_lines(order_lines, year, as_of).withColumnRenamed("order_date", "date")
    return daily.threshold_status(daily.running_total(daily.row_total(orders)), threshold, amber)


def status_from_daily(sales: DataFrame, threshold: int = THRESHOLD_SATANG, amber: int = AMBER_SATANG) -> DataFrame:
    return daily.threshold_status(daily.running_total(daily.row_total(sales)), threshold, amber)


@dataclass(frozen=True)
class Gated:
    result: DataFrame  # of taxpayers and periods whose uploads are complete
    left_out: DataFrame  # the uploads that others lack


def gated_status(order_lines: DataFrame, selection: DataFrame, manifest: DataFrame, year: int | None = None, as_of: dt.date | None = None) -> Gated:
    """The verdict of the taxpayer-years that have a sale export of every selected store and platform.

    `manifest` has the source, kind and year of each upload. The verdicts, a row for each taxpayer and year, are
    joined with the state, never the lines.
    """
    status = settle(status_from_lines(order_lines, year, as_of), "status")
    wanted = inputs.wanted_inputs(selection, status.select("taxpayer_id", "year"), ("sale",))
    state = inputs.completeness(wanted, manifest)
    missing = inputs.lacking(wanted, manifest)
    return Gated(inputs.drop_incomplete(status, state), missing)


def threshold_check(
    order_lines: DataFrame, stores: list[str], year: int | None = None, as_of: dt.date | None = None, strict: bool = False
) -> ThresholdCheck:
    """With `strict` and a year, sources that `findings` rejects are left out. `as_of` leaves out the open month of the running year; without it the
    whole year counts. The lines are read once: daily sales are written to the
    shared folder and the other results start from there."""
    if strict:
        if year is None:
            raise ValueError("strict checks are made for one year")
        order_lines = strict_lines(order_lines, year, as_of or dt.date(year, 12, 31))
    sales = settle(daily_from_lines(order_lines, year, as_of), "daily")
    return ThresholdCheck(sales, status_from_daily(sales), daily.daily_report(sales, stores, as_of))


def profile(order_lines: DataFrame) -> DataFrame:
    """What `findings` and `strict_lines` are told from: the lines that count, read once and written as counts."""
    return settle(quality.profile(lines.drop_cancelled(order_lines)), "profile")


def strict_lines(order_lines: DataFrame, year: int, as_of: dt.date, counted: DataFrame | None = None) -> DataFrame:
    """Lines of the year without the sources that `findings` rejects: those with rows of other
    years only, and those of a platform that wants every month, with a month missing."""
    kept = lines.drop_cancelled(order_lines)
    counted = profile(order_lines) if counted is None else counted
    inside = lines.filter_period(quality.reject_wrong_period(kept, year, counted), year)
    return quality.reject_missing_months(inside, year, as_of, counted)


def findings(order_lines: DataFrame, year: int, as_of: dt.date, counted: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a user should look at before trusting the result, by name."""
    kept = profile(order_lines) if counted is None else counted
    inside = lines.filter_period(kept, year)
    return {
        "wrong_period_sources": quality.wrong_period_sources(kept, year),
        "foreign_period_rows": quality.foreign_period_rows(kept, year),
        "missing_months": quality.missing_months(inside, year, as_of),
        "incomplete_orders": quality.incomplete_orders(inside, by=("year",)),
        "unreadable_lines": quality.unreadable_lines(kept),
    }
