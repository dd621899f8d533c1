import datetime as dt

import pytest
from pyspark.sql import functions as F

from taxweave import fixtures as fx
from taxweave.operators import daily
from taxweave.plans import threshold, vat

SF = "/root/testdata/sf0.001"
DAILY = "taxpayer_id long, store string, platform string, date date, order_c long, ship_c long"


def sales(spark, rows):
    return spark.createDataFrame([(1, "a", p, d, o, s) for p, d, o, s in rows], DAILY)


@pytest.mark.parametrize("year, days", [(2023, 365), (2024, 366)])
def test_calendar_is_dense_and_keeps_the_sum(spark, year, days):
    given = sales(spark, [("Shopee", dt.date(year, 2, 28), 5, 1), ("Shopee", dt.date(year, 12, 31), 7, 0)])
    rows = daily.dense_calendar(given).orderBy("date").collect()
    assert len(rows) == len({r.date for r in rows}) == days
    assert (rows[0].date, rows[-1].date) == (dt.date(year, 1, 1), dt.date(year, 12, 31))
    assert sum(r.order_c for r in rows) == 12 and sum(r.ship_c for r in rows) == 1


def test_calendar_stops_before_the_open_month(spark):
    given = sales(spark, [("Shopee", dt.date(2024, 1, 9), 5, 1), ("Shopee", dt.date(2024, 4, 2), 7, 0)])
    rows = daily.dense_calendar(given, dt.date(2024, 4, 20)).collect()
    assert max(r.date for r in rows) == dt.date(2024, 3, 31) and sum(r.order_c for r in rows) == 5
    rows = daily.dense_calendar(given, dt.date(2024, 1, 20)).collect()
    assert len(rows) == 20


@pytest.mark.parametrize(
    "total, status",
    [(180_000_000, "red"), (179_999_999, "amber"), (150_000_001, "amber"), (150_000_000, "green"), (0, "green")],
)
def test_limits(spark, total, status):
    given = sales(spark, [("Shopee", dt.date(2024, 5, 1), total - 50, 0), ("TikTok", dt.date(2024, 5, 3), 20, 30)])
    row = threshold.status_from_daily(given).first()
    assert row.status == status and row.total_c == total
    assert row.reached_label == ("03 May 2024" if status == "red" else None)


def test_running_total_restarts_each_year(spark):
    given = sales(spark, [("Shopee", dt.date(2023, 12, 31), 179_000_000, 0), ("Shopee", dt.date(2024, 1, 1), 2_000_000, 0)])
    assert {(r.year, r.status) for r in threshold.status_from_daily(given).collect()} == {(2023, "amber"), (2024, "green")}


def test_label(spark):
    given = sales(spark, [("Shopee", dt.date(2024, 1, 1), 123_450_000, 49_999)])
    assert threshold.status_from_daily(given).first().total_label == "1.23 M"


def test_report_columns_add_up(spark):
    check = threshold.threshold_check(fx.canonical_lines(spark, SF), fx.STORES)
    report = check.report
    measures = [c for c in report.columns if c.endswith("_value")]
    assert len(measures) == 18
    total = sum((F.col(m) for m in measures[1:]), F.col(measures[0]))
    assert report.filter(total != F.col("sum_c")).count() == 0
    days = report.groupBy("taxpayer_id", "year").agg(F.count(F.lit(1)).alias("n"), F.max("cum_c").alias("top")).collect()
    assert {r.n for r in days} == {365, 366}
    assert {(r.taxpayer_id, r.year): r.top for r in days} == {(r.taxpayer_id, r.year): r.total_c for r in check.status.collect()}


def test_verdict_does_not_depend_on_the_way(spark):
    lines = fx.canonical_lines(spark, SF)
    short = threshold.status_from_lines(lines)
    long = threshold.status_from_daily(threshold.daily_from_lines(lines))
    assert short.exceptAll(long).count() == 0 and long.exceptAll(short).count() == 0


def test_result_does_not_depend_on_partitions(spark):
    def result(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        rows = fx.canonical_lines(spark, SF).repartition(partitions)
        return sorted(map(tuple, vat.sales_from_lines(rows).collect()))

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert result(1) == result(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_findings_by_name(spark):
    found = threshold.findings(fx.canonical_lines(spark, SF), 2001, dt.date(2001, 9, 1))
    assert set(found) == {"wrong_period_sources", "foreign_period_rows", "missing_months", "incomplete_orders", "unreadable_lines"}
    assert all(frame.count() > 0 for frame in found.values())


def test_the_numbered_report_is_as_wide_for_any_number_of_stores(spark):
    rows = [(t, f"{t}-{n:02d}", "Shopee", dt.date(2024, 3, 1 + n), 10 + n, n) for t in range(50) for n in range(t % 7 + 1)]
    sales = spark.createDataFrame(rows, "taxpayer_id long, store string, platform string, date date, order_c long, ship_c long")
    of_numbers = daily.numbered(sales, daily.store_numbers(sales))
    report = daily.numbered_report(of_numbers)
    assert len(report.columns) == 2 + 3 * 3 * 2 + 3
    last = {r.taxpayer_id: r.cum_c for r in report.filter("date = '2024-12-31'").collect()}
    assert last == {t: sum(10 + 2 * n for n in range(t % 7 + 1)) for t in range(50)}
    named = report.agg(*[F.sum(c) for c in report.columns if c.endswith("_value")]).first()
    further = daily.further_stores(of_numbers)
    assert sum(named) + further.agg(F.sum(F.col("order_c") + F.col("ship_c"))).first()[0] == sum(last.values())
    assert {r.number for r in further.collect()} == {4, 5, 6, 7}
