"""Replacing parts of written tables: what is read, written and live, and what a killed run leaves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from taxweave.sinks import reports
from taxweave.sinks.versions import Conflict, Versions

SCHEMA = "taxpayer_id long, date date, year int, sum_c long"


def report(spark, rows):
    return spark.createDataFrame([(t, dt.date(y, 1, 1), y, c) for t, y, c in rows], SCHEMA)


def live(spark, path):
    return sorted((r.taxpayer_id, r.year, r.sum_c) for r in reports.read_written(spark, path, report(spark, [(0, 2000, 0)]).schema).collect())


def test_nothing_written_yet(spark, tmp_path):
    assert live(spark, str(tmp_path / "none")) == []


def test_a_refile_touches_its_ranges_only(spark, tmp_path):
    path = str(tmp_path / "daily")
    rows = [(t, y, t * 10) for t in range(40) for y in (2023, 2024)]
    reports.write_daily_sales(report(spark, rows), path, ranges=8)
    table = Versions(spark, path)
    before = table.state()
    assert len(before.units) == 16 and before.notes == {"ranges": "8"}
    reports.write_daily_sales(report(spark, [(7, 2024, -1)]), path)
    after = table.state()
    changed = {u for u in after.units if after.units[u] != before.units[u]}
    assert len(changed) == 1 and after.units.keys() == before.units.keys()
    assert live(spark, path) == sorted((t, y, -1 if (t, y) == (7, 2024) else c) for t, y, c in rows)
    # The new version holds the taxpayers of that range and year only.
    written = spark.read.parquet(f"{path}/version={after.units[changed.pop()]}")
    assert 0 < written.select("taxpayer_id").distinct().count() < 20 and {r.year for r in written.collect()} == {2024}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_refiling_without_rows_ends_a_unit(spark, tmp_path, fmt):
    schema = "taxpayer_id long, store string, platform string, year int, month int, order_date date, order_no string"
    sales = spark.createDataFrame([(1, "a", "Shopee", 2024, m, dt.date(2024, m, 1), "1") for m in (3, 4)], schema)
    fees = spark.createDataFrame([], schema.replace("order_date", "doc_date").replace("order_no", "doc_num"))
    path = str(tmp_path / fmt)
    reports.write_tax_ledgers(sales, fees, path, fmt)
    reports.write_tax_ledgers(sales.filter("month = 3"), fees, path, fmt, run=sales.select("taxpayer_id", "year", "month"))
    assert [r.month for r in reports.read_written(spark, f"{path}/sales", sales.schema, fmt).collect()] == [3]
    assert list(Versions(spark, f"{path}/sales").state().units)[0].startswith("year=2024/month=3/")
    assert reports.read_written(spark, f"{path}/purchases", fees.schema, fmt).collect() == []


def test_a_killed_run_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "daily")
    reports.write_daily_sales(report(spark, [(1, 2024, 5), (2, 2024, 6)]), path)
    monkeypatch.setattr(Versions, "commit", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        reports.write_daily_sales(report(spark, [(1, 2024, 50)]), path)
    monkeypatch.undo()
    assert live(spark, path) == [(1, 2024, 5), (2, 2024, 6)]
    # A manifest that was not written to its end doesn't count either.
    (tmp_path / "daily" / "_manifests" / f"{2:020d}").write_text("unit\tyear=2024/range=0\tv0")
    assert live(spark, path) == [(1, 2024, 5), (2, 2024, 6)]
    reports.write_daily_sales(report(spark, [(1, 2024, 50)]), path)
    assert live(spark, path) == [(1, 2024, 50), (2, 2024, 6)]


def test_two_writers(spark, tmp_path):
    """A write to other units goes through; one to the same units begins again from the new state."""
    path = str(tmp_path / "daily")
    reports.write_daily_sales(report(spark, [(1, 2023, 1), (1, 2024, 2), (2, 2024, 3)]), path, ranges=1)
    first, second = Versions(spark, path), Versions(spark, path)
    seen = second.state()
    first.commit(first.state(), {"year=2023/range=0": "vx"})
    second.commit(seen, {"year=2024/range=0": None})
    assert list(first.state().units) == ["year=2023/range=0"]
    with pytest.raises(Conflict):
        second.commit(seen, {"year=2023/range=0": None})
    with pytest.raises(Conflict):
        second.commit(seen, {"year=1999/range=0": "v"}, alone=True)


def test_the_loser_of_two_filings_keeps_the_winners_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "daily")
    reports.write_daily_sales(report(spark, [(1, 2024, 1), (2, 2024, 2)]), path, ranges=1)
    commit, between = Versions.commit, []

    def late(self, seen, changes, notes=None, alone=False):
        if not between:
            between.append(True)
            reports.write_daily_sales(report(spark, [(2, 2024, 22)]), path)  # another run is faster
        return commit(self, seen, changes, notes, alone)

    monkeypatch.setattr(Versions, "commit", late)
    reports.write_daily_sales(report(spark, [(1, 2024, 11)]), path)
    assert live(spark, path) == [(1, 2024, 11), (2, 2024, 22)]


def test_clean_removes_what_is_replaced(spark, tmp_path):
    path = str(tmp_path / "daily")
    for value in (1, 2, 3):
        reports.write_daily_sales(report(spark, [(1, 2024, value)]), path)
    assert len(list((tmp_path / "daily").glob("version=*"))) == 3
    Versions(spark, path).clean()
    assert len(list((tmp_path / "daily").glob("version=*"))) == 1 and live(spark, path) == [(1, 2024, 3)]


def test_a_hot_taxpayer_is_spread_over_files(spark, tmp_path):
    path = str(tmp_path / "daily")
    rows = spark.range(300_000).select(F.lit(1).cast("long").alias("taxpayer_id"), F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 365).cast("int")).alias("date"), F.lit(2024).alias("year"), F.col("id").alias("sum_c"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        reports.write_daily_sales(rows, path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    state = Versions(spark, path).state()
    (unit,) = state.units
    assert len(list((tmp_path / "daily" / f"version={state.units[unit]}" / unit).glob("*.parquet"))) > 1
