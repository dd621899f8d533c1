"""What is shuffled, sorted and computed, where a larger input would pass its limits."""

import datetime as dt
import time

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from taxweave import fixtures as fx
from taxweave import session
from taxweave.operators import daily, inputs
from taxweave.plans import landing
from taxweave.queries import checks, threshold, vat
from taxweave.rules import RULES
from taxweave.sinks import reports
from taxweave.sinks.versions import Versions
from taxweave.sources import exports
from test_landing import FIRST, landed, rows_of, upload

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_one_platforms_lines_are_chosen_before_the_shuffle(spark):
    for name in RULES:
        plan = plan_of(fx.order_lines(spark, SF, name))
        shuffled = plan[plan.index("RebalancePartitions") :]
        assert name in shuffled  # the filter lies below
    both = fx.order_lines(spark, SF, "Lazada")
    assert sorted(both.collect(), key=repr) == sorted(fx.order_lines(spark, SF).filter("platform = 'Lazada'").collect(), key=repr)


def test_an_export_is_written_without_another_shuffle(spark, monkeypatch):
    shuffles = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "repartitionByRange", lambda self, *by: shuffles.append(by) or self)
    root = fx.write_exports(spark, SF, "Shopee")
    assert not shuffles
    files = spark.read.parquet(f"{root}/kind=sale/platform=Shopee").select(F.col(RULES["Shopee"].columns["order_no"]).alias("n"), F.col("_metadata.file_path").alias("f"))
    assert files.groupBy("n").agg(F.countDistinct("f").alias("f")).agg(F.max("f")).first()[0] == 1


def test_running_totals_of_the_report_sort_no_filled_days(spark):
    rows = [(1, "store1", "Shopee", dt.date(2024, m, d), v, 1) for m, d, v in ((1, 1, 5), (1, 3, 7), (12, 31, 2))] + [(2, "store9", "Lazada", dt.date(2023, 2, 2), 4, 0)]
    sales = spark.createDataFrame(rows, "taxpayer_id long, store string, platform string, date date, order_c long, ship_c long")
    report = daily.daily_report(sales, ["store1"])
    assert plan_of(report).count("Window ") == 1
    got = {(r.taxpayer_id, r.date): (r.sum_c, r.cum_c) for r in report.collect()}
    assert len(got) == 366 + 365
    days = {(1, 1, 1): (6, 6), (1, 1, 2): (0, 6), (1, 1, 3): (8, 14), (1, 12, 30): (0, 14), (1, 12, 31): (3, 17)}
    assert all(got[t, dt.date(2024, m, d)] == v for (t, m, d), v in days.items())
    assert got[2, dt.date(2023, 2, 1)] == (0, 0) and got[2, dt.date(2023, 2, 2)] == got[2, dt.date(2023, 2, 2)] == (4, 4) and got[2, dt.date(2023, 12, 31)] == (0, 4)


def test_a_task_sorts_a_bounded_number_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reports, "ROWS_OF_TASK", 100)
    rows = spark.range(1000).select(F.col("id").alias("taxpayer_id"), F.lit(2024).alias("year"), F.lit(dt.date(2024, 1, 1)).alias("date"), F.lit(0).cast("long").alias("sum_c"))
    reports.write_daily_sales(rows, str(tmp_path / "x"))
    read = reports.read_written(spark, str(tmp_path / "x"), rows.schema)
    files = read.groupBy(F.col("_metadata.file_path")).count().collect()
    assert read.count() == 1000 and len(files) >= 9 and max(r["count"] for r in files) < 300


@pytest.mark.parametrize(
    "query",
    [
        threshold.run_audit_threshold,
        checks.replace_overlapping_upload,
        checks.land_second_upload,
    ],
)
def test_lines_that_several_steps_need_are_computed_once(spark, monkeypatch, query):
    scans, read = [], fx.table
    monkeypatch.setattr(fx, "table", lambda spark, sf_dir, name: scans.append(name) or read(spark, sf_dir, name))
    kept = []
    module = threshold if query.__module__ == threshold.__name__ else checks
    settle = module.settle
    monkeypatch.setattr(module, "settle", lambda df, name: kept.append(name) or settle(df, name))
    assert "lineitem" not in plan_of(query(spark, SF))
    assert scans.count("lineitem") == 1 and len(kept) == 1


@pytest.mark.parametrize("query", [vat.sort_purchase_ledger])
def test_texts_are_not_extracted_for_the_ranges_of_a_sort(spark, query):
    assert "transform(" not in plan_of(query(spark, SF))


def test_a_retried_upload_is_not_written_again(spark, tmp_path):
    path = str(tmp_path / "lines")
    table = Versions(spark, path)
    for _ in range(2):
        landing.write_order_lines(upload(spark, FIRST), path)
    assert table.state().number == 1
    landing.write_order_lines(upload(spark, FIRST[:2]), path, "b")
    once = table.state()
    landing.write_order_lines(upload(spark, FIRST[:2]), path, "b")
    assert table.state() == once
    # A retry behind another upload, and other rows or another order under the same name, replace what was there.
    landing.write_order_lines(upload(spark, FIRST), path)
    assert table.state().number == 3 and landed(spark, path) == rows_of(FIRST)
    landing.write_order_lines(upload(spark, FIRST[:2][::-1]), path, "b")
    assert table.state().number == 4
    landing.write_order_lines(upload(spark, FIRST[:1]), path, "b")
    assert table.state().number == 5 and landed(spark, path) == rows_of(FIRST)


def test_only_exports_that_are_landed_are_written(spark, monkeypatch):
    written, write = [], fx.write_incomplete_exports
    monkeypatch.setattr(fx, "write_incomplete_exports", lambda spark, sf_dir, *which: written.append(which) or write(spark, sf_dir, *which))
    checks.land_without_quarantined(spark, SF)
    assert sorted(written) == [("Lazada", "csv"), ("Shopee", "parquet"), ("TikTok", "csv")]


@pytest.mark.parametrize("platform", ["Shopee", "TikTok"])
def test_exports_are_not_shuffled_by_file_nor_sorted_for_their_copies(spark, platform):
    root, fmt = fx.write_exports(spark, SF, platform), "csv" if platform == "TikTok" else "parquet"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the listing is large
    try:
        rows = landing.lines_from_exports(spark, {platform: root}, {platform: fmt})
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan and plan.count("HashAggregate") >= 4


def test_numbered_order_is_that_of_file_and_row(spark, tmp_path):
    for name, days in (("b", ["3", "4"]), ("a", ["1", "2"])):
        (tmp_path / f"{name} 1.csv").write_text("day\n" + "\n".join(days) + "\n")
    raw = exports.scan_order_export(spark, str(tmp_path))
    numbered = exports.with_numbered_order(raw, str(tmp_path))
    assert [r.day for r in numbered.orderBy("line_ord").collect()] == ["1", "2", "3", "4"]
    assert dict(numbered.dtypes)["line_ord"] == "decimal(38,0)" and numbered.select("file_no").distinct().count() == 2


def test_a_filing_writes_its_ledgers_once_before_they_are_sorted(spark, monkeypatch):
    names, fresh = [], session.fresh_folder
    monkeypatch.setattr(session, "fresh_folder", lambda spark, name: names.append(name) or fresh(spark, name))
    vat.write_receipts(spark, SF)
    assert "report" not in names and "touched" not in names and names.count("sales") == names.count("purchases") == 1


def test_documents_of_other_platforms_are_not_rendered(spark):
    plan = plan_of(fx.invoice_pages(spark, SF).filter("platform = 'Lazada'"))
    below = plan[plan.rindex("Aggregate") :]
    assert any("Filter" in line and "= Lazada" in line for line in below.split("\n"))


def test_uploads_of_each_period_are_not_sent_through_the_driver(spark, tmp_path):
    """A written table of repeated sources is small as a file, whatever number of rows it has."""
    source, period = "taxpayer_id long, store string, platform string", "year int, month int"
    rows = [(1, "a", "Shopee", k, 2024, 3) for k in ("sale", "commission")] + [(2, "b", "TikTok", "sale", 2024, 3)]
    spark.createDataFrame(rows, f"{source}, kind string, {period}").write.parquet(str(tmp_path / "manifest"))
    manifest = spark.read.parquet(str(tmp_path / "manifest"))
    selection, periods = manifest.select("taxpayer_id", "store", "platform"), manifest.select("taxpayer_id", "year", "month")
    wanted = inputs.wanted_inputs(selection, periods)
    state, missing = inputs.completeness(wanted, manifest), inputs.lacking(wanted, manifest)
    kept = inputs.drop_incomplete(periods, state)
    for frame in (wanted, state, missing, kept):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [(r.taxpayer_id, r.kind) for r in missing.collect()] == [(2, "commission")]
    assert {r.taxpayer_id for r in kept.collect()} == {1}


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles().mkString("\n").split("\n")
    return {f for f in files if "/shuffle_" in f}


def test_written_tables_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    before = shuffle_files(spark)
    rows = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    settled = session.settle(rows, "counts")
    with session.settling(spark) as keep:
        keep(rows, "more")
    for _ in range(50):  # Spark removes them behind the write
        if not (left := {f for f in shuffle_files(spark) - before if f.endswith(".data")}):
            break
        time.sleep(0.2)
    assert not left and settled.count() == 100
    session.forget(settled)
    assert not session.exists(spark, settled.inputFiles()[0].rsplit("/", 1)[0])
    tidied, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: tidied.append(spark.conf.get(session.CLEANUP, "false")) or write(self, *a, **b))
    path = str(tmp_path / "lines")
    for batch, some in (("a", FIRST), ("b", FIRST[:2]), ("a", FIRST[::-1])):
        landing.write_order_lines(upload(spark, some), path, batch)
    assert len(tidied) == 8 and set(tidied) == {"true"} and spark.conf.get(session.CLEANUP, "false") == "false"
    assert landed(spark, path) == rows_of(FIRST)


@pytest.mark.parametrize("query", [checks.land_second_upload, checks.replace_overlapping_upload, checks.land_overlapping_uploads, checks.land_same_upload_twice])
def test_lines_of_uploads_go_when_all_are_landed(spark, monkeypatch, query):
    kept, settle = [], checks.settle
    monkeypatch.setattr(checks, "settle", lambda df, name: kept.append(settle(df, name)) or kept[-1])
    result = query(spark, SF)
    assert not any(session.exists(spark, f) for f in kept[0].inputFiles()) and result.count()
