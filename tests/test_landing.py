"""Landing uploads that share lines: copies, replaced uploads, and two runs at once."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from taxweave.operators import lines
from taxweave.plans import landing, threshold, vat
from taxweave.rules import RULES
from taxweave.sinks.versions import Versions

SCHEMA = (
    "taxpayer_id long, store string, platform string, order_no string, status string, order_date date, year int, month int, "
    "customer_name string, item_c long, disc_c long, ship_c long, line_ord long"
)


def upload(spark, rows):
    """Rows of (platform, order, day or None, item, times)."""
    out = []
    for platform, order, day, item, times in rows:
        period = (day.year, day.month) if day else (None, None)
        out += [(1, "a", platform, order, None, day, *period, "c", item, None, None, len(out) + k) for k in range(times)]
    return lines.dedup_lines(spark.createDataFrame(out, SCHEMA))


def landed(spark, path):
    read = landing.read_order_lines(spark, path).groupBy("platform", "order_no", "order_date", "item_c").agg(F.sum("copies").alias("n"), F.count_if(~F.col("extra")).alias("first"))
    assert all(r.first == 1 for r in read.collect())
    return sorted(((r.platform, r.order_no, r.order_date, r.item_c, r.n) for r in read.collect()), key=repr)


MARCH, APRIL = dt.date(2024, 3, 5), dt.date(2024, 4, 5)
FIRST = [("Shopee", "1", MARCH, 10, 1), ("Lazada", "2", MARCH, 20, 2), ("TikTok", "3", None, 30, 1), ("Lazada", "4", APRIL, 40, 1)]


def rows_of(*parts):
    return sorted([r for part in parts for r in part], key=repr)


def test_a_retry_without_a_name_is_the_same_upload(spark, tmp_path):
    path = str(tmp_path / "lines")
    for _ in range(2):
        landing.write_order_lines(upload(spark, FIRST), path)
    assert len({u.split('/')[0] for u in Versions(spark, path).state().units}) == 1
    assert landed(spark, path) == rows_of(FIRST)
    landing.write_order_lines(upload(spark, FIRST[:2]), path)
    assert len({u.split('/')[0] for u in Versions(spark, path).state().units}) == 2 and landed(spark, path) == rows_of(FIRST)


def test_a_row_counts_as_in_the_upload_that_has_most_of_it(spark, tmp_path):
    path = str(tmp_path / "lines")
    landing.write_order_lines(upload(spark, FIRST), path, "a")
    landing.write_order_lines(upload(spark, [("Shopee", "1", MARCH, 10, 3), ("Lazada", "2", MARCH, 20, 5), ("Lazada", "9", APRIL, 90, 1)]), path, "b")
    expected = [("Shopee", "1", MARCH, 10, 3), ("Lazada", "2", MARCH, 20, 5), ("TikTok", "3", None, 30, 1), ("Lazada", "4", APRIL, 40, 1), ("Lazada", "9", APRIL, 90, 1)]
    assert landed(spark, path) == rows_of(expected)
    read = landing.read_order_lines(spark, path)
    # Shopee and TikTok drop copies in both jobs, Lazada in the return only.
    assert {r.platform: r.order_c for r in threshold.daily_from_lines(read).collect() if r.date == MARCH} == {"Shopee": 10, "Lazada": 100}
    assert {(r.order_no, r.include_vat_c) for r in vat.sales_from_lines(read).collect()} == {("1", 10), ("2", 20), ("4", 40), ("9", 90)}
    assert {r.order_no: r.copies for r in lines.dedup_lines(read).collect()} == {"1": 3, "2": 5, "3": 1, "4": 1, "9": 1}


@pytest.mark.parametrize("order", ["abc", "cba", "bca"])
def test_uploads_in_any_order(spark, tmp_path, order):
    path = str(tmp_path / "lines")
    parts = {"a": FIRST, "b": [("Lazada", "2", MARCH, 20, 4), ("TikTok", "3", None, 30, 2)], "c": [("Lazada", "2", MARCH, 20, 1), ("Shopee", "7", APRIL, 1, 1)]}
    for name in order:
        landing.write_order_lines(upload(spark, parts[name]), path, name)
    full = [FIRST[0], ("Lazada", "2", MARCH, 20, 4), ("TikTok", "3", None, 30, 2), FIRST[3], ("Shopee", "7", APRIL, 1, 1)]
    assert landed(spark, path) == rows_of(full)
    # A replaced upload leaves, what the others had left out because of it stays.
    landing.write_order_lines(upload(spark, [("Shopee", "8", APRIL, 2, 1)]), path, "b")
    assert landed(spark, path) == rows_of(FIRST, [("Shopee", "7", APRIL, 1, 1), ("Shopee", "8", APRIL, 2, 1)])
    landing.write_order_lines(upload(spark, parts["b"][:1]), path, "a")
    assert landed(spark, path) == rows_of([("Lazada", "2", MARCH, 20, 4), ("Shopee", "7", APRIL, 1, 1), ("Shopee", "8", APRIL, 2, 1)])


def test_two_landings_at_once(spark, tmp_path, monkeypatch):
    path, commit, between = str(tmp_path / "lines"), Versions.commit, []

    def late(self, seen, changes, notes=None, alone=False):
        if not between:
            between.append(True)
            landing.write_order_lines(upload(spark, FIRST), path, "faster")
        return commit(self, seen, changes, notes, alone)

    monkeypatch.setattr(Versions, "commit", late)
    landing.write_order_lines(upload(spark, FIRST), path, "slower")
    assert landed(spark, path) == rows_of(FIRST)


def test_a_killed_landing_leaves_the_old_state(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "lines")
    landing.write_order_lines(upload(spark, FIRST), path, "a")
    monkeypatch.setattr(Versions, "_create", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        landing.write_order_lines(upload(spark, FIRST[:1]), path, "a")
    monkeypatch.undo()
    assert landed(spark, path) == rows_of(FIRST)


def test_first_line_of_an_order_is_that_of_the_first_upload(spark, tmp_path):
    path = str(tmp_path / "lines")
    later = upload(spark, [("Shopee", "1", MARCH, 1, 1)]).withColumn("ship_c", F.lit(900).cast("long"))
    landing.write_order_lines(upload(spark, [("Shopee", "1", MARCH, 50, 1)]).withColumn("ship_c", F.lit(500).cast("long")), path, "b")
    landing.write_order_lines(later, path, "a")
    ship = {r.include_vat_c for r in vat.sales_from_lines(landing.read_order_lines(spark, path)).collect() if r.type != "สินค้า"}
    assert ship == {500}


def test_fingerprints(spark):
    rows = spark.createDataFrame([("x", None), (None, "x"), ("x", ""), ("x", None), ("", "x")], "a string, b string")
    prints = [(r.print_a, r.print_b) for r in lines.with_prints(rows, ["a", "b"]).collect()]
    assert len(set(prints)) == 4 and prints[0] == prints[3]
    # An export version without the column has the same rows.
    assert [(r.print_a, r.print_b) for r in lines.with_prints(rows.select("a"), ["a"]).limit(1).collect()] == prints[:1]
    assert lines.with_prints(rows, ["a", "b"], "Shopee").first().print_a != prints[0][0]


def test_only_the_months_of_the_upload_are_compared(spark, tmp_path, monkeypatch):
    path, asked, read = str(tmp_path / "lines"), [], Versions.read
    landing.write_order_lines(upload(spark, FIRST), path, "a")
    monkeypatch.setattr(Versions, "read", lambda self, state, schema, units=None, fmt="parquet": asked.append(units) or read(self, state, schema, units, fmt))
    landing.write_order_lines(upload(spark, FIRST[3:]), path, "b")
    assert asked == [["batch=ba/year=2024/month=4"]]
    table = Versions(spark, path)
    others = read(table, table.state(), None)
    plan = landing._lacking(lines.with_prints(upload(spark, FIRST), ["order_no"]).withColumnRenamed("copies", "uploaded"), others, 0)._jdf.queryExecution().executedPlan().toString()
    columns = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert any("print_a" in s and "customer_name" not in s for s in columns)


def export(spark, path, rows, columns):
    rule = RULES["Shopee"]
    names = [rule.columns[c] for c in columns]
    schema = "taxpayer_id string, store string, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame([("07", "a", *r) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)


def test_the_same_export_in_two_uploads(spark, tmp_path):
    columns = ["order_no", "status", "ordered_at", "item", "discount", "shipping", "customer_name"]
    rows = [(str(k), "x", "2024-03-05 10:00", "10.00", "1.00", "2.00", "c") for k in range(5)]
    export(spark, str(tmp_path / "one"), rows[:4], columns)
    export(spark, str(tmp_path / "two"), rows[2:], columns)
    path = str(tmp_path / "lines")
    for name in ("one", "two", "one"):
        landing.write_order_lines(landing.lines_from_exports(spark, {"Shopee": str(tmp_path / name)}, {"Shopee": "parquet"}), path, None)
    read = landing.read_order_lines(spark, path)
    assert sorted((r.taxpayer_id, r.order_no, r.item_c, r.copies) for r in read.collect()) == [("07", str(k), 1000, 1) for k in range(5)]
