"""State carried from landing to landing: balances, landed documents, and findings from one profile."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from taxweave import fixtures as fx
from taxweave.operators import invoices, lines, quality
from taxweave.plans import balances, documents, landing, threshold
from taxweave.sinks.versions import Versions
from taxweave.sources.documents import first_pages

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "taxpayer_id long, store string, platform string, order_no string, status string, order_date date, year int, month int, "
    "customer_name string, item_c long, disc_c long, ship_c long, line_ord long"
)


def upload(spark, rows):
    """Rows of (taxpayer, day, amount)."""
    out = [(t, "a", "Lazada", str(k), None, day, day.year if day else None, day.month if day else None, "c", amount, None, None, k) for k, (t, day, amount) in enumerate(rows)]
    return lines.dedup_lines(spark.createDataFrame(out, SCHEMA))


def carried(spark, path):
    return sorted(tuple(r) for r in balances.status(spark, path).select("taxpayer_id", "year", "status", "reached_on", "total_c").collect())


def in_full(spark, landed):
    read = threshold.status_from_lines(landing.read_order_lines(spark, landed))
    return sorted(tuple(r) for r in read.select("taxpayer_id", "year", "status", "reached_on", "total_c").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_balances_equal_the_full_run_after_any_landings(spark, tmp_path, seed):
    pick = random.Random(seed)
    landed, path = str(tmp_path / "lines"), str(tmp_path / "balances")
    day = lambda: dt.date(pick.choice([2023, 2024]), pick.randint(1, 12), pick.randint(1, 28))
    for _ in range(4):
        rows = [(pick.randint(1, 4), pick.choice([day(), day(), day(), None]), pick.randint(1, 40_000_000)) for _ in range(pick.randint(1, 25))]
        landing.write_order_lines(upload(spark, rows), landed, pick.choice("abc"))
        if pick.random() < 0.7:
            balances.update(spark, landed, path, ranges=3)
    balances.update(spark, landed, path)
    assert carried(spark, path) == in_full(spark, landed)
    assert balances.update(spark, landed, path) == 0
    last = {(r.taxpayer_id, r.year): r.balance_c for r in balances.balances(spark, path).collect()}
    assert last == {(t, y): total for t, y, _, _, total in carried(spark, path)}


def test_only_changed_days_are_summed(spark, tmp_path):
    landed, path = str(tmp_path / "lines"), str(tmp_path / "balances")
    first = [(t, dt.date(2024, m, 5), 100 * t + m) for t in range(1, 9) for m in (1, 2, 3)]
    landing.write_order_lines(upload(spark, first), landed, "a")
    assert balances.update(spark, landed, path, ranges=4) == 24
    before = Versions(spark, path).state()
    landing.write_order_lines(upload(spark, [(3, dt.date(2024, 2, 9), 7), (3, dt.date(2024, 2, 10), 8)]), landed, "late")
    assert balances.update(spark, landed, path) == 2
    after = Versions(spark, path).state()
    assert len([u for u in after.units if before.units.get(u) != after.units[u]]) == 1
    cum = {r.date: r.cum_c for r in balances.running(spark, path).filter("taxpayer_id = 3").collect()}
    assert [cum[d] for d in sorted(cum)] == [301, 603, 610, 618, 921]


def test_a_withdrawn_upload_leaves_the_balance(spark, tmp_path):
    landed, path = str(tmp_path / "lines"), str(tmp_path / "balances")
    landing.write_order_lines(upload(spark, [(1, dt.date(2024, 1, 5), 200_000_000)]), landed, "wrong")
    balances.update(spark, landed, path)
    assert carried(spark, path)[0][2] == "red"
    landing.write_order_lines(upload(spark, [(2, dt.date(2023, 1, 5), 5)]), landed, "wrong")
    balances.update(spark, landed, path)
    assert carried(spark, path) == in_full(spark, landed) == [(2, 2023, "green", None, 5)]


def test_documents_are_extracted_once(spark, tmp_path):
    docs, path = first_pages(fx.invoice_pages(spark, SF)).cache(), str(tmp_path / "documents")
    march, all_ = docs.filter("year = 1998 and month = 3"), docs.filter("year = 1998 and month <= 4")
    assert documents.land_documents(march, path) == march.count()
    assert documents.land_documents(all_, path) == all_.count() - march.count()
    assert documents.land_documents(march, path) == 0
    # A corrected document replaces its earlier state, in its month only.
    one = march.limit(1).withColumn("text", F.concat("text", F.lit("\nend")))
    assert documents.land_documents(one, path) == 1 and documents.land_documents(one, path) == 0
    assert documents.read_documents(spark, path).count() == all_.count()
    expected = sorted(tuple(r) for r in invoices.purchase_ledger(march).select(*invoices.PURCHASES).collect())
    assert sorted(tuple(r) for r in documents.purchases(spark, path, 1998, 3).select(*invoices.PURCHASES).collect()) == expected
    assert documents.read_documents(spark, path, 1998, 7).count() == 0
    read = documents.read_documents(spark, path, 1998, 4)
    files = {r[0] for r in read.select("year", "month").distinct().collect()}
    assert files == {1998} and all("/month=4/" in f for f in read.inputFiles())


def test_one_profile_gives_all_findings(spark):
    rows = fx.canonical_lines(spark, SF)
    kept = lines.drop_cancelled(rows)
    counted = threshold.profile(rows)
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
    day = dt.date(2001, 9, 1)
    assert same(quality.wrong_period_sources(counted, 2001), quality.wrong_period_sources(kept, 2001))
    assert same(quality.foreign_period_rows(counted, 1998, 3), quality.foreign_period_rows(kept, 1998, 3))
    assert same(quality.missing_months(counted, 2001, day), quality.missing_months(kept, 2001, day))
    assert same(quality.incomplete_orders(counted), quality.incomplete_orders(kept))
    columns = ["taxpayer_id", "store", "platform", "no_order_no", "no_date", "no_amount", "no_discount", "no_shipping"]
    assert same(quality.unreadable_lines(counted).select(*columns), quality.unreadable_lines(kept).select(*columns))
    assert same(threshold.strict_lines(rows, 2001, day, counted), threshold.strict_lines(rows, 2001, day))
    found = threshold.findings(rows, 2001, day, counted)
    assert all("lineitem" not in f for name in found for f in found[name].inputFiles())
    check = threshold.threshold_check(rows, fx.STORES, 2001, strict=True)
    assert sorted(map(repr, check.status.collect())) == sorted(map(repr, threshold.status_from_lines(threshold.strict_lines(rows, 2001, dt.date(2001, 12, 31)), 2001).collect()))
