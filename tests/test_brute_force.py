"""The two jobs against plain loops over collected rows, written from the
rules and not from the SQL."""

from collections import defaultdict

import pytest

from taxweave import fixtures as fx
from taxweave.plans import threshold, vat

SF = "/root/testdata/sf0.001"
GONE = {"ยกเลิกแล้ว", "canceled", "returned", "Package Returned", "Canceled"}


@pytest.fixture(scope="module")
def rows(spark):
    collected = [r.asDict() for r in fx.canonical_lines(spark, SF).collect()]
    return sorted((r for r in collected if r["status"] not in GONE), key=lambda r: r["line_ord"])


def without_copies(rows):
    seen, kept = set(), []
    for row in rows:
        mark = tuple(v for k, v in row.items() if k != "line_ord")
        if mark not in seen:
            seen.add(mark)
            kept.append(row)
    return kept


def order_sums(platform, group):
    goods = sum(r["item_c"] for r in group)
    if platform == "Shopee":
        goods -= group[0]["disc_c"] or 0
    if platform == "TikTok":
        goods -= sum(r["disc_c"] or 0 for r in group)
    return goods, 0 if platform == "Lazada" else group[0]["ship_c"]


def grouped(rows, *names):
    groups = defaultdict(list)
    for row in rows:
        groups[tuple(row[n] for n in names)].append(row)
    return groups


def test_threshold_job(spark, rows):
    counted = [r for r in rows if r["platform"] == "Lazada"] + without_copies([r for r in rows if r["platform"] != "Lazada"])
    by_day = defaultdict(int)
    for (taxpayer, _, platform, day, _), group in grouped(counted, "taxpayer_id", "store", "platform", "order_date", "order_no").items():
        by_day[taxpayer, day] += sum(order_sums(platform, group))
    expected = {}
    running = defaultdict(int)
    for (taxpayer, day), amount in sorted(by_day.items(), key=lambda e: e[0][1]):
        key = taxpayer, day.year
        running[key] += amount
        old = expected.get(key, (None, 0))
        reached = old[0] or (day if running[key] >= 180_000_000 else None)
        expected[key] = (reached, running[key])
    got = {(r.taxpayer_id, r.year): (r.reached_on, r.total_c) for r in threshold.status_from_lines(fx.canonical_lines(spark, SF)).collect()}
    assert got == expected


def test_sales_ledger(spark, rows):
    expected = []
    groups = grouped(without_copies(rows), "taxpayer_id", "store", "platform", "year", "month", "order_no")
    for (taxpayer, store, platform, *_, order), group in groups.items():
        goods, service = order_sums(platform, group)
        for kind, gross in (("สินค้า", goods), ("บริการ", service)):
            if kind == "สินค้า" or gross != 0:
                tax = round(round(gross / 100 * 0.07 / 1.07, 2) * 100)
                expected.append((taxpayer, store, platform, order, kind, group[0]["order_date"], group[0]["status"] or "", gross - tax, tax))
    got = [
        (r.taxpayer_id, r.store, r.platform, r.order_no, r.type, r.order_date, r.status or "", r.before_vat_c, r.vat_c)
        for r in vat.sales_from_lines(fx.canonical_lines(spark, SF)).collect()
    ]
    assert sorted(got) == sorted(expected)
