import datetime as dt

from taxweave.functions.money import parse_money
from taxweave.operators import daily, ledger, lines, quality
from taxweave.rules import RULES

LINE = (
    "taxpayer_id long, store string, platform string, order_no string, status string, order_date date, "
    "customer_name string, item_c long, disc_c long, ship_c long, line_ord long"
)


def make_lines(spark, rows):
    """Rows of (platform, order, status, day, item, disc, ship, ord)."""
    full = [(1, "a", p, o, s, d, "c", i, dc, sh, n) for p, o, s, d, i, dc, sh, n in rows]
    frame = spark.createDataFrame(full, LINE)
    return frame.selectExpr("*", "year(order_date) AS year", "month(order_date) AS month")


DAY = dt.date(2024, 3, 5)


def export(spark, platform, **values):
    rule = RULES[platform]
    names = list(rule.columns)
    row = [1, "a", *[values.get(n) for n in names]]
    schema = "taxpayer_id long, store string, " + ", ".join(f"`{rule.columns[n]}` string" for n in names)
    return spark.createDataFrame([tuple(row)], schema)


def test_tiktok_row(spark):
    raw = export(
        spark, "TikTok", order_no="007\t", status="Completed", ordered_at="5/3/2024 1:02:03\t",
        item="THB 1,234.50", discount="THB 0.10", shipping="THB 0", customer_name="x",
    )
    row = lines.normalise_order_lines(raw, "TikTok").first()
    assert (row.order_no, row.order_date, row.item_c, row.disc_c, row.ship_c) == ("007", DAY, 123450, 10, 0)
    assert (row.year, row.month) == (2024, 3)


def test_shopee_and_lazada_rows(spark):
    raw = export(spark, "Shopee", order_no="01", ordered_at="2024-03-05 23:59", item="-1.5", discount=None, shipping="12")
    row = lines.normalise_order_lines(raw, "Shopee").first()
    assert (row.order_no, row.order_date, row.item_c, row.disc_c, row.ship_c) == ("01", DAY, -150, None, 1200)
    raw = export(spark, "Lazada", order_no="01", ordered_at="05 Mar 2024 09:07", item="10.99")
    row = lines.normalise_order_lines(raw, "Lazada").first()
    assert (row.order_date, row.item_c, row.disc_c, row.ship_c) == (DAY, 1099, None, None)


def test_unreadable_values_are_counted_and_not_fatal(spark):
    raw = export(spark, "TikTok", order_no="1", ordered_at="2024-03-05", item="abc", discount="THB 1", shipping="THB 1")
    read = lines.normalise_order_lines(raw, "TikTok")
    found = quality.unreadable_lines(read).first()
    assert (found.no_order_no, found.no_date, found.no_amount, found.no_discount) == (0, 1, 1, 0)


def test_money_texts(spark):
    texts = ["THB 1,234.50", "฿1,000", "-0.01", " 5 ", "", None, "1.2.3"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(parse_money(frame.t)).collect()]
    assert got == [123450, 100000, -1, 500, None, None, None]


def test_missing_status_is_kept_and_words_belong_to_platforms(spark):
    frame = make_lines(
        spark,
        [
            ("Shopee", "1", None, DAY, 1, 0, 0, 1),
            ("Shopee", "2", "ยกเลิกแล้ว", DAY, 1, 0, 0, 2),
            ("Shopee", "3", "canceled", DAY, 1, 0, 0, 3),
            ("Lazada", "4", "canceled", DAY, 1, 0, 0, 4),
            ("Lazada", "5", "Package Returned", DAY, 1, 0, 0, 5),
            ("TikTok", "6", "Canceled", DAY, 1, 0, 0, 6),
            ("TikTok", "7", "canceled", DAY, 1, 0, 0, 7),
        ],
    )
    assert sorted(r.order_no for r in lines.drop_cancelled(frame).collect()) == ["1", "3", "7"]


def test_copies(spark):
    rows = [(p, "1", None, DAY, 100, 10, 7, n) for p in RULES for n in (5, 3)]
    unique = lines.dedup_lines(make_lines(spark, rows))
    assert {(r.platform, r.line_ord, r.copies) for r in unique.collect()} == {(p, 3, 2) for p in RULES}
    sold = {r.platform: (r.order_c, r.ship_c) for r in daily.daily_sales(daily.order_totals_by_day(unique)).collect()}
    # Only the platform whose daily job keeps duplicates counts them.
    assert sold == {"Shopee": (90, 7), "Lazada": (200, 0), "TikTok": (90, 7)}
    booked = {r.platform: r.goods_c for r in ledger.order_totals(unique).collect()}
    assert booked == {"Shopee": 90, "Lazada": 100, "TikTok": 90}


def test_first_line_and_summed_discount(spark):
    rows = [
        ("Shopee", "1", "b", DAY, 100, 5, 0, 2),
        ("Shopee", "1", "a", DAY, 50, 9, 30, 1),
        ("TikTok", "1", "b", DAY, 100, 5, 0, 2),
        ("TikTok", "1", "a", DAY, 50, 9, 30, 1),
        ("Lazada", "1", "b", DAY, 100, 5, 9, 2),
        ("Lazada", "1", "a", DAY, 50, 9, 30, 1),
    ]
    for order in (rows, rows[::-1]):
        orders = ledger.order_totals(make_lines(spark, order)).collect()
        assert {(r.platform, r.status, r.goods_c, r.service_c) for r in orders} == {
            ("Shopee", "a", 141, 30),
            ("TikTok", "a", 136, 30),
            ("Lazada", "a", 150, 0),
        }


def test_missing_discount_counts_as_zero(spark):
    frame = make_lines(spark, [("Shopee", "1", None, DAY, 100, None, None, 1)])
    row = daily.order_totals_by_day(frame).first()
    assert (row.order_c, row.ship_c) == (100, 0)


def test_lines_without_order_number(spark):
    frame = make_lines(spark, [(p, None, None, DAY, 100, 0, 0, 1) for p in RULES])
    assert [(r.platform, r.order_c) for r in daily.order_totals_by_day(frame).collect()] == [("Lazada", 100)]
    assert ledger.order_totals(frame).count() == 0


def test_open_month(spark):
    days = [dt.date(2023, 12, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 1), dt.date(2024, 4, 1)]
    frame = make_lines(spark, [("Shopee", str(i), None, d, 1, 0, 0, i) for i, d in enumerate(days)])
    kept = lines.exclude_open_month(frame, dt.date(2024, 3, 20))
    assert sorted(r.order_date for r in kept.collect()) == days[:2]
    kept = lines.exclude_open_month(frame, dt.date(2024, 1, 20))
    assert sorted(r.order_date for r in kept.collect()) == days[:1]


def test_shipping_row_only_where_paid(spark):
    frame = make_lines(
        spark,
        [("Shopee", "1", None, DAY, 10700, 0, 1070, 1), ("Shopee", "2", None, DAY, 214, 0, 0, 2), ("Lazada", "3", None, DAY, 107, 0, 50, 3)],
    )
    rows = ledger.sales_ledger(ledger.order_totals(frame)).collect()
    assert {(r.order_no, r.type, r.before_vat_c, r.vat_c, r.include_vat_c) for r in rows} == {
        ("1", "สินค้า", 10000, 700, 10700),
        ("1", "บริการ", 1000, 70, 1070),
        ("2", "สินค้า", 200, 14, 214),
        ("3", "สินค้า", 100, 7, 107),
    }


def test_status_findings(spark):
    rows = [
        ("Shopee", "1", "สำเร็จแล้ว", DAY, 1, 0, 0, 1),
        ("Shopee", "2", None, DAY, 1, 0, 0, 2),
        ("Shopee", "3", "x", DAY, 1, 0, 0, 3),
        ("Shopee", "3", "y", DAY, 1, 0, 0, 4),
    ]
    row = quality.incomplete_orders(make_lines(spark, rows)).first()
    assert (row.open_orders, row.open_statuses) == (2, 3)


def test_missing_months_by_date(spark):
    frame = make_lines(spark, [(p, "1", None, dt.date(2024, m, 1), 1, 0, 0, m) for p in ("Shopee", "TikTok") for m in (1, 3)])

    def found(as_of):
        return {(r.platform, r.missing_months, r.severity) for r in quality.missing_months(frame, 2024, as_of).collect()}

    assert found(dt.date(2024, 5, 2)) == {("Shopee", "2, 4", "warn"), ("TikTok", "2, 4", "reject")}
    assert found(dt.date(2024, 1, 2)) == set()
    assert {m for _, m, _ in found(dt.date(2025, 1, 2))} == {"2, 4, 5, 6, 7, 8, 9, 10, 11, 12"}


def test_period_findings(spark):
    days = [dt.date(2023, 3, 1), dt.date(2023, 4, 1), dt.date(2024, 4, 1), dt.date(2024, 3, 1)]
    frame = make_lines(spark, [("Shopee", "1", None, d, 1, 0, 0, i) for i, d in enumerate(days)])
    row = quality.foreign_period_rows(frame, 2024, 3).first()
    assert (row.foreign_rows, row.foreign_rows_both, row.other_years) == (3, 1, "2023")
    assert quality.wrong_period_sources(frame, 2024).count() == 0
    assert quality.wrong_period_sources(frame, 2022).first().years == "2023, 2024"
    assert quality.reject_wrong_period(frame, 2022).count() == 0
    assert quality.wrong_period_sources(frame.limit(0), 2022).count() == 0
