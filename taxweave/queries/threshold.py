"""Queries of the threshold job."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from taxweave import fixtures as fx
from taxweave.operators import daily, lines
from taxweave.plans import balances, landing, threshold
from taxweave.queries.sql import SOURCE, sql
from taxweave.session import fresh_folder, settle
from taxweave.sinks import reports

MID_YEAR = dt.date(2001, 6, 15)
SEEN_ON = dt.date(2001, 9, 10)
JANUARY = dt.date(2001, 1, 10)
LINE = "taxpayer_id, store, platform, order_no, status, order_date, customer_name, item_c, disc_c, ship_c, sku, quantity, year, month"
LINE_COLUMNS = LINE.split(", ")


def _daily(spark, sf_dir):
    return threshold.daily_from_lines(fx.canonical_lines(spark, sf_dir))


def _totals(spark, sf_dir):
    return daily.row_total(_daily(spark, sf_dir))


def threshold_status(spark, sf_dir):
    return threshold.status_from_lines(fx.canonical_lines(spark, sf_dir))


def threshold_status_strict(spark, sf_dir):
    """The verdict of 2001 on sources that are complete."""
    kept = threshold.strict_lines(fx.canonical_lines(spark, sf_dir), 2001, SEEN_ON)
    return threshold.status_from_lines(kept, 2001).drop("reached_label", "total_label")


def drop_cancelled(spark, sf_dir):
    return lines.drop_cancelled(fx.canonical_lines(spark, sf_dir)).drop("line_ord")


def filter_period(spark, sf_dir):
    return lines.filter_period(fx.canonical_lines(spark, sf_dir), 1998, 3).drop("line_ord")


def exclude_open_month(spark, sf_dir):
    return lines.exclude_open_month(fx.canonical_lines(spark, sf_dir), MID_YEAR).drop("line_ord")


def exclude_open_month_january(spark, sf_dir):
    return lines.exclude_open_month(fx.canonical_lines(spark, sf_dir), JANUARY).drop("line_ord")


def dedup_lines(spark, sf_dir):
    return lines.dedup_lines(lines.drop_cancelled(fx.canonical_lines(spark, sf_dir)))


def order_totals_by_day(spark, sf_dir):
    return threshold.order_totals_from_lines(fx.canonical_lines(spark, sf_dir))


def dense_calendar(spark, sf_dir):
    return daily.dense_calendar(_daily(spark, sf_dir))


def dense_calendar_open_month(spark, sf_dir):
    sales = threshold.daily_from_lines(fx.canonical_lines(spark, sf_dir), 2001, MID_YEAR)
    return daily.dense_calendar(sales, MID_YEAR)


def daily_matrix(spark, sf_dir):
    return daily.daily_matrix(_daily(spark, sf_dir), fx.STORES)


def daily_report(spark, sf_dir):
    return daily.daily_report(_daily(spark, sf_dir), fx.STORES)


def grand_total(spark, sf_dir):
    return daily.grand_total(_daily(spark, sf_dir))


def running_total(spark, sf_dir):
    return daily.running_total(_totals(spark, sf_dir))


def _named_stores(spark, sf_dir):
    """Daily sales of stores with names of their taxpayer's own, up to six of them."""
    name = F.concat(F.lit("t"), (F.col("taxpayer_id") % 97).cast("string"), F.when(F.month("date") % 2 == 0, "-outlet-").otherwise("-"), "store")
    return _daily(spark, sf_dir).withColumn("store", name)


def _numbered(spark, sf_dir):
    sales = settle(_named_stores(spark, sf_dir), "daily")
    return daily.numbered(sales, daily.store_numbers(sales))


def store_numbers(spark, sf_dir):
    return daily.store_numbers(_named_stores(spark, sf_dir))


def numbered_report(spark, sf_dir):
    return daily.numbered_report(_numbered(spark, sf_dir))


def further_stores(spark, sf_dir):
    return daily.further_stores(_numbered(spark, sf_dir))


def _gated(spark, sf_dir):
    manifest = fx.monthly_manifest(spark, sf_dir).select("taxpayer_id", "store", "platform", "kind", "year")
    return threshold.gated_status(fx.canonical_lines(spark, sf_dir), fx.store_selection(spark, sf_dir), manifest)


def threshold_gated(spark, sf_dir):
    """Verdicts of the taxpayer-years with an export of every selected store and platform."""
    return _gated(spark, sf_dir).result


def threshold_left_out(spark, sf_dir):
    """The exports that the other taxpayer-years lack."""
    return _gated(spark, sf_dir).left_out


def carried_balances(spark, sf_dir):
    """Verdicts carried through four landings: late years first, then early ones with copies of the late, an upload
    with a mistake, and its correction."""
    rows = fx.canonical_lines(spark, sf_dir)
    landed, path = fresh_folder(spark, "lines"), fresh_folder(spark, "balances")
    wrong = rows.filter("month = 5").withColumn("item_c", F.col("item_c") * 9)
    for name, part in (("late", rows.filter("year >= 1998")), ("fix", wrong), ("early", rows.filter("year <= 1998")), ("fix", rows.filter("month = 5"))):
        landing.write_order_lines(lines.dedup_lines(part), landed, name)
        balances.update(spark, landed, path)
    return balances.status(spark, path)


def write_daily_sales(spark, sf_dir):
    path = fresh_folder(spark, "daily")
    report = daily_report(spark, sf_dir)
    reports.write_daily_sales(report, path)
    return reports.read_written(spark, path, report.schema)


def run_audit_threshold(spark, sf_dir):
    # Three audits read the daily sales; they are computed once.
    amounts = settle(_daily(spark, sf_dir).select("taxpayer_id", "store", (F.col("order_c") + F.col("ship_c")).alias("amount_c")), "amounts")
    path = fresh_folder(spark, "audit")
    at = dt.datetime(2002, 1, 5, 9, 30)
    reports.append_run_audit(reports.run_audit(amounts, "threshold", "1995-2001", at, "person"), path)
    recent = amounts.filter(F.col("amount_c") > 0)
    for _ in range(2):  # a retried run is one run
        reports.append_run_audit(reports.run_audit(recent, "threshold", "1995-2001", at, "company"), path)
    return reports.read_written(spark, path, reports.run_audit(amounts, "", "", at, "").schema)


_MATRIX = ", ".join(
    f"CAST(sum(CASE WHEN store = '{s}' AND platform = '{p}' THEN {m} ELSE 0 END) AS BIGINT) AS {s}_{p.lower()}_{n}"
    for s in ("store1", "store2", "store3")
    for p in ("Shopee", "Lazada", "TikTok")
    for m, n in (("order_c", "order_value"), ("ship_c", "shipping_value"))
)
_WIDE = ", ".join(
    f"coalesce({s}_{p}_{n}, 0) AS {s}_{p}_{n}"
    for s in ("store1", "store2", "store3")
    for p in ("shopee", "lazada", "tiktok")
    for n in ("order_value", "shipping_value")
)
_DAYS = """SELECT {keys}, CAST(year AS INTEGER) AS year, CAST(unnest(generate_series(make_date(year, 1, 1), {end}, INTERVAL 1 DAY)) AS DATE) AS date
FROM (SELECT DISTINCT {keys}, year(date) AS year FROM {rows})"""

_REPORT = sql(
    f"""SELECT d.taxpayer_id, d.year, d.date, {_WIDE}, coalesce(sum_c, 0) AS sum_c,
       CAST(sum(coalesce(sum_c, 0)) OVER (PARTITION BY d.taxpayer_id, d.year ORDER BY d.date) AS BIGINT) AS cum_c
FROM ({_DAYS.format(keys="taxpayer_id", end="make_date(year, 12, 31)", rows="daily")}) d
LEFT JOIN (SELECT taxpayer_id, date, {_MATRIX}, CAST(sum(order_c + ship_c) AS BIGINT) AS sum_c FROM daily GROUP BY taxpayer_id, date) m
  ON d.taxpayer_id = m.taxpayer_id AND d.date = m.date""",
    "daily",
)

_STORES = """SELECT * REPLACE ('t' || CAST(taxpayer_id % 97 AS VARCHAR) || CASE WHEN month(date) % 2 = 0 THEN '-outlet-' ELSE '-' END || store AS store) FROM daily"""
_NUMBERED = f"""SELECT d.* EXCLUDE (store), number FROM ({_STORES}) d
JOIN (SELECT taxpayer_id, store, CAST(row_number() OVER (PARTITION BY taxpayer_id ORDER BY store) AS INTEGER) AS number
      FROM (SELECT DISTINCT taxpayer_id, store FROM ({_STORES}))) n USING (taxpayer_id, store)"""
_LACKING = f"""SELECT s.taxpayer_id, s.store, s.platform, y.year, 'sale' AS kind
FROM selection s JOIN (SELECT DISTINCT taxpayer_id, year FROM running) y USING (taxpayer_id)
WHERE NOT EXISTS (SELECT 1 FROM monthly m WHERE m.taxpayer_id = s.taxpayer_id AND m.store = s.store AND m.platform = s.platform
  AND m.year = y.year AND m.kind = 'sale')"""

_AUDIT = """SELECT taxpayer_id, 'threshold' AS job, '1995-2001' AS period, '2002-01-05 09:30:00' AS run_at, '{user}' AS user_type,
  string_agg(DISTINCT store, ', ' ORDER BY store) AS stores, CAST(sum(order_c + ship_c) AS BIGINT) AS total_c
FROM daily WHERE {where} GROUP BY taxpayer_id"""

QUERIES = {
    "threshold_status": (
        threshold_status,
        sql(
            """SELECT taxpayer_id, year,
  CASE WHEN reached_on IS NOT NULL THEN 'red' WHEN top_c > 150000000 THEN 'amber' ELSE 'green' END AS status,
  reached_on, strftime(reached_on, '%d %b %Y') AS reached_label, total_c,
  CAST((total_c + 500000) // 1000000 // 100 AS VARCHAR) || '.'
    || lpad(CAST((total_c + 500000) // 1000000 % 100 AS VARCHAR), 2, '0') || ' M' AS total_label
FROM (SELECT taxpayer_id, year, min(CASE WHEN cum_c >= 180000000 THEN date END) AS reached_on, max(cum_c) AS top_c,
             CAST(sum(sum_c) AS BIGINT) AS total_c FROM running GROUP BY taxpayer_id, year)""",
            "running",
        ),
    ),
    "threshold_status_strict": (
        threshold_status_strict,
        sql(
            f"""SELECT taxpayer_id, year, CASE WHEN reached_on IS NOT NULL THEN 'red' WHEN top_c > 150000000 THEN 'amber' ELSE 'green' END AS status,
  reached_on, total_c
FROM (SELECT taxpayer_id, year, min(CASE WHEN cum_c >= 180000000 THEN date END) AS reached_on, max(cum_c) AS top_c,
             CAST(sum(sum_c) AS BIGINT) AS total_c
      FROM (SELECT taxpayer_id, CAST(year(date) AS INTEGER) AS year, date, sum_c, sum(sum_c) OVER (PARTITION BY taxpayer_id ORDER BY date) AS cum_c
            FROM (SELECT taxpayer_id, date, sum(order_c + ship_c) AS sum_c FROM daily WHERE year(date) = 2001 AND (platform <> 'TikTok' OR
                    EXISTS (SELECT 1 FROM (SELECT {SOURCE} FROM kept WHERE year = 2001 AND month <= 8 GROUP BY {SOURCE} HAVING count(DISTINCT month) = 8) f
                      WHERE f.taxpayer_id = daily.taxpayer_id AND f.store = daily.store AND f.platform = daily.platform))
                  GROUP BY taxpayer_id, date)) GROUP BY taxpayer_id, year)""",
            "daily", "kept",
        ),
    ),
    "threshold_gated": (
        threshold_gated,
        sql(
            f"""SELECT taxpayer_id, year,
  CASE WHEN reached_on IS NOT NULL THEN 'red' WHEN top_c > 150000000 THEN 'amber' ELSE 'green' END AS status,
  reached_on, strftime(reached_on, '%d %b %Y') AS reached_label, total_c,
  CAST((total_c + 500000) // 1000000 // 100 AS VARCHAR) || '.'
    || lpad(CAST((total_c + 500000) // 1000000 % 100 AS VARCHAR), 2, '0') || ' M' AS total_label
FROM (SELECT taxpayer_id, year, min(CASE WHEN cum_c >= 180000000 THEN date END) AS reached_on, max(cum_c) AS top_c,
             CAST(sum(sum_c) AS BIGINT) AS total_c FROM running GROUP BY taxpayer_id, year)
WHERE (taxpayer_id, year) NOT IN (SELECT (taxpayer_id, year) FROM ({_LACKING}))""",
            "running", "selection", "monthly",
        ),
    ),
    "drop_cancelled": (drop_cancelled, sql(f"SELECT {LINE} FROM kept", "kept")),
    "filter_period": (filter_period, sql(f"SELECT {LINE} FROM lines WHERE year = 1998 AND month = 3", "lines")),
    "exclude_open_month": (
        exclude_open_month,
        sql(f"SELECT {LINE} FROM lines WHERE year <> 2001 OR order_date <= DATE '2001-05-31'", "lines"),
    ),
    "exclude_open_month_january": (
        exclude_open_month_january,
        sql(f"SELECT {LINE} FROM lines WHERE year <> 2001 OR order_date <= DATE '2001-01-10'", "lines"),
    ),
    "dedup_lines": (dedup_lines, sql(f"SELECT {LINE}, line_ord, copies FROM deduped", "deduped")),
    "order_totals_by_day": (order_totals_by_day, sql("SELECT * FROM order_day", "order_day")),
    "daily_sales": (_daily, sql("SELECT * FROM daily", "daily")),
    "dense_calendar": (
        dense_calendar,
        sql(
            f"""SELECT d.*, coalesce(order_c, 0) AS order_c, coalesce(ship_c, 0) AS ship_c
FROM ({_DAYS.format(keys=SOURCE, end="make_date(year, 12, 31)", rows="daily")}) d
LEFT JOIN daily USING ({SOURCE}, date)""",
            "daily",
        ),
    ),
    "dense_calendar_open_month": (
        dense_calendar_open_month,
        sql(
            f"""SELECT d.*, coalesce(order_c, 0) AS order_c, coalesce(ship_c, 0) AS ship_c
FROM ({_DAYS.format(keys=SOURCE, end="DATE '2001-05-31'", rows="(SELECT * FROM daily WHERE date BETWEEN DATE '2001-01-01' AND DATE '2001-05-31')")}) d
LEFT JOIN daily USING ({SOURCE}, date)""",
            "daily",
        ),
    ),
    "daily_matrix": (
        daily_matrix,
        sql(f"SELECT taxpayer_id, date, {_MATRIX} FROM daily GROUP BY taxpayer_id, date", "daily"),
    ),
    "row_total": (_totals, sql("SELECT * FROM totals", "totals")),
    "grand_total": (
        grand_total,
        sql(
            """SELECT taxpayer_id, CAST(year(date) AS INTEGER) AS year, CAST(sum(order_c + ship_c) AS BIGINT) AS total_c
FROM daily GROUP BY taxpayer_id, year(date)""",
            "daily",
        ),
    ),
    "running_total": (running_total, sql("SELECT * FROM running", "running")),
    "daily_report": (daily_report, _REPORT),
    "store_numbers": (
        store_numbers,
        sql(
            f"""SELECT taxpayer_id, store, CAST(row_number() OVER (PARTITION BY taxpayer_id ORDER BY store) AS INTEGER) AS number
FROM (SELECT DISTINCT taxpayer_id, store FROM ({_STORES}))""",
            "daily",
        ),
    ),
    "numbered_report": (
        numbered_report,
        sql(
            f"""SELECT d.taxpayer_id, d.year, d.date, {_WIDE}, coalesce(sum_c, 0) AS sum_c,
       CAST(sum(coalesce(sum_c, 0)) OVER (PARTITION BY d.taxpayer_id, d.year ORDER BY d.date) AS BIGINT) AS cum_c
FROM ({_DAYS.format(keys="taxpayer_id", end="make_date(year, 12, 31)", rows="daily")}) d
LEFT JOIN (SELECT taxpayer_id, date, {_MATRIX}, CAST(sum(order_c + ship_c) AS BIGINT) AS sum_c
           FROM (SELECT *, 'store' || CAST(number AS VARCHAR) AS store FROM ({_NUMBERED})) GROUP BY taxpayer_id, date) m
  ON d.taxpayer_id = m.taxpayer_id AND d.date = m.date""",
            "daily",
        ),
    ),
    "further_stores": (further_stores, sql(f"SELECT * FROM ({_NUMBERED}) WHERE number > 3", "daily")),
    "threshold_left_out": (threshold_left_out, sql(_LACKING, "running", "selection", "monthly")),
    "write_daily_sales": (write_daily_sales, _REPORT),
    "run_audit_threshold": (
        run_audit_threshold,
        sql(_AUDIT.format(user="person", where="true") + " UNION ALL " + _AUDIT.format(user="company", where="order_c + ship_c > 0"), "daily"),
    ),
}

QUERIES["carried_balances"] = (carried_balances, QUERIES["threshold_status"][1])
