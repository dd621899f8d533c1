"""Queries over exports as files, and the data-quality findings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from taxweave import fixtures as fx
from taxweave.operators import inputs, ledger, lines, quality
from taxweave.plans import landing
from taxweave.plans import threshold as plans_threshold
from taxweave.plans import vat as plans_vat
from taxweave.queries import threshold, vat
from taxweave.queries.sql import SOURCE, sql
from taxweave.rules import RULES
from taxweave.session import fresh_folder, forget, settle, tidy
from taxweave.sources import exports, manifest
from taxweave.sources.documents import scan_invoice_docs

SEEN_ON = dt.date(2001, 9, 10)
EXPORTED = ["taxpayer_id", "store", "platform", "order_no", "status", "order_date", "customer_name", "item_c", "disc_c", "ship_c"]


def _scan(spark, sf_dir, platform):
    root = fx.write_exports(spark, sf_dir, platform)
    return exports.scan_order_export(spark, root, fmt="csv" if platform == "TikTok" else "parquet")


def _scanned_lines(platform):
    def query(spark, sf_dir):
        read = lines.normalise_order_lines(_scan(spark, sf_dir, platform), platform)
        return read.withColumn("taxpayer_id", F.col("taxpayer_id").cast("long")).select(*EXPORTED)

    return query


def normalise_order_lines(spark, sf_dir):
    """All three exports in memory, brought back to order lines."""
    rows = fx.order_lines(spark, sf_dir)
    each = [lines.normalise_order_lines(fx.render_export(rows, p), p) for p in RULES]
    return exports.union_exports(each).select(*EXPORTED, "year", "month")


def union_exports(spark, sf_dir):
    """Raw exports with different columns, aligned by name."""
    every = exports.union_exports([_scan(spark, sf_dir, p) for p in RULES])
    numbers = [F.replace(F.col(f"`{RULES[p].columns['order_no']}`"), F.lit("\t"), F.lit("")).alias(f"{p.lower()}_order") for p in RULES]
    return every.select(F.col("taxpayer_id").cast("long").alias("taxpayer_id"), "store", *numbers, "sku")


def ledger_from_exports(spark, sf_dir):
    """Order totals from the scanned files: copies are dropped on the export's
    own columns and the first line is the file's first."""
    parts = []
    for platform in RULES:
        unique = lines.dedup_lines(lines.drop_cancelled_export(_scan(spark, sf_dir, platform), platform))
        parts.append(ledger.sales_ledger(ledger.order_totals(lines.normalise_order_lines(unique, platform))))
    rows = _long_ids(ledger.union_ledgers(parts))
    return rows.select("taxpayer_id", "store", "platform", "type", "order_date", "status", "order_no", "vat_c", "include_vat_c")


def _landed(spark, sf_dir):
    roots = {p: fx.write_exports(spark, sf_dir, p) for p in RULES}
    formats = {p: "csv" if p == "TikTok" else "parquet" for p in RULES}
    path = fresh_folder(spark, "lines")
    landing.write_order_lines(landing.lines_from_exports(spark, roots, formats), path)
    return landing.read_order_lines(spark, path)


def _long_ids(df):
    """The tables' taxpayers are numbers; exports give ids as text, with their zeros."""
    return df.withColumn("taxpayer_id", F.col("taxpayer_id").cast("long"))


def land_order_lines(spark, sf_dir):
    return _long_ids(_landed(spark, sf_dir)).select(*EXPORTED, "year", "month", "copies")


def _unique(spark, sf_dir):
    """The lines without copies, written once for queries that land several uploads of them. Parts of them by
    month or order are free of copies too."""
    return settle(lines.dedup_lines(fx.canonical_lines(spark, sf_dir)), "unique")


def land_second_upload(spark, sf_dir):
    """All lines landed, then every third order once more in an upload of its own and
    replaced there: what the first upload landed stays."""
    rows = _unique(spark, sf_dir)
    path = fresh_folder(spark, "lines")
    landing.write_order_lines(rows, path, "first")
    again = rows.filter(F.pmod(F.col("order_no").cast("long"), F.lit(3)) == 0).withColumn("order_no", F.concat(F.lit("x"), "order_no"))
    for _ in range(2):
        landing.write_order_lines(again, path, "second")
    forget(rows)
    return landing.read_order_lines(spark, path).drop("line_ord", "extra")


def land_same_upload_twice(spark, sf_dir):
    """All lines landed as one upload, again under its own name and again under another: the
    verdict is the one of a single upload."""
    rows = _unique(spark, sf_dir)
    path = fresh_folder(spark, "lines")
    for batch in (None, None, "once more"):
        landing.write_order_lines(rows, path, batch)
    forget(rows)
    return plans_threshold.status_from_lines(landing.read_order_lines(spark, path))


def _overlapping(spark, rows):
    """Three uploads that share lines: orders up to 1998, orders from 1997 on, and every third order with its lines twice."""
    path = fresh_folder(spark, "lines")
    twice = rows.filter(F.pmod(F.col("order_no").cast("long"), F.lit(3)) == 0)
    for batch, part in (("early", rows.filter("year <= 1998")), ("late", rows.filter("year >= 1997")), ("twice", lines.dedup_lines(twice.union(twice)))):
        landing.write_order_lines(lines.without_copies(part), path, batch)
    return path


def land_overlapping_uploads(spark, sf_dir):
    """Every line as often as in the upload that has it most often."""
    rows = _unique(spark, sf_dir)
    landed = landing.read_order_lines(spark, _overlapping(spark, rows))
    forget(rows)
    keys = [c for c in landed.columns if c not in ("line_ord", "copies", "extra")]
    return landed.groupBy(*keys).agg(F.sum("copies").alias("copies"))


def replace_overlapping_upload(spark, sf_dir):
    """One of the uploads replaced by one without lines of 1997: those come back as the other upload has them."""
    rows = _unique(spark, sf_dir)
    path = _overlapping(spark, rows)
    landing.write_order_lines(rows.filter("year < 1997"), path, "early")
    forget(rows)
    landed = landing.read_order_lines(spark, path)
    keys = [c for c in landed.columns if c not in ("line_ord", "copies", "extra")]
    return landed.groupBy(*keys).agg(F.sum("copies").alias("copies"))


def vat_of_overlapping_uploads(spark, sf_dir):
    """The sales ledger counts a line once, however many uploads and copies have it."""
    return plans_vat.sales_from_lines(landing.read_order_lines(spark, _overlapping(spark, fx.canonical_lines(spark, sf_dir))))


def threshold_from_exports(spark, sf_dir):
    """The threshold check from files to verdict."""
    return _long_ids(plans_threshold.status_from_lines(_landed(spark, sf_dir)))


def vat_return_from_exports(spark, sf_dir):
    """The VAT return from files to the five measures."""
    pages = fresh_folder(spark, "pages")
    with tidy(spark):
        fx.invoice_pages(spark, sf_dir).write.option("compression", "zstd").parquet(pages)
    return plans_vat.vat_months(_long_ids(_landed(spark, sf_dir)), scan_invoice_docs(spark, pages)).summary


PLACE = ("kind", "platform", "store", "taxpayer_group")


def scan_input_manifest(spark, sf_dir):
    """Sale exports and fee documents of all platforms, from their listing."""
    roots = [*(fx.write_exports(spark, sf_dir, p) for p in RULES), fx.write_fee_files(spark, sf_dir)]
    files = manifest.scan_input_manifest(spark, roots, "*.{csv,parquet}", PLACE)
    return files.groupBy(*PLACE).agg((F.min("length") > 0).alias("has_rows"))


def _incomplete(spark, sf_dir):
    return {fmt: {p: fx.write_incomplete_exports(spark, sf_dir, p, fmt) for p in RULES} for fmt in ("csv", "parquet")}


def missing_columns(spark, sf_dir):
    """Exports of all platforms, as CSV and as Parquet, that lack a required column."""
    parts = []
    for fmt, roots in _incomplete(spark, sf_dir).items():
        found = landing.quarantined_exports(spark, roots, dict.fromkeys(roots, fmt))
        place = [F.regexp_extract("file_path", f"/{name}=([^/]*)/", 1).alias(name) for name in PLACE[2:]]
        parts.append(found.select(F.lit(fmt).alias("format"), "platform", *place, "missing").distinct())
    return exports.union_exports(parts)


def land_without_quarantined(spark, sf_dir):
    """Lines of files that lack a column aren't landed, all others are: CSV files of two platforms, Parquet of one."""
    formats = {"Shopee": "parquet", "Lazada": "csv", "TikTok": "csv"}
    roots = {p: fx.write_incomplete_exports(spark, sf_dir, p, f) for p, f in formats.items()}
    path = fresh_folder(spark, "lines")
    landing.write_order_lines(landing.lines_from_exports(spark, roots, formats), path)
    return _long_ids(landing.read_order_lines(spark, path)).select(*EXPORTED, "year", "month", "copies")


def findings_of_a_profile(spark, sf_dir):
    """All findings about 2001 from one profile of the lines, one row each."""
    found = plans_threshold.findings(fx.canonical_lines(spark, sf_dir), 2001, SEEN_ON)
    number, text = {"wrong_period_sources": "outside_rows", "foreign_period_rows": "foreign_rows", "incomplete_orders": "open_orders", "unreadable_lines": "no_discount"}, {
        "wrong_period_sources": "years", "foreign_period_rows": "other_years", "missing_months": "missing_months",
    }
    parts = []
    for name, rows in found.items():
        n = F.col(number[name]) if name in number else F.lit(None)
        detail = F.col(text[name]) if name in text else F.lit(None)
        parts.append(rows.select("taxpayer_id", "store", "platform", F.lit(name).alias("finding"), n.cast("long").alias("n"), detail.cast("string").alias("detail")))
    return exports.union_exports(parts)


def _kept(spark, sf_dir):
    return lines.drop_cancelled(fx.canonical_lines(spark, sf_dir))


def incomplete_orders(spark, sf_dir):
    return quality.incomplete_orders(_kept(spark, sf_dir))


def wrong_period_sources(spark, sf_dir):
    return quality.wrong_period_sources(_kept(spark, sf_dir), 2001)


def reject_wrong_period(spark, sf_dir):
    return quality.reject_wrong_period(_kept(spark, sf_dir), 2001).drop("line_ord")


def foreign_period_rows(spark, sf_dir):
    return quality.foreign_period_rows(_kept(spark, sf_dir), 1998, 3)


def foreign_year_rows(spark, sf_dir):
    return quality.foreign_period_rows(_kept(spark, sf_dir), 1998).drop("foreign_rows_both")


def missing_months(spark, sf_dir):
    return quality.missing_months(_kept(spark, sf_dir), 2001, SEEN_ON)


def missing_months_full_year(spark, sf_dir):
    return quality.missing_months(_kept(spark, sf_dir), 1998, SEEN_ON)


def unreadable_lines(spark, sf_dir):
    return quality.unreadable_lines(_kept(spark, sf_dir))


def missing_inputs(spark, sf_dir):
    return inputs.missing_inputs(fx.store_selection(spark, sf_dir), fx.input_manifest(spark, sf_dir))


def prune_inputs(spark, sf_dir):
    return inputs.prune_inputs(fx.input_manifest(spark, sf_dir), fx.store_selection(spark, sf_dir))


def store_name_findings(spark, sf_dir):
    return inputs.store_name_findings(fx.entered_stores(spark, sf_dir))


_UPLOADED = sql(
    f"""SELECT {threshold.LINE}, n * CASE WHEN CAST(order_no AS BIGINT) % 3 = 0 THEN 2 ELSE 1 END AS copies
FROM (SELECT {threshold.LINE}, count(*) AS n FROM lines GROUP BY ALL)""",
    "lines",
)
_DISCOUNT = "CASE WHEN platform = 'Lazada' THEN NULL ELSE disc_c END AS disc_c"
_SHIPPING = "CASE WHEN platform = 'Lazada' THEN NULL ELSE ship_c END AS ship_c"
_SHORT = " ".join(f"WHEN '{p}' THEN '{rule.columns.get('discount', rule.columns['item'])}'" for p, rule in RULES.items())
_EXPORTED = f"{SOURCE}, order_no, status, order_date, customer_name, item_c, {_DISCOUNT}, {_SHIPPING}"


def _months(year: int, last: int) -> str:
    return sql(
        f"""SELECT {SOURCE}, string_agg(CAST(m AS VARCHAR), ', ' ORDER BY m) AS missing_months,
  CASE platform WHEN 'TikTok' THEN 'reject' ELSE 'warn' END AS severity
FROM (SELECT DISTINCT {SOURCE} FROM kept WHERE year = {year}) s, range(1, {last + 1}) AS months(m)
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.year = {year} AND k.taxpayer_id = s.taxpayer_id AND k.store = s.store
  AND k.platform = s.platform AND k.month = m)
GROUP BY {SOURCE}""",
        "kept",
    )


_YEARS = "coalesce(string_agg(DISTINCT CASE WHEN year <> {y} THEN CAST(year AS VARCHAR) END, ', ' ORDER BY CASE WHEN year <> {y} THEN CAST(year AS VARCHAR) END), '')"
_WRONG = f"""SELECT {SOURCE}, count(*) AS outside_rows, {_YEARS.format(y=2001)} AS years
FROM kept GROUP BY {SOURCE} HAVING count(*) FILTER (WHERE year = 2001) = 0"""

QUERIES = {
    **{
        f"scan_order_export_{p.lower()}": (_scanned_lines(p), sql(f"SELECT {_EXPORTED} FROM lines WHERE platform = '{p}'", "lines"))
        for p in RULES
    },
    "normalise_order_lines": (normalise_order_lines, sql(f"SELECT {_EXPORTED}, year, month FROM lines", "lines")),
    "union_exports": (
        union_exports,
        sql(
            """SELECT taxpayer_id, store, CASE WHEN platform = 'Shopee' THEN order_no END AS shopee_order,
  CASE WHEN platform = 'Lazada' THEN order_no END AS lazada_order, CASE WHEN platform = 'TikTok' THEN order_no END AS tiktok_order, sku FROM lines""",
            "lines",
        ),
    ),
    "ledger_from_exports": (
        ledger_from_exports,
        sql("SELECT taxpayer_id, store, platform, type, order_date, status, order_no, vat_c, include_vat_c FROM sales", "sales"),
    ),
    "land_order_lines": (
        land_order_lines,
        sql(
            f"""SELECT {_EXPORTED}, year, month, count(*) AS copies FROM lines
GROUP BY {SOURCE}, order_no, status, order_date, customer_name, item_c, disc_c, ship_c, sku, quantity, year, month""",
            "lines",
        ),
    ),
    "land_second_upload": (
        land_second_upload,
        sql(
            f"""SELECT {threshold.LINE}, count(*) AS copies FROM lines GROUP BY ALL
UNION ALL SELECT {threshold.LINE.replace("order_no", "'x' || order_no AS order_no")}, count(*) AS copies FROM lines
WHERE CAST(order_no AS BIGINT) % 3 = 0 GROUP BY ALL""",
            "lines",
        ),
    ),
    "land_same_upload_twice": (land_same_upload_twice, threshold.QUERIES["threshold_status"][1]),
    "land_overlapping_uploads": (land_overlapping_uploads, _UPLOADED),
    "replace_overlapping_upload": (replace_overlapping_upload, _UPLOADED),
    "vat_of_overlapping_uploads": (vat_of_overlapping_uploads, vat.QUERIES["sales_ledger"][1]),
    "threshold_from_exports": (threshold_from_exports, threshold.QUERIES["threshold_status"][1]),
    "vat_return_from_exports": (vat_return_from_exports, vat.QUERIES["vat_return"][1]),
    "scan_input_manifest": (
        scan_input_manifest,
        sql(
            """SELECT DISTINCT kind, platform, store, CAST(taxpayer_id % 8 AS VARCHAR) AS taxpayer_group, true AS has_rows
FROM (SELECT 'sale' AS kind, platform, store, taxpayer_id FROM lines UNION ALL SELECT 'commission', platform, store, taxpayer_id FROM invoice)""",
            "lines", "invoice",
        ),
    ),
    "missing_columns": (
        missing_columns,
        sql(
            f"""SELECT DISTINCT format, platform, store, CAST(taxpayer_id % 8 AS VARCHAR) AS taxpayer_group,
  CASE platform {_SHORT} END AS missing FROM lines, (VALUES ('csv'), ('parquet')) AS f(format) WHERE taxpayer_id % 8 % 4 = 1""",
            "lines",
        ),
    ),
    "land_without_quarantined": (
        land_without_quarantined,
        sql(
            f"""SELECT {_EXPORTED}, year, month, count(*) AS copies FROM lines WHERE taxpayer_id % 8 % 4 <> 1
GROUP BY {SOURCE}, order_no, status, order_date, customer_name, item_c, disc_c, ship_c, sku, quantity, year, month""",
            "lines",
        ),
    ),
    "incomplete_orders": (
        incomplete_orders,
        sql(
            f"""SELECT {SOURCE}, year, month, count(DISTINCT order_no) AS open_orders, count(DISTINCT coalesce(status, '')) AS open_statuses
FROM kept WHERE status IS NULL OR status NOT IN ('สำเร็จแล้ว', 'confirmed', 'Completed') GROUP BY {SOURCE}, year, month""",
            "kept",
        ),
    ),
    "wrong_period_sources": (wrong_period_sources, sql(_WRONG, "kept")),
    "reject_wrong_period": (
        reject_wrong_period,
        sql(
            f"""SELECT {SOURCE}, order_no, status, order_date, customer_name, item_c, disc_c, ship_c, sku, quantity, year, month
FROM kept WHERE ({SOURCE}) IN (SELECT ({SOURCE}) FROM kept WHERE year = 2001)""",
            "kept",
        ),
    ),
    "foreign_period_rows": (
        foreign_period_rows,
        sql(
            f"""SELECT {SOURCE}, count(*) FILTER (WHERE year <> 1998 OR month <> 3) AS foreign_rows,
  count(*) FILTER (WHERE year <> 1998 AND month <> 3) AS foreign_rows_both, {_YEARS.format(y=1998)} AS other_years
FROM kept GROUP BY {SOURCE} HAVING count(*) FILTER (WHERE year <> 1998 OR month <> 3) > 0""",
            "kept",
        ),
    ),
    "foreign_year_rows": (
        foreign_year_rows,
        sql(
            f"""SELECT {SOURCE}, count(*) FILTER (WHERE year <> 1998) AS foreign_rows, {_YEARS.format(y=1998)} AS other_years
FROM kept GROUP BY {SOURCE} HAVING count(*) FILTER (WHERE year <> 1998) > 0""",
            "kept",
        ),
    ),
    "missing_months": (missing_months, _months(2001, 8)),
    "findings_of_a_profile": (
        findings_of_a_profile,
        sql(
            f"""SELECT {SOURCE}, 'wrong_period_sources' AS finding, outside_rows AS n, years AS detail FROM ({_WRONG})
UNION ALL SELECT {SOURCE}, 'foreign_period_rows', count(*) FILTER (WHERE year <> 2001), {_YEARS.format(y=2001)}
  FROM kept GROUP BY {SOURCE} HAVING count(*) FILTER (WHERE year <> 2001) > 0
UNION ALL SELECT {SOURCE}, 'missing_months', NULL, string_agg(CAST(m AS VARCHAR), ', ' ORDER BY m)
  FROM (SELECT DISTINCT {SOURCE} FROM kept WHERE year = 2001) s, range(1, 9) AS months(m)
  WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.year = 2001 AND k.taxpayer_id = s.taxpayer_id AND k.store = s.store
    AND k.platform = s.platform AND k.month = m) GROUP BY {SOURCE}
UNION ALL SELECT {SOURCE}, 'incomplete_orders', count(DISTINCT order_no), NULL FROM kept
  WHERE year = 2001 AND (status IS NULL OR status NOT IN ('สำเร็จแล้ว', 'confirmed', 'Completed')) GROUP BY {SOURCE}
UNION ALL SELECT {SOURCE}, 'unreadable_lines', count(*) FILTER (WHERE disc_c IS NULL), NULL FROM kept
  WHERE disc_c IS NULL OR ship_c IS NULL OR item_c IS NULL GROUP BY {SOURCE}""",
            "kept",
        ),
    ),
    "missing_months_full_year": (missing_months_full_year, _months(1998, 12)),
    "unreadable_lines": (
        unreadable_lines,
        sql(
            f"""SELECT {SOURCE}, count(*) FILTER (WHERE order_no IS NULL) AS no_order_no, count(*) FILTER (WHERE order_date IS NULL) AS no_date,
  count(*) FILTER (WHERE item_c IS NULL) AS no_amount, count(*) FILTER (WHERE disc_c IS NULL) AS no_discount,
  count(*) FILTER (WHERE ship_c IS NULL) AS no_shipping
FROM kept WHERE order_no IS NULL OR order_date IS NULL OR item_c IS NULL OR disc_c IS NULL OR ship_c IS NULL GROUP BY {SOURCE}""",
            "kept",
        ),
    ),
    "missing_inputs": (
        missing_inputs,
        sql(
            f"""SELECT {SOURCE}, kind FROM selection, (VALUES ('sale'), ('commission')) AS k(kind)
EXCEPT SELECT {SOURCE}, kind FROM manifest""",
            "selection", "manifest",
        ),
    ),
    "prune_inputs": (
        prune_inputs,
        sql(f"SELECT * FROM manifest WHERE ({SOURCE}) IN (SELECT ({SOURCE}) FROM selection)", "manifest", "selection"),
    ),
    "store_name_findings": (
        store_name_findings,
        sql(
            """SELECT taxpayer_id, store, entries, finding FROM (SELECT taxpayer_id, store, count(*) AS entries FROM entered GROUP BY taxpayer_id, store),
  (VALUES ('duplicate'), ('underscore'), ('empty')) AS f(finding)
WHERE CASE finding WHEN 'duplicate' THEN entries > 1 WHEN 'underscore' THEN contains(store, '_') ELSE trim(store) = '' END""",
            "entered",
        ),
    ),
}
