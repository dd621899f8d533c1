"""Queries of the monthly VAT return."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from taxweave import fixtures as fx
from taxweave.operators import inputs, invoices, ledger, lines
from taxweave.plans import documents, vat
from taxweave.queries.sql import SOURCE, sql
from taxweave.session import fresh_folder, settle
from taxweave.sinks import reports
from taxweave.sinks.versions import Versions
from taxweave.sources.documents import first_pages, scan_invoice_docs

LEDGER = f"{SOURCE}, year, month, type, order_date, status, order_no, customer_name, before_vat_c, vat_c, include_vat_c"
PURCHASE = f"{SOURCE}, year, month, doc_date, company_name, tax_id, issuer, doc_num, before_vat_c, vat_c"


def _orders(spark, sf_dir):
    kept = lines.drop_cancelled(fx.canonical_lines(spark, sf_dir))
    return ledger.order_totals(lines.dedup_lines(kept))


def _docs(spark, sf_dir):
    return first_pages(fx.invoice_pages(spark, sf_dir))


def _extracted(spark, sf_dir):
    return invoices.extract_invoice_fields(invoices.classify_invoice_docs(_docs(spark, sf_dir)))


def _in_period(spark, sf_dir):
    return invoices.filter_invoice_period(invoices.supported_invoices(_extracted(spark, sf_dir)))


def _purchases(spark, sf_dir):
    return invoices.purchase_ledger(_docs(spark, sf_dir))


def _own_tax_ids(spark, sf_dir):
    """The choice: every taxpayer's own id, typed with other case and spaces."""
    number = F.lpad(F.col("taxpayer_id").cast("string"), 12, "0")
    return fx.entered_stores(spark, sf_dir).select(
        "taxpayer_id", F.concat(F.lit("Th "), F.lit("0 "), number).alias("tax_id")
    )


def order_sales_ledger(spark, sf_dir):
    return ledger.order_sales_ledger(_orders(spark, sf_dir))


def shipping_sales_ledger(spark, sf_dir):
    return ledger.shipping_sales_ledger(_orders(spark, sf_dir))


def sales_ledger(spark, sf_dir):
    return vat.sales_from_lines(fx.canonical_lines(spark, sf_dir))


def union_ledgers(spark, sf_dir):
    sales = vat.sales_from_lines(fx.canonical_lines(spark, sf_dir)).withColumn("side", F.lit("sale"))
    fees = _purchases(spark, sf_dir).select(*invoices.PURCHASES).withColumn("side", F.lit("fee"))
    both = ledger.union_ledgers([sales, fees])
    return both.select(*SOURCE.split(", "), "year", "month", "side", "order_no", "doc_num", "before_vat_c", "vat_c")


def filter_selected_platforms(spark, sf_dir):
    selection = fx.store_selection(spark, sf_dir)
    return inputs.filter_selected_platforms(vat.sales_from_lines(fx.canonical_lines(spark, sf_dir)), selection)


def _filed(spark, sf_dir):
    path = fresh_folder(spark, "ledgers")
    months = vat.vat_months(fx.canonical_lines(spark, sf_dir), _docs(spark, sf_dir))
    return path, vat.file_returns(months, path)


def _live(spark, path):
    table = Versions(spark, path)
    return table.read(table.state(), None).drop("range")


def write_sales_ledger(spark, sf_dir):
    path, _ = _filed(spark, sf_dir)
    return _live(spark, f"{path}/sales")


def write_purchase_ledger(spark, sf_dir):
    path, _ = _filed(spark, sf_dir)
    return _live(spark, f"{path}/purchases")


def write_receipts(spark, sf_dir):
    path, _ = _filed(spark, sf_dir)
    return _live(spark, f"{path}/receipts")


def refile_some_taxpayers(spark, sf_dir):
    """All returns filed, then those of every seventh taxpayer once more, now without
    sales after June: the others' ledgers stay and the refiled months are empty."""
    path = fresh_folder(spark, "ledgers")
    rows = fx.canonical_lines(spark, sf_dir)
    vat.file_returns(vat.vat_months(rows, _docs(spark, sf_dir)), path)
    mine = rows.filter(F.col("taxpayer_id") % 7 == 0)
    no_fees = _docs(spark, sf_dir).filter("false")
    months = vat.vat_months(mine.filter("month <= 6"), no_fees)
    vat.file_returns(months, path, mine.select("taxpayer_id", "year", "month").distinct())
    return _live(spark, f"{path}/sales")


def filed_returns(spark, sf_dir):
    """The returns computed from the written ledgers."""
    return _filed(spark, sf_dir)[1]


def filed_returns_of_one_tax_id(spark, sf_dir):
    """Filed are the periods whose invoices name one tax id at most."""
    months = vat.vat_months(fx.canonical_lines(spark, sf_dir), _docs(spark, sf_dir))
    return vat.file_returns(months, fresh_folder(spark, "ledgers"), choose=True)


def vat_return(spark, sf_dir):
    return vat.vat_months(fx.canonical_lines(spark, sf_dir), _docs(spark, sf_dir)).summary


def purchases_of_landed_documents(spark, sf_dir):
    """The input-tax ledger of documents landed in three uploads that share most of them."""
    docs, path = _docs(spark, sf_dir), fresh_folder(spark, "documents")
    for part in (docs.filter("year <= 1997"), docs, docs.filter("month <= 6")):
        documents.land_documents(part, path)
    return documents.purchases(spark, path).select(*invoices.PURCHASES)


def vat_return_gated(spark, sf_dir):
    """Returns of the periods whose invoices name one tax id at most."""
    return vat.gated(vat.vat_months(fx.canonical_lines(spark, sf_dir), _docs(spark, sf_dir))).summary


def _complete(spark, sf_dir):
    months = vat.vat_months(fx.canonical_lines(spark, sf_dir), _docs(spark, sf_dir))
    # The manifest is asked for what is there and for what is missing; it is computed once.
    return vat.complete_months(months, fx.store_selection(spark, sf_dir), settle(fx.monthly_manifest(spark, sf_dir), "manifest"))


def vat_return_complete(spark, sf_dir):
    """Returns of the months with exports and fee documents of every selected store and platform."""
    return _complete(spark, sf_dir)[0].summary


def vat_left_out(spark, sf_dir):
    """The uploads that the other months lack."""
    return _complete(spark, sf_dir)[1]


def vat_return_selected(spark, sf_dir):
    """One month, selected platforms and the taxpayer's own tax id only."""
    return vat.vat_months(
        fx.canonical_lines(spark, sf_dir),
        _docs(spark, sf_dir),
        selection=fx.store_selection(spark, sf_dir),
        chosen_tax_ids=_own_tax_ids(spark, sf_dir),
        year=1998,
        month=3,
    ).summary


def scan_documents(spark, sf_dir):
    path = fresh_folder(spark, "pages")
    fx.invoice_pages(spark, sf_dir).write.parquet(path)
    docs = scan_invoice_docs(spark, path)
    return docs.select(*SOURCE.split(", "), "doc_id", "file_name", "upload_ord", "sort_num")


def line_lookahead(spark, sf_dir):
    return invoices.line_lookahead(fx.table(spark, sf_dir, "documents"))


def classify_invoice_docs(spark, sf_dir):
    return invoices.classify_invoice_docs(_docs(spark, sf_dir)).select("doc_id", "layout")


def extract_invoice_fields(spark, sf_dir):
    return _extracted(spark, sf_dir).select("doc_id", "layout", *invoices.FIELDS)


def unsupported_invoices(spark, sf_dir):
    return invoices.unsupported_invoices(_extracted(spark, sf_dir))


def supported_invoices_strict(spark, sf_dir):
    extracted = settle(_extracted(spark, sf_dir), "extracted")
    return invoices.supported_invoices(extracted, strict=True).select("doc_id", *invoices.FIELDS)


def out_of_period_invoices(spark, sf_dir):
    return invoices.out_of_period_invoices(invoices.supported_invoices(_extracted(spark, sf_dir)))


def dedup_invoices(spark, sf_dir):
    return invoices.dedup_invoices(_in_period(spark, sf_dir)).select("doc_id", *invoices.FIELDS)


def sort_purchase_ledger(spark, sf_dir):
    # A sort over all partitions reads its rows twice, first for their ranges: the texts are extracted before.
    return invoices.sort_purchase_ledger(settle(_purchases(spark, sf_dir).select(*invoices.PURCHASES), "purchases"))


def distinct_taxpayers(spark, sf_dir):
    return invoices.distinct_taxpayers(_purchases(spark, sf_dir))


def company_per_tax_id(spark, sf_dir):
    return invoices.company_per_tax_id(_purchases(spark, sf_dir))


def select_tax_ids(spark, sf_dir):
    chosen = _own_tax_ids(spark, sf_dir)
    return invoices.select_tax_ids(_purchases(spark, sf_dir), chosen).select(*invoices.PURCHASES)


def receipt_manifest(spark, sf_dir):
    return reports.receipt_manifest(_purchases(spark, sf_dir))


def receipt_bundles(spark, sf_dir):
    return reports.receipt_bundles(_purchases(spark, sf_dir))


def run_audit_vat(spark, sf_dir):
    sales = vat.sales_from_lines(fx.canonical_lines(spark, sf_dir), 1998, 3)
    amounts = sales.select("taxpayer_id", "store", F.col("vat_c").alias("amount_c"))
    path = fresh_folder(spark, "audit")
    audit = reports.run_audit(amounts, "vat", "1998-03", dt.datetime(1998, 4, 10, 8, 0), "company")
    for _ in range(2):  # a retried run is one run
        reports.append_run_audit(audit, path, "vat-1998-03")
    return reports.read_written(spark, path, audit.schema)


_RETURN = """SELECT *, output_vat_c - input_vat_c AS payable_c,
  CASE WHEN output_vat_c < input_vat_c THEN '-' ELSE '' END || format('{{:,}}', abs(output_vat_c - input_vat_c) // 100) || '.'
    || lpad(CAST(abs(output_vat_c - input_vat_c) % 100 AS VARCHAR), 2, '0') AS payable_label
FROM (SELECT taxpayer_id, year, month, coalesce(sales_before_vat_c, 0) AS sales_before_vat_c, coalesce(output_vat_c, 0) AS output_vat_c,
             coalesce(expense_before_vat_c, 0) AS expense_before_vat_c, coalesce(input_vat_c, 0) AS input_vat_c
  FROM (SELECT taxpayer_id, year, month, CAST(sum(before_vat_c) AS BIGINT) AS sales_before_vat_c, CAST(sum(vat_c) AS BIGINT) AS output_vat_c
        FROM sales {sales} GROUP BY taxpayer_id, year, month)
  FULL JOIN (SELECT taxpayer_id, year, month, CAST(sum(before_vat_c) AS BIGINT) AS expense_before_vat_c, CAST(sum(vat_c) AS BIGINT) AS input_vat_c
        FROM purchases {fees} GROUP BY taxpayer_id, year, month) USING (taxpayer_id, year, month))"""
_SELECTED = "WHERE year = 1998 AND month = 3 AND (platform <> 'TikTok' OR taxpayer_id % 10 <> 0)"

_ONE_ID = """WHERE NOT EXISTS (SELECT 1 FROM (SELECT taxpayer_id, year, month FROM purchases GROUP BY taxpayer_id, year, month
  HAVING count(DISTINCT lower(replace(tax_id, ' ', ''))) > 1) c
  WHERE c.taxpayer_id = {side}.taxpayer_id AND c.year = {side}.year AND c.month = {side}.month)"""

_LACKING = f"""SELECT s.taxpayer_id, s.store, s.platform, y.year, y.month, kind
FROM selection s JOIN (SELECT taxpayer_id, year, month FROM sales UNION SELECT taxpayer_id, year, month FROM purchases) y USING (taxpayer_id),
  (VALUES ('sale'), ('commission')) AS k(kind)
WHERE NOT EXISTS (SELECT 1 FROM monthly m WHERE m.taxpayer_id = s.taxpayer_id AND m.store = s.store AND m.platform = s.platform
  AND m.year = y.year AND m.month = y.month AND m.kind = k.kind)"""
_WHOLE = f"WHERE (taxpayer_id, year, month) NOT IN (SELECT (taxpayer_id, year, month) FROM ({_LACKING}))"

_RECEIPTS = sql(
    """SELECT taxpayer_id, year, month, store || '_' || platform || '_commission_receipt' AS bundle, doc_date, doc_num, file_name
FROM purchases ORDER BY 1, 2, 3, 4, 5, 6, 7""",
    "purchases",
)

QUERIES = {
    "order_sales_ledger": (order_sales_ledger, sql(f"SELECT {LEDGER} FROM sales WHERE type = 'สินค้า'", "sales")),
    "shipping_sales_ledger": (shipping_sales_ledger, sql(f"SELECT {LEDGER} FROM sales WHERE type = 'บริการ'", "sales")),
    "sales_ledger": (sales_ledger, sql(f"SELECT {LEDGER} FROM sales", "sales")),
    "union_ledgers": (
        union_ledgers,
        sql(
            f"""SELECT {SOURCE}, year, month, 'sale' AS side, order_no, NULL AS doc_num, before_vat_c, vat_c FROM sales
UNION ALL SELECT {SOURCE}, year, month, 'fee' AS side, NULL AS order_no, doc_num, before_vat_c, vat_c FROM purchases""",
            "sales", "purchases",
        ),
    ),
    "filter_selected_platforms": (
        filter_selected_platforms,
        sql(f"SELECT {LEDGER} FROM sales WHERE ({SOURCE}) IN (SELECT ({SOURCE}) FROM selection)", "sales", "selection"),
    ),
    "write_sales_ledger": (write_sales_ledger, sql(f"SELECT {LEDGER} FROM sales", "sales")),
    "write_purchase_ledger": (write_purchase_ledger, sql(f"SELECT {PURCHASE} FROM purchases", "purchases")),
    "vat_return": (vat_return, sql(_RETURN.format(sales="", fees=""), "sales", "purchases")),
    "vat_return_gated": (
        vat_return_gated,
        sql(_RETURN.format(sales=_ONE_ID.format(side="sales"), fees=_ONE_ID.format(side="purchases")), "sales", "purchases"),
    ),
    "purchases_of_landed_documents": (purchases_of_landed_documents, sql(f"SELECT {PURCHASE} FROM purchases", "purchases")),
    "filed_returns_of_one_tax_id": (
        filed_returns_of_one_tax_id,
        sql(_RETURN.format(sales=_ONE_ID.format(side="sales"), fees=_ONE_ID.format(side="purchases")), "sales", "purchases"),
    ),
    "vat_return_complete": (
        vat_return_complete,
        sql(_RETURN.format(sales=_WHOLE, fees=_WHOLE), "sales", "purchases", "selection", "monthly"),
    ),
    "vat_left_out": (vat_left_out, sql(_LACKING, "sales", "purchases", "selection", "monthly")),
    "vat_return_selected": (
        vat_return_selected,
        sql(_RETURN.format(sales=_SELECTED, fees=_SELECTED + " AND company_name LIKE 'Company %'"), "sales", "purchases"),
    ),
    "scan_invoice_docs": (
        scan_documents,
        sql(
            f"""SELECT {SOURCE}, doc_id, file_name, upload_ord, CASE WHEN platform = 'Shopee' THEN upload_ord + 1 END AS sort_num
FROM page""",
            "page",
        ),
    ),
    "line_lookahead": (
        line_lookahead,
        """SELECT doc_id, CAST(pos AS INTEGER) AS pos, line, lead(line, 1) OVER w AS next_1, lead(line, 2) OVER w AS next_2, lead(line, 7) OVER w AS next_7
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
      FROM documents)
WINDOW w AS (PARTITION BY doc_id ORDER BY pos)""",
    ),
    "classify_invoice_docs": (classify_invoice_docs, sql("SELECT doc_id, layout FROM page", "page")),
    "extract_invoice_fields": (
        extract_invoice_fields,
        sql(
            """SELECT doc_id, layout, CASE WHEN found THEN doc_date END AS doc_date, CASE WHEN found THEN company_name END AS company_name,
  CASE WHEN found THEN tax_id END AS tax_id, CASE WHEN found THEN issuer END AS issuer, CASE WHEN found THEN doc_num END AS doc_num,
  CASE WHEN found AND kind <> 'broken' THEN before_vat_c END AS before_vat_c, CASE WHEN found THEN vat_c END AS vat_c
FROM (SELECT *, layout <> 'skip' AS found FROM page)""",
            "page",
        ),
    ),
    "unsupported_invoices": (
        unsupported_invoices,
        sql(f"SELECT {SOURCE}, year, month, doc_id, file_name, 'before_vat_c' AS missing FROM page WHERE kind = 'broken'", "page"),
    ),
    "supported_invoices_strict": (
        supported_invoices_strict,
        sql(
            f"""SELECT doc_id, doc_date, company_name, tax_id, issuer, doc_num, before_vat_c, vat_c
FROM (SELECT *, sum(CASE WHEN kind = 'broken' THEN 1 ELSE 0 END) OVER (PARTITION BY {SOURCE}, year, month) AS broken FROM page)
WHERE broken = 0 AND layout <> 'skip'""",
            "page",
        ),
    ),
    "out_of_period_invoices": (
        out_of_period_invoices,
        sql(
            f"""SELECT {SOURCE}, year, month, count(*) AS out_of_period FROM supported
WHERE year(doc_date) <> year OR month(doc_date) <> month GROUP BY {SOURCE}, year, month""",
            "supported",
        ),
    ),
    "dedup_invoices": (
        dedup_invoices,
        sql("SELECT doc_id, doc_date, company_name, tax_id, issuer, doc_num, before_vat_c, vat_c FROM purchases", "purchases"),
    ),
    "sort_purchase_ledger": (
        sort_purchase_ledger,
        sql(f"SELECT {PURCHASE} FROM purchases ORDER BY taxpayer_id, store, platform, doc_date, doc_num", "purchases"),
    ),
    "distinct_taxpayers": (
        distinct_taxpayers,
        sql(
            """SELECT *, tax_ids > 1 AS needs_choice FROM (
  SELECT taxpayer_id, year, month, count(DISTINCT lower(replace(tax_id, ' ', ''))) AS tax_ids FROM purchases GROUP BY taxpayer_id, year, month)""",
            "purchases",
        ),
    ),
    "company_per_tax_id": (
        company_per_tax_id,
        sql(
            """SELECT taxpayer_id, year, month, tax_key, min(CASE WHEN place = 1 THEN company_name END) AS company_name,
  count(*) AS invoices, CAST(sum(vat_c) AS BIGINT) AS vat_c
FROM (SELECT *, row_number() OVER (PARTITION BY taxpayer_id, year, month, tax_key ORDER BY doc_date, doc_num, doc_id) AS place
      FROM (SELECT *, lower(replace(tax_id, ' ', '')) AS tax_key FROM purchases))
GROUP BY taxpayer_id, year, month, tax_key""",
            "purchases",
        ),
    ),
    "select_tax_ids": (
        select_tax_ids,
        sql(
            f"""SELECT {PURCHASE} FROM purchases WHERE (taxpayer_id, lower(replace(tax_id, ' ', ''))) IN
  (SELECT (c_custkey // 15, 'th0' || lpad(CAST(c_custkey // 15 AS VARCHAR), 12, '0')) FROM customer)""",
            "purchases",
        ),
    ),
    "receipt_manifest": (receipt_manifest, _RECEIPTS),
    "write_receipts": (write_receipts, _RECEIPTS),
    "refile_some_taxpayers": (refile_some_taxpayers, sql(f"SELECT {LEDGER} FROM sales WHERE taxpayer_id % 7 <> 0 OR month <= 6", "sales")),
    "filed_returns": (filed_returns, sql(_RETURN.format(sales="", fees=""), "sales", "purchases")),
    "receipt_bundles": (
        receipt_bundles,
        sql(
            """SELECT taxpayer_id, year, month, store || '_' || platform || '_commission_receipt' AS bundle, count(*) AS receipts,
  min(doc_date) AS first_date, max(doc_date) AS last_date FROM purchases GROUP BY 1, 2, 3, 4""",
            "purchases",
        ),
    ),
    "run_audit_vat": (
        run_audit_vat,
        sql(
            """SELECT taxpayer_id, 'vat' AS job, '1998-03' AS period, '1998-04-10 08:00:00' AS run_at, 'company' AS user_type,
  string_agg(DISTINCT store, ', ' ORDER BY store) AS stores, CAST(sum(vat_c) AS BIGINT) AS total_c
FROM sales WHERE year = 1998 AND month = 3 GROUP BY taxpayer_id""",
            "sales",
        ),
    ),
}
