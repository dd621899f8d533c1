"""Fee invoices: from page text to the input-tax ledger.

Extraction works inside the row: the text is split into an array, every line
gets a mark, and each field is taken from the last line with its mark. No line
table is built and nothing is shuffled, however long one document is.

A document has taxpayer_id, store, platform, year and month (the return it was
handed in for), doc_id, file_name, upload_ord, page_no, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxweave.functions import calendar, money, text
from taxweave.operators.lines import SOURCE
from taxweave.rules import INVOICE_MARKS, LAZADA_CREDIT_WORDS, LAZADA_INVOICE_WORD, LAZADA_SKIP_WORDS
from taxweave.session import settle

PERIOD = ["year", "month"]
FIELDS = ["doc_date", "company_name", "tax_id", "issuer", "doc_num", "before_vat_c", "vat_c"]


def classify_invoice_docs(docs: DataFrame) -> DataFrame:
    """Add `layout`: shopee, tiktok, lazada_invoice, lazada_credit, skip or unsupported."""
    page = F.col("text")
    lazada = (
        F.when(text.holds_any(page, LAZADA_SKIP_WORDS), "skip")
        .when(page.contains(LAZADA_INVOICE_WORD), "lazada_invoice")
        .when(text.holds_all(page, LAZADA_CREDIT_WORDS), "lazada_credit")
        .otherwise("unsupported")
    )
    layout = (
        F.when(F.col("platform") == "Shopee", "shopee")
        .when(F.col("platform") == "TikTok", "tiktok")
        .when(F.col("platform") == "Lazada", lazada)
        .otherwise("unsupported")
    )
    return docs.withColumn("layout", layout)


def split_lines(docs: DataFrame) -> DataFrame:
    return docs.withColumn("lines", F.split("text", "\n", -1))


def line_lookahead(docs: DataFrame, steps=(1, 2, 7)) -> DataFrame:
    """Every line with its position and the lines some steps further down.

    The shifted arrays are zipped before they are exploded, so the work grows
    with the number of lines and no window over the document is needed.
    """
    shifted = [
        F.slice("lines", F.lit(1 + k), F.size("lines")).alias(f"next_{k}")
        for k in steps
    ]
    zipped = split_lines(docs).select("doc_id", "lines", *shifted)
    rows = zipped.select("doc_id", F.posexplode(F.arrays_zip("lines", *[f"next_{k}" for k in steps])))
    return rows.select("doc_id", "pos", F.col("col.lines").alias("line"), *[F.col(f"col.next_{k}") for k in steps])


def _mark_of(line: Column, marks) -> Column:
    chain = None
    for mark in marks:
        hit = text.holds_all(line, mark.has) & ~text.holds_any(line, mark.lacks)
        chain = F.when(hit, mark.tag) if chain is None else chain.when(hit, mark.tag)
    return chain.otherwise("")


def _tag_lines(marks) -> Column:
    return F.transform("lines", lambda line: _mark_of(line, marks))


def _marks() -> Column:
    """The mark of every line; the layout is looked at once per document."""
    chain = None
    for layout, marks in INVOICE_MARKS.items():
        hit = F.col("layout") == layout
        tags = _tag_lines(marks)
        chain = F.when(hit, tags) if chain is None else chain.when(hit, tags)
    return chain.otherwise(F.array().cast("array<string>"))


def _last(tag: str) -> Column:
    """Position (from 1) of the last line with a mark; NULL without one."""
    from_end = F.array_position("marks_reversed", F.lit(tag))
    return F.when(from_end > 0, (F.size("lines") + 1 - from_end).cast("int"))


def _line(position: Column, ahead: int = 0) -> Column:
    return F.try_element_at(F.col("lines"), position + ahead)


def extract_invoice_fields(docs: DataFrame) -> DataFrame:
    """The seven fields of each classified document; NULL where not found."""
    marked = split_lines(docs).withColumn("marks_reversed", F.reverse(_marks()))
    placed = marked.withColumns(
        {
            "number_at": F.greatest(_last("number"), _last("number_and_tax_id")),
            "tax_at": F.greatest(_last("tax_id"), _last("number_and_tax_id")),
            "heading_at": _last("heading"),
            **{f"{tag}_line": _line(_last(tag)) for tag in ("date", "net", "vat", "company", "issuer")},
        }
    ).withColumns({"number_line": _line(F.col("number_at")), "tax_line": _line(F.col("tax_at"))})

    shopee = F.col("layout") == "shopee"
    invoice = F.col("layout") == "lazada_invoice"
    credit = F.col("layout") == "lazada_credit"
    lazada = invoice | credit
    tiktok = F.col("layout") == "tiktok"

    day, number, tax = F.col("date_line"), F.col("number_line"), F.col("tax_line")
    net, vat, company = F.col("net_line"), F.col("vat_line"), F.col("company_line")
    shopee_tax = F.when(tax.contains("Tax ID "), text.before_first(F.split_part(tax, F.lit("Tax ID "), F.lit(2)), "เลขที่/"))
    headed_company = _line(F.col("heading_at"), 2)
    headed_tax = text.after_last(_line(F.col("heading_at"), 7), "Tax ID: ")
    sign = F.when(credit, -1).otherwise(1)

    fields = {
        "doc_date": F.when(shopee, calendar.parse_day(text.after_last(day, " "), "d/M/yyyy"))
        .when(lazada, calendar.parse_day(text.after_last(day, ": "), "yyyy-M-d"))
        .when(tiktok, calendar.parse_day(text.after_last(day, " : "), "MMM d, yyyy")),
        "company_name": F.when(shopee, text.after_last(company, "Customer name "))
        .when(invoice, headed_company)
        .when(credit, F.replace(headed_company, F.lit("  "), F.lit(" ")))
        .when(tiktok, text.after_last(company, "Client Name: ")),
        "tax_id": F.when(shopee, shopee_tax)
        .when(invoice, text.before_first(headed_tax, "Invoice"))
        .when(credit, text.before_first(headed_tax, "Credit Note"))
        .when(tiktok, text.after_last(tax, ": ")),
        "issuer": F.col("issuer_line"),
        "doc_num": F.when(shopee, F.concat(text.after_last(number, "No. "), F.lit(" "), _line(F.col("number_at"), 1)))
        .when(invoice, text.after_last(number, " "))
        .when(credit, text.after_last(number, "Credit Note: "))
        .when(tiktok, text.after_last(number, "Invoice number : ")),
        "before_vat_c": money.parse_money(text.after_last(net, " ")) * sign,
        "vat_c": money.parse_money(F.when(lazada, text.after_last(vat, ") ")).otherwise(text.after_last(vat, " "))) * sign,
    }
    carried = [c for c in docs.columns if c not in ("text", "page_no")]
    # inline() keeps later filters on the fields from being pushed below this
    # point, where the whole extraction would be repeated for each condition.
    record = F.struct(*[value.alias(name) for name, value in fields.items()])
    return placed.select(*carried, F.inline(F.array(record)))


def is_unsupported() -> Column:
    missing = F.lit(False)
    for field in FIELDS:
        missing = missing | F.col(field).isNull()
    return missing


def unsupported_invoices(extracted: DataFrame) -> DataFrame:
    """Documents with a missing field, and which fields those are."""
    absent = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in FIELDS]))
    return (
        extracted.filter((F.col("layout") != "skip") & is_unsupported())
        .select(*SOURCE, *PERIOD, "doc_id", "file_name", F.array_join(absent, ", ").alias("missing"))
    )


def supported_invoices(extracted: DataFrame, strict: bool = False) -> DataFrame:
    """Documents with all fields. `strict` drops every document of a source and
    period in which one is unsupported; settle `extracted` before, as both
    sides of that join read it."""
    whole = extracted.filter((F.col("layout") != "skip") & ~is_unsupported())
    if not strict:
        return whole
    rejected = unsupported_invoices(extracted).select(*SOURCE, *PERIOD).distinct()
    return whole.join(rejected, [*SOURCE, *PERIOD], "left_anti")


def _foreign() -> Column:
    return (F.year("doc_date") != F.col("year")) | (F.month("doc_date") != F.col("month"))


def filter_invoice_period(invoices: DataFrame) -> DataFrame:
    """Keep invoices dated in the month they were handed in for."""
    return invoices.filter(~_foreign())


def out_of_period_invoices(invoices: DataFrame) -> DataFrame:
    """Per source and period: how many invoices are dated in another month."""
    return (
        invoices.filter(_foreign())
        .groupBy(*SOURCE, *PERIOD)
        .agg(F.count(F.lit(1)).alias("out_of_period"))
    )


def dedup_invoices(invoices: DataFrame, platforms=("Lazada",)) -> DataFrame:
    """Of in-period documents of a source with the same number keep the first
    upload. Other platforms keep all documents.

    The first upload is picked by an aggregate that combines before the
    shuffle, so many copies of one document are no hot task.
    """
    numbered = F.coalesce(F.col("platform").isin(*platforms), F.lit(False))
    rest = [c for c in invoices.columns if c not in SOURCE + PERIOD + ["doc_num"]]
    first = (
        invoices.filter(numbered)
        .groupBy(*SOURCE, *PERIOD, "doc_num")
        .agg(F.min_by(F.struct(*rest), F.struct("upload_ord", "doc_id")).alias("kept"))
        .select(*SOURCE, *PERIOD, "doc_num", *[F.col(f"kept.{c}").alias(c) for c in rest])
    )
    return first.unionByName(invoices.filter(~numbered)).select(*invoices.columns)


def distinct_taxpayers(invoices: DataFrame) -> DataFrame:
    """Per taxpayer and period: distinct tax ids; more than one needs a choice."""
    return (
        invoices.groupBy("taxpayer_id", *PERIOD)
        .agg(F.countDistinct(text.plain_tax_id(F.col("tax_id"))).alias("tax_ids"))
        .withColumn("needs_choice", F.col("tax_ids") > 1)
    )


def company_per_tax_id(invoices: DataFrame) -> DataFrame:
    """The tax ids to choose from: first company name, number and sum of invoices."""
    return invoices.groupBy("taxpayer_id", *PERIOD, text.plain_tax_id(F.col("tax_id")).alias("tax_key")).agg(
        F.min_by("company_name", F.struct("doc_date", "doc_num", "doc_id")).alias("company_name"),
        F.count(F.lit(1)).alias("invoices"),
        F.sum("vat_c").alias("vat_c"),
    )


def select_tax_ids(invoices: DataFrame, chosen: DataFrame) -> DataFrame:
    """Keep invoices whose tax id is among a taxpayer's chosen ones
    (taxpayer_id, tax_id). Case and spaces do not matter."""
    picked = chosen.select("taxpayer_id", text.plain_tax_id(F.col("tax_id")).alias("tax_key")).distinct()
    return (
        invoices.withColumn("tax_key", text.plain_tax_id(F.col("tax_id")))
        .join(picked, ["taxpayer_id", "tax_key"], "left_semi")
        .select(*invoices.columns)
    )


def sort_purchase_ledger(invoices: DataFrame) -> DataFrame:
    return invoices.orderBy("taxpayer_id", "store", "platform", "doc_date", "doc_num")


PURCHASES = [*SOURCE, *PERIOD, "doc_date", "company_name", "tax_id", "issuer", "doc_num", "before_vat_c", "vat_c"]


def purchase_ledger(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Input-tax ledger from first-page texts: classify, extract, set the
    unsupported aside, keep the period, drop repeated uploads."""
    extracted = extract_invoice_fields(classify_invoice_docs(docs))
    return ledger_of_extracted(settle(extracted, "extracted") if strict else extracted, strict)


def ledger_of_extracted(extracted: DataFrame, strict: bool = False) -> DataFrame:
    """The same from extracted fields."""
    return dedup_invoices(filter_invoice_period(supported_invoices(extracted, strict)))
