import datetime as dt

import pytest

from taxweave.operators import invoices as inv
from taxweave.sources.documents import first_pages

DOC = (
    "taxpayer_id long, store string, platform string, year int, month int, doc_id string, file_name string, "
    "upload_ord int, page_no int, text string"
)

SHOPEE = """Shopee (Thailand) Co., Ltd.
เลขประจำตัวผู้เสียภาษี/Tax ID 0105เลขที่/No. TRS-1
-A
วันที่/Date 5/03/2024
กรุณาชำระภายในวันที่ 09/09/2024
Customer name Mr. A
Total after discount 1,234.50
VAT 7% 86.42"""
INVOICE = """TAX INVOICE / RECEIPT
x
Company B
x
x
x
x
Tax ID: 77 8Invoice Date: 2024-03-31
Invoice No.: TH1
Lazada Limited
Total 100.00
7% (VAT) 7.00
Total (Including Tax) 107.00"""
CREDIT = """CREDIT NOTE
x
Company  B
x
x
x
x
Tax ID: 778Credit Note: CN9
Date: 2024-03-30
Lazada Limited
Reversal Commission
Total 10.00
7% (VAT) 0.70"""
TIKTOK = """Invoice number : T1
Invoice date : Mar 5, 2024
TikTok Shop Ltd.
prepared by TikTok Pte. Ltd.
Client Name: C
Tax ID: 55
Subtotal (excluding VAT) ฿1,000.00
Total VAT 7% ฿70.00"""


def docs(spark, *rows):
    """Rows of (platform, doc_id, text, upload_ord)."""
    return spark.createDataFrame([(1, "a", p, 2024, 3, d, f"{d}.pdf", o, 0, t) for p, d, t, o in rows], DOC)


def extract(spark, *rows):
    found = inv.extract_invoice_fields(inv.classify_invoice_docs(docs(spark, *rows)))
    return {r.doc_id: r for r in found.collect()}


def fields(row):
    return tuple(row[f] for f in inv.FIELDS)


def test_layouts(spark):
    got = extract(spark, ("Shopee", "s", SHOPEE, 1), ("Lazada", "i", INVOICE, 1), ("Lazada", "c", CREDIT, 2), ("TikTok", "t", TIKTOK, 1))
    day = dt.date(2024, 3, 5)
    assert fields(got["s"]) == (day, "Mr. A", "0105", "Shopee (Thailand) Co., Ltd.", "TRS-1 -A", 123450, 8642)
    assert fields(got["i"]) == (dt.date(2024, 3, 31), "Company B", "77 8", "Lazada Limited", "TH1", 10000, 700)
    assert fields(got["c"]) == (dt.date(2024, 3, 30), "Company B", "778", "Lazada Limited", "CN9", -1000, -70)
    assert fields(got["t"]) == (day, "C", "55", "TikTok Shop Ltd.", "T1", 100000, 7000)


def test_last_match_wins(spark):
    later = SHOPEE + "\nVAT 7% 1.00\nเลขที่ใหม่\nend"
    row = extract(spark, ("Shopee", "s", later, 1))["s"]
    assert row.vat_c == 100 and row.doc_num == "เลขที่ใหม่ end" and row.tax_id == "0105"


@pytest.mark.parametrize("text", [SHOPEE.replace("\n-A", "").rsplit("\n", 7)[0], "เลขที่/No. X", ""])
def test_mark_on_the_last_line_gives_no_number(spark, text):
    assert extract(spark, ("Shopee", "s", text, 1))["s"].doc_num is None


def test_unsupported_and_strict(spark):
    rows = [("TikTok", "ok", TIKTOK, 1), ("TikTok", "bad", TIKTOK.replace("Client", "Cl."), 2), ("Shopee", "s", SHOPEE, 1)]
    found = inv.extract_invoice_fields(inv.classify_invoice_docs(docs(spark, *rows)))
    assert [(r.doc_id, r.missing) for r in inv.unsupported_invoices(found).collect()] == [("bad", "company_name")]
    assert sorted(r.doc_id for r in inv.supported_invoices(found).collect()) == ["ok", "s"]
    assert [r.doc_id for r in inv.supported_invoices(found, strict=True).collect()] == ["s"]
    assert sorted(r.doc_id for r in inv.purchase_ledger(docs(spark, *rows), strict=True).collect()) == ["s"]


def test_unreadable_values_make_a_document_unsupported(spark):
    rows = [("TikTok", "d", TIKTOK.replace("Mar 5, 2024", "someday"), 1), ("TikTok", "m", TIKTOK.replace("฿70.00", "n/a"), 2)]
    found = inv.extract_invoice_fields(inv.classify_invoice_docs(docs(spark, *rows)))
    assert {(r.doc_id, r.missing) for r in inv.unsupported_invoices(found).collect()} == {("d", "doc_date"), ("m", "vat_c")}


def test_classes(spark):
    rows = [
        ("Lazada", "express", INVOICE + "\nLazada Express Limited", 1),
        ("Lazada", "shipping", INVOICE + "\nShipping Fee 1", 1),
        ("Lazada", "plain note", CREDIT.replace("Reversal Commission", ""), 1),
        ("Lazada", "both", INVOICE + "\n" + CREDIT, 1),
    ]
    got = {r.doc_id: r.layout for r in inv.classify_invoice_docs(docs(spark, *rows)).collect()}
    assert got == {"express": "skip", "shipping": "skip", "plain note": "unsupported", "both": "lazada_invoice"}


def test_repeated_uploads(spark):
    again = INVOICE.replace("Total 100.00", "Total 999.00")
    late = INVOICE.replace("2024-03-31", "2024-04-01").replace("TH1", "TH2")
    rows = [("Lazada", "b", again, 2), ("Lazada", "a", INVOICE, 1), ("Lazada", "l", late, 0), ("Lazada", "m", late.replace("04-01", "03-02"), 3)]
    rows += [("TikTok", "t1", TIKTOK, 1), ("TikTok", "t2", TIKTOK, 2)]
    kept = inv.purchase_ledger(docs(spark, *rows))
    assert sorted((r.doc_id, r.before_vat_c) for r in kept.collect()) == [("a", 10000), ("m", 10000), ("t1", 100000), ("t2", 100000)]


def test_tax_ids(spark):
    frame = inv.extract_invoice_fields(
        inv.classify_invoice_docs(docs(spark, ("TikTok", "1", TIKTOK.replace("55", "TH 5 5"), 1), ("TikTok", "2", TIKTOK.replace("55", "th55"), 2), ("TikTok", "3", TIKTOK, 3)))
    )
    row = inv.distinct_taxpayers(frame).first()
    assert (row.tax_ids, row.needs_choice) == (2, True)
    chosen = spark.createDataFrame([(1, "T H55"), (1, "th55")], "taxpayer_id long, tax_id string")
    assert sorted(r.doc_id for r in inv.select_tax_ids(frame, chosen).collect()) == ["1", "2"]
    assert {(r.tax_key, r.invoices, r.vat_c) for r in inv.company_per_tax_id(frame).collect()} == {("th55", 2, 14000), ("55", 1, 7000)}


def test_first_pages(spark):
    names = [("Shopee", "a-b-c-d-00012-x.pdf"), ("Shopee", "a-SPX-c-d-1-x.pdf"), ("Shopee", "odd.pdf"), ("TikTok", "THJV1.pdf"), ("TikTok", "TTSTHAC1.pdf"), ("Lazada", "THJV-SPX.pdf")]
    frame = spark.createDataFrame([(1, "a", p, 2024, 3, n, n, 1, k, "") for p, n in names for k in (0, 1)], DOC)
    assert {(r.file_name, r.sort_num) for r in first_pages(frame).collect()} == {(names[0][1], 12), ("odd.pdf", None), ("THJV-SPX.pdf", None)}
    assert first_pages(frame).count() == 3


def test_lookahead(spark):
    frame = docs(spark, ("TikTok", "x", "a\nb\nc", 1), ("TikTok", "y", "", 1))
    rows = {(r.doc_id, r.pos): (r.line, r.next_1, r.next_2, r.next_7) for r in inv.line_lookahead(frame).collect()}
    assert rows == {("x", 0): ("a", "b", "c", None), ("x", 1): ("b", "c", None, None), ("x", 2): ("c", None, None, None), ("y", 0): ("", None, None, None)}
