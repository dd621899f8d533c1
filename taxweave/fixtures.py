"""Order lines, exports and fee documents derived from the TPC-H-like tables.

Everything is computed by Spark from lineitem, orders and customer, so it grows
with them. The mapping is described in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxweave.functions.money import grouped_label, whole_div
from taxweave.operators.lines import per_platform
from taxweave.rules import RULES
from taxweave.session import fresh_folder, spread, tidy

STORES = ["store1", "store2", "store3"]
TAXPAYER_GROUPS = 8
OPEN_STATUS = {"Shopee": "ที่ต้องจัดส่ง", "Lazada": "shipped", "TikTok": "To ship"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def sealed(df: DataFrame, *passed: str) -> DataFrame:
    """The same rows, but filters on derived columns stay above this point
    instead of repeating the columns' expressions further down. Filters on the `passed` columns go through."""
    return df.select(*passed, F.inline(F.array(F.struct(*[c for c in df.columns if c not in passed])))).select(*df.columns)


def _platform(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in RULES]), (key % 3 + 1).cast("int"))


def sales_rows(spark: SparkSession, sf_dir: str, platform: str | None = None) -> DataFrame:
    """Line items with the order's taxpayer, store and platform; of one platform only its own are shuffled."""
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    if platform is not None:
        items, orders = (rows.filter(_platform(F.col(c)) == platform) for rows, c in ((items, "l_orderkey"), (orders, "o_orderkey")))
    items = spread(items, "l_orderkey")
    key = F.col("l_orderkey")
    quantity, item = F.col("l_quantity").cast("long"), cents("l_extendedprice")
    rate = cents("l_discount")
    # Lines of an order in a total order: by number, then by all other columns.
    mixed = F.col("l_partkey") * 1000003 + F.col("l_suppkey") * 10007 + item * 101 + quantity * 17 + rate
    return items.join(orders, key == F.col("o_orderkey")).select(
        key,
        whole_div(F.col("o_custkey"), 15).alias("taxpayer_id"),
        F.concat(F.lit("store"), (whole_div(key, 3) % 3 + 1).cast("string")).alias("store"),
        _platform(key).alias("platform"),
        key.cast("string").alias("order_no"),
        "o_orderstatus",
        F.col("o_orderdate").cast("date").alias("order_date"),
        F.concat(F.lit("Customer#"), F.col("o_custkey").cast("string")).alias("customer_name"),
        item.alias("item_c"),
        whole_div(item * rate + 50, 100).alias("disc_c"),
        F.when(F.col("l_linenumber") % 3 == 0, 0).otherwise(quantity * 100).alias("ship_c"),
        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("sku"),
        quantity.alias("quantity"),
        (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_linenumber") * F.lit(10**15) + mixed % F.lit(10**15)).alias("line_ord"),
    )


def _status_word() -> Column:
    """The platform's own word: one of three for cancelled, then done, then
    open. All words are one constant array, the row computes its place."""
    words = []
    for rule in RULES.values():
        words += [rule.cancelled[i % len(rule.cancelled)] for i in range(3)] + [rule.done, OPEN_STATUS[rule.name]]
    key = F.col("l_orderkey")
    slot = (
        F.when(F.col("o_orderstatus") == "P", whole_div(key, 9) % 3)
        .when(F.col("o_orderstatus") == "F", 3)
        .when(key % 29 != 0, 4)
    )
    # Not element_at: in ANSI mode it takes a NULL place for -1.
    return F.try_element_at(F.array(*[F.lit(w) for w in words]), (key % 3 * 5 + slot + 1).cast("int"))


def order_lines(spark: SparkSession, sf_dir: str, platform: str | None = None) -> DataFrame:
    """Order lines of all taxpayers, or of them one platform's. Every 50th order is there twice, some
    orders have no status and some Shopee orders no discount."""
    key = F.col("l_orderkey")
    rows = sales_rows(spark, sf_dir, platform).withColumns(
        {
            "status": _status_word(),
            "disc_c": F.when((F.col("platform") != "Shopee") | (key % 41 != 0), F.col("disc_c")),
            "year": F.year("order_date"),
            "month": F.month("order_date"),
        }
    ).drop("o_orderstatus")
    # inline() also seals the rows.
    row = F.struct(*rows.columns)
    return rows.select(F.inline(F.when(key % 50 == 0, F.array(row, row)).otherwise(F.array(row))))


def canonical_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).drop("l_orderkey", "returned")


def store_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected platforms per store: those with orders, without every tenth
    taxpayer's TikTok."""
    sources = sales_rows(spark, sf_dir).select("taxpayer_id", "store", "platform").distinct()
    return sources.filter((F.col("platform") != "TikTok") | (F.col("taxpayer_id") % 10 != 0))


def input_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded files: one sale file per source with orders and a commission
    file, but no TikTok commission for odd taxpayers."""
    sources = sales_rows(spark, sf_dir).select("taxpayer_id", "store", "platform").distinct()
    kinds = F.explode(F.array(F.lit("sale"), F.lit("commission")))
    rows = sources.withColumn("kind", kinds)
    name = F.concat_ws("_", "store", "platform", "kind")
    return rows.filter(
        (F.col("kind") == "sale") | (F.col("platform") != "TikTok") | (F.col("taxpayer_id") % 2 == 0)
    ).withColumn("file_name", name)


def monthly_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads of every source and month of its taxpayer: some Lazada exports were never handed in, some came
    late, and some months lack TikTok's commission file."""
    rows = sales_rows(spark, sf_dir).withColumns({"year": F.year("order_date"), "month": F.month("order_date")})
    sources, periods = rows.select("taxpayer_id", "store", "platform").distinct(), rows.select("taxpayer_id", "year", "month").distinct()
    kinds = F.explode(F.array(F.lit("sale"), F.lit("commission")))
    taxpayer, month = F.col("taxpayer_id"), F.col("month")
    never = (taxpayer % 4 == 1) & (F.col("store") == "store2")
    late = (taxpayer + F.col("year") + month) % 5 == 0
    no_sale = (F.col("kind") == "sale") & (F.col("platform") == "Lazada") & (never | late)
    no_fee = (F.col("kind") == "commission") & (F.col("platform") == "TikTok") & ((taxpayer + month) % 4 == 0)
    return sources.join(periods, "taxpayer_id").withColumn("kind", kinds).filter(~no_sale & ~no_fee)


def entered_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store names as typed, one row per customer."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.when(key % 7 == 0, F.concat(F.lit("shop_"), segment)).when(key % 11 == 0, " ").otherwise(segment)
    return table(spark, sf_dir, "customer").select(whole_div(key, 15).alias("taxpayer_id"), name.alias("store"))


# --- exports -----------------------------------------------------------------


def _thb(amount: Column) -> Column:
    return F.concat(F.lit("THB "), grouped_label(amount))


def _plain(amount: Column) -> Column:
    return (amount.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").cast("string")


def render_export(lines: DataFrame, platform: str) -> DataFrame:
    """One platform's export as the marketplace writes it, all strings."""
    rule = RULES[platform]
    minute = F.col("l_orderkey") % 1440
    at = F.timestamp_add("minute", minute.cast("int"), F.col("order_date").cast("timestamp"))
    money = _thb if platform == "TikTok" else _plain
    pattern = {"Shopee": "yyyy-MM-dd HH:mm", "Lazada": "dd MMM yyyy HH:mm", "TikTok": "dd/MM/yyyy HH:mm:ss"}[platform]
    tab = F.lit("\t" if platform == "TikTok" else "")
    values = {
        "order_no": F.concat("order_no", tab),
        "status": F.col("status"),
        "ordered_at": F.concat(F.date_format(at, pattern), tab),
        "item": money(F.col("item_c")),
        "discount": money(F.col("disc_c")),
        "shipping": money(F.col("ship_c")),
        "customer_name": F.col("customer_name"),
    }
    own = [values[name].alias(column) for name, column in rule.columns.items()]
    carried = [F.lit("0").alias(column) for column in rule.carried]
    return lines.filter(F.col("platform") == platform).select(
        "taxpayer_id", "store", "line_ord", "order_no", *[c.alias(f"x{i}") for i, c in enumerate(own + carried)], "sku", F.col("quantity").cast("string").alias("quantity"),
        (F.col("taxpayer_id") % TAXPAYER_GROUPS).alias("taxpayer_group"),
    ).withColumnsRenamed({f"x{i}": name for i, name in enumerate([*rule.columns.values(), *rule.carried])})


def _export_names(platform: str) -> list[str]:
    rule = RULES[platform]
    return [*rule.columns.values(), *rule.carried, "sku", "quantity"]


def _write_export(rows: DataFrame, names: list[str], path: str, fmt: str) -> None:
    """Land an export in folders per store and group of taxpayers. Rows come dealt out by order, so an order's
    lines are in one file, in their order, without another shuffle."""
    order = ["store", "taxpayer_group", "taxpayer_id", "order_no", "line_ord"]
    ordered = rows.sortWithinPartitions(*order)
    columns = [F.col(f"`{n}`") for n in ["taxpayer_id", *names, "store", "taxpayer_group"]]
    writer = ordered.select(*columns).write.mode("append").partitionBy("store", "taxpayer_group")
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")
    else:
        writer = writer.options(header="true", escape='"', ignoreTrailingWhiteSpace="false", ignoreLeadingWhiteSpace="false")
    with tidy(rows.sparkSession):
        writer.format(fmt).save(path)


def write_exports(spark: SparkSession, sf_dir: str, platform: str) -> str:
    """Land one platform's exports in the shared folder: TikTok as CSV in two
    versions with other column orders, the workbooks as Parquet."""
    root = fresh_folder(spark, "exports")
    path = f"{root}/kind=sale/platform={platform}"
    rows = render_export(order_lines(spark, sf_dir, platform), platform)
    # The order number is both a sort key and, rendered, an export column.
    names = _export_names(platform)
    if platform == "TikTok":
        even = F.col("taxpayer_group") % 2 == 0
        _write_export(rows.filter(even), names, path, "csv")
        _write_export(rows.filter(~even).withColumn("note", F.lit('say "hi", later')), [*reversed(names), "note"], path, "csv")
    else:
        _write_export(rows, names, path, "parquet")
    return root


def write_incomplete_exports(spark: SparkSession, sf_dir: str, platform: str, fmt: str) -> str:
    """Exports of which every fourth group lacks a required column of money."""
    root = fresh_folder(spark, "exports")
    rows = render_export(order_lines(spark, sf_dir, platform), platform)
    columns, names = RULES[platform].columns, _export_names(platform)
    short = F.col("taxpayer_group") % 4 == 1
    _write_export(rows.filter(~short), names, f"{root}/platform={platform}", fmt)
    _write_export(rows.filter(short), [n for n in names if n != columns.get("discount", columns["item"])], f"{root}/platform={platform}", fmt)
    return root


def write_fee_files(spark: SparkSession, sf_dir: str) -> str:
    """Fee documents landed in folders per platform, store and group of taxpayers."""
    root = fresh_folder(spark, "fees")
    pages = invoice_pages(spark, sf_dir).withColumn("taxpayer_group", F.col("taxpayer_id") % TAXPAYER_GROUPS)
    folders = ["platform", "store", "taxpayer_group"]
    with tidy(spark):
        pages.repartitionByRange(*folders).write.partitionBy(*folders).parquet(f"{root}/kind=commission")
    return root


# --- fee documents -----------------------------------------------------------

SELLER_FEE_PERCENT = 3
ISSUERS = {"Shopee": "Shopee (Thailand) Co., Ltd.", "Lazada": "Lazada Limited", "TikTok": "TikTok Shop (Thailand) Ltd."}


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fee documents as structured rows; `kind` tells what is special.

    fee: the month's fee. copy: handed in again with the same number. credit:
    credit note. late: dated a month later. other: another company's. broken:
    a line is missing. express, spx, journal, ads: documents to be left out.
    """
    month = (
        sales_rows(spark, sf_dir)
        .withColumns({"year": F.year("order_date"), "month": F.month("order_date")})
        .groupBy("taxpayer_id", "store", "platform", "year", "month")
        .agg(F.sum("item_c").alias("item_c"), F.sum(F.when(F.col("returned"), F.col("item_c")).otherwise(0)).alias("ret_c"))
    )
    store_no = F.substring("store", 6, 1).cast("long") - 1
    platform_no = F.when(F.col("platform") == "Shopee", 0).when(F.col("platform") == "Lazada", 1).otherwise(2)
    source_no = (F.col("taxpayer_id") * 3 + store_no) * 3 + platform_no
    inv = F.col("inv_id")
    shopee, lazada, tiktok = (F.col("platform") == p for p in RULES)
    kinds = [
        ("fee", F.lit(True)),
        ("credit", lazada & (F.col("ret_c") > 0)),
        ("copy", lazada & (inv % 10 == 0)),
        ("express", lazada & (inv % 13 == 0)),
        ("late", inv % 17 == 0),
        ("other", inv % 5 == 0),
        ("broken", inv % 23 == 0),
        ("spx", shopee & (inv % 11 == 0)),
        ("journal", tiktok & (inv % 11 == 0)),
        ("ads", tiktok & (inv % 19 == 0)),
    ]
    each = F.array_compact(
        F.array(*[F.when(hit, F.struct(F.lit(k).alias("kind"), F.lit(i).alias("ord"))) for i, (k, hit) in enumerate(kinds)])
    )
    kind = F.col("kind")
    fee = whole_div(F.col("item_c") * SELLER_FEE_PERCENT + 50, 100)
    net = (
        F.when(kind == "credit", -whole_div(F.col("ret_c") * SELLER_FEE_PERCENT + 50, 100))
        .when(kind == "copy", fee + 100)
        .when(kind == "other", whole_div(fee, 2))
        .otherwise(fee)
    )
    vat_size = whole_div(F.abs("before_vat_c") * 7 + 50, 100)
    day = F.make_date("year", "month", (inv % 28 + 1).cast("int"))
    number = F.lpad(F.col("taxpayer_id").cast("string"), 12, "0")
    digits = inv.cast("string")
    return (
        month.withColumn("inv_id", source_no * 100000 + F.col("year") * 12 + F.col("month") - 1)
        .withColumn("doc", F.explode(each))
        .select("*", "doc.kind", F.col("doc.ord").alias("upload_ord"))
        .withColumn("before_vat_c", net)
        .select(
            "taxpayer_id",
            "store",
            "platform",
            "year",
            "month",
            "inv_id",
            "kind",
            "upload_ord",
            F.concat_ws("-", digits, kind).alias("doc_id"),
            F.when(kind == "late", F.add_months(day, 1)).otherwise(day).alias("doc_date"),
            F.concat(F.when(kind == "other", "Agency ").otherwise("Company "), F.col("taxpayer_id").cast("string"), F.lit(" Limited")).alias("company_name"),
            F.when(kind == "other", F.concat(F.lit("TH9"), number))
            .when(inv % 3 == 0, F.concat(F.lit("th 0"), number))
            .otherwise(F.concat(F.lit("TH0"), number))
            .alias("tax_id"),
            per_platform(lambda rule: F.lit(ISSUERS[rule.name])).alias("issuer"),
            F.when(shopee, F.concat(F.lit("TRS"), digits, F.lit(" S-"), kind))
            .when(tiktok, F.concat(F.lit("TTS"), digits, F.lit("-"), kind))
            .when(kind == "credit", F.concat(F.lit("CN"), digits))
            .when(kind.isin("fee", "copy"), F.concat(F.lit("THMP"), digits))
            .otherwise(F.concat(F.lit("THMP"), digits, F.lit("-"), kind))
            .alias("doc_num"),
            F.when(
                shopee,
                F.concat(
                    F.when(kind == "spx", "Shopee-SPX-TRS-").otherwise("Shopee-TIV-TRS-"),
                    digits, F.lit("-"), F.lpad((F.col("upload_ord") + 1).cast("string"), 5, "0"), F.lit("-"), kind, F.lit(".pdf"),
                ),
            )
            .when(kind == "journal", F.concat(F.lit("THJV"), digits, F.lit(".pdf")))
            .when(kind == "ads", F.concat(F.lit("TTSTHAC"), digits, F.lit(".pdf")))
            .otherwise(F.concat(digits, F.lit("_"), kind, F.lit(".pdf")))
            .alias("file_name"),
            "before_vat_c",
            F.when(F.col("before_vat_c") < 0, -vat_size).otherwise(vat_size).alias("vat_c"),
        )
    )


def _invoice_text() -> Column:
    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    net, vat = grouped_label(F.abs("before_vat_c")), grouped_label(F.abs("vat_c"))
    gross = grouped_label(F.abs("before_vat_c") + F.abs("vat_c"))
    whole = F.col("kind") != "broken"
    company, tax, issuer, number = (F.col(c) for c in ("company_name", "tax_id", "issuer", "doc_num"))
    day = F.col("doc_date")
    iso = day.cast("string")

    def page(*lines) -> Column:
        return F.concat_ws("\n", *[F.lit(line) if isinstance(line, str) else line for line in lines])

    shopee = page(
        "ใบเสร็จรับเงิน/ใบกำกับภาษี",
        issuer,
        text("Customer name ", company),
        text("เลขประจำตัวผู้เสียภาษี/Tax ID ", tax, "เลขที่/No. ", F.substring_index(number, " ", 1)),
        F.substring_index(number, " ", -1),
        text("วันที่/Date ", F.date_format(day, "dd/MM/yyyy")),
        "กรุณาชำระภายในวันที่ 01/01/1990",
        F.when(whole, text("Total amount after discount ", net)),
        text("VAT 7% ", vat),
        text("Grand total ", gross),
    )
    invoice = page(
        "TAX INVOICE / RECEIPT", "Bill to", company, "1 Road", "District", "Bangkok", "10110",
        text("Tax ID: ", tax, "Invoice Date: ", iso),
        text("Invoice No.: ", number),
        F.when(F.col("kind") == "express", "Lazada Express Limited").otherwise(issuer),
        "Commission",
        F.when(whole, text("Total ", net)),
        text("7% (VAT) ", vat),
        text("Total (Including Tax) ", gross),
    )
    credit = page(
        "CREDIT NOTE", "Bill to", F.replace(company, F.lit(" "), F.lit("  ")), "1 Road", "District", "Bangkok", "10110",
        text("Tax ID: ", tax, "Credit Note: ", number),
        text("Date: ", iso),
        issuer,
        "Reversal Commission",
        text("Total ", net),
        text("7% (VAT) ", vat),
        text("Total (Including Tax) ", gross),
    )
    tiktok = page(
        text("Invoice number : ", number),
        text("Invoice date : ", F.date_format(day, "MMM d, yyyy")),
        issuer,
        "This invoice is prepared by TikTok Pte. Ltd.",
        "For corporate customers of TikTok Pte. Ltd.",
        text("Client Name: ", company),
        text("Tax ID: ", tax),
        F.when(whole, text("Subtotal (excluding VAT) ฿", net)),
        text("Total VAT 7% ฿", vat),
        text("Total amount ฿", gross),
    )
    return (
        F.when(F.col("platform") == "Shopee", shopee)
        .when(F.col("platform") == "TikTok", tiktok)
        .when(F.col("kind") == "credit", credit)
        .otherwise(invoice)
    )


DOC_COLUMNS = ["taxpayer_id", "store", "platform", "year", "month", "doc_id", "file_name", "upload_ord"]


def invoice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page texts of the fee documents. Every second has another page, whose
    amounts must not be read."""
    more = F.lit("Total 9,999.99\nTotal VAT 7% ฿9.99\nVAT 7% 9.99\nInvoice number : NO")
    pages = F.when(F.col("inv_id") % 2 == 0, F.array("first", "more")).otherwise(F.array("first"))
    # A reader of one platform's documents gets no others rendered.
    return sealed(
        sealed(invoices(spark, sf_dir), "platform")
        .withColumns({"first": _invoice_text(), "more": more})
        .select(*DOC_COLUMNS, F.posexplode(pages).alias("page_no", "text")),
        "platform",
    )
