"""What differs between the marketplaces, as data.

Operators turn these records into column expressions, so one plan serves all
platforms and no rule table has to be joined.
"""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the tax.
VAT_PERCENT = 7
THRESHOLD_SATANG = 1_800_000 * 100
AMBER_SATANG = 1_500_000 * 100

# Fixed values of the ledgers and the receipt bundles.
GOODS = "สินค้า"
SERVICE = "บริการ"
PLATFORMS = ("Shopee", "Lazada", "TikTok")
INPUT_KINDS = ("sale", "commission")


@dataclass(frozen=True)
class PlatformRule:
    """Column names, words and formats of one marketplace's order export."""

    name: str
    columns: dict[str, str]  # canonical name -> export column
    carried: tuple[str, ...]  # export columns that only take part in duplicates
    required: tuple[str, ...]  # canonical names the threshold job insists on
    cancelled: tuple[str, ...]
    done: str
    time_format: str
    discount: str  # "first" line of the order, "sum" of its lines, or "none"
    shipping: bool  # buyer-paid shipping is revenue of the seller
    dedup_daily: bool  # exact copies are dropped before the daily job
    missing_month: str  # severity of a month without rows
    skipped_files: tuple[str, ...]  # fee documents left out by file name

    def required_columns(self) -> list[str]:
        return [self.columns[name] for name in self.required]


# Fixed values of the three order exports.
SHOPEE = PlatformRule(
    name="Shopee",
    columns={
        "order_no": "หมายเลขคำสั่งซื้อ",
        "status": "สถานะการสั่งซื้อ",
        "ordered_at": "วันที่ทำการสั่งซื้อ",
        "item": "ราคาขายสุทธิ",
        "discount": "โค้ดส่วนลดชำระโดยผู้ขาย",
        "shipping": "ค่าจัดส่งที่ชำระโดยผู้ซื้อ",
        "customer_name": "ชื่อผู้ใช้ (ผู้ซื้อ)",
    },
    carried=("ค่าจัดส่งที่ Shopee ออกให้โดยประมาณ", "ค่าจัดส่งสินค้าคืน", "ค่าจัดส่งโดยประมาณ"),
    required=("order_no", "status", "ordered_at", "item", "discount", "shipping"),
    cancelled=("ยกเลิกแล้ว",),
    done="สำเร็จแล้ว",
    time_format="yyyy-M-d H:mm",
    discount="first",
    shipping=True,
    dedup_daily=True,
    missing_month="warn",
    skipped_files=("SPX",),
)
LAZADA = PlatformRule(
    name="Lazada",
    columns={
        "order_no": "orderNumber",
        "status": "status",
        "ordered_at": "createTime",
        "item": "paidPrice",
        "customer_name": "customerName",
    },
    carried=("sellerDiscountTotal",),
    required=("status", "order_no", "ordered_at", "item"),
    cancelled=("canceled", "returned", "Package Returned"),
    done="confirmed",
    time_format="d MMM yyyy H:mm",
    discount="none",
    shipping=False,
    dedup_daily=False,
    missing_month="warn",
    skipped_files=(),
)
TIKTOK = PlatformRule(
    name="TikTok",
    columns={
        "order_no": "Order ID",
        "status": "Order Status",
        "ordered_at": "Created Time",
        "item": "SKU Subtotal Before Discount",
        "discount": "SKU Seller Discount",
        "shipping": "Shipping Fee After Discount",
        "customer_name": "Buyer Username",
    },
    carried=(),
    required=("order_no", "status", "ordered_at", "item", "shipping", "discount"),
    cancelled=("Canceled",),
    done="Completed",
    time_format="d/M/yyyy H:mm:ss",
    discount="sum",
    shipping=True,
    dedup_daily=True,
    missing_month="reject",
    skipped_files=("THJV", "TTSTHAC"),
)
RULES = {rule.name: rule for rule in (SHOPEE, LAZADA, TIKTOK)}


@dataclass(frozen=True)
class Mark:
    """Marks an invoice line: it holds every word of `has` and none of `lacks`."""

    tag: str
    has: tuple[str, ...]
    lacks: tuple[str, ...] = ()


# Fixed values of the four invoice layouts. A line takes the first mark that
# fits; over the document the last line with a mark counts.
INVOICE_MARKS = {
    "shopee": (
        Mark("date", ("วันที่",), ("ภายในวันที่",)),
        Mark("issuer", ("Co.,",)),
        Mark("number_and_tax_id", ("เลขที่", "เลขประจำตัวผู้เสียภาษี")),
        Mark("number", ("เลขที่",)),
        Mark("tax_id", ("เลขประจำตัวผู้เสียภาษี",)),
        Mark("net", ("after discount",)),
        Mark("vat", ("VAT", "7%")),
        Mark("company", ("Customer name",)),
    ),
    "lazada_invoice": (
        Mark("date", ("Invoice Date",)),
        Mark("issuer", ("Lazada",)),
        Mark("net", ("Total",), ("(Including Tax)",)),
        Mark("vat", ("7% (VAT)",)),
        Mark("number", ("Invoice No.:",)),
        Mark("heading", ("TAX INVOICE / RECEIPT",)),
    ),
    "lazada_credit": (
        Mark("date", ("Date: ",)),
        Mark("issuer", ("Lazada",)),
        Mark("net", ("Total",), ("(Including Tax)",)),
        Mark("vat", ("7% (VAT)",)),
        Mark("heading", ("CREDIT NOTE",)),
        Mark("number", ("Credit Note: ",)),
    ),
    "tiktok": (
        Mark("date", ("Invoice date",)),
        Mark("issuer", ("Ltd.",), ("prepared by", "For corporate")),
        Mark("number", ("Invoice number : ",)),
        Mark("net", ("Subtotal (excluding VAT)",)),
        Mark("vat", ("Total VAT", "7%")),
        Mark("company", ("Client Name",)),
        Mark("tax_id", ("Tax ID:",)),
    ),
}
LAZADA_SKIP_WORDS = ("Lazada Express Limited", "Shipping Fee")
LAZADA_INVOICE_WORD = "TAX INVOICE / RECEIPT"
LAZADA_CREDIT_WORDS = ("CREDIT NOTE", "Reversal Commission")
