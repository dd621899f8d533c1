"""Sales-tax ledger: one goods row per order, one service row for its shipping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxweave.functions import money
from taxweave.operators.daily import order_discount, order_shipping
from taxweave.operators.lines import SOURCE
from taxweave.rules import GOODS, SERVICE, VAT_PERCENT


def order_totals(lines: DataFrame) -> DataFrame:
    """Per source, month and order: the amounts and the first line's date,
    status and customer. Copies count once, so `lines` must be free of them.

    Sums and first-line picks are combined before the shuffle, so an order
    number that holds a large part of the lines is no hot task.
    """
    first = F.min_by(F.struct("order_date", "status", "customer_name", "disc_c", "ship_c"), "line_ord")
    return (
        lines.filter(F.col("order_no").isNotNull() & F.col("order_date").isNotNull())
        .groupBy(*SOURCE, "year", "month", "order_no")
        .agg(first.alias("first"), F.sum("item_c").alias("items"), F.sum("disc_c").alias("disc_total"))
        .select(
            *SOURCE,
            "year",
            "month",
            "order_no",
            "first.order_date",
            "first.status",
            "first.customer_name",
            F.coalesce("items", F.lit(0)).alias("items"),
            "disc_total",
            F.col("first.disc_c").alias("disc_first"),
            F.col("first.ship_c").alias("ship_first"),
        )
        .withColumns(
            {
                "goods_c": F.col("items") - order_discount("disc_first", "disc_total"),
                "service_c": order_shipping("ship_first"),
            }
        )
    )


LEDGER = [*SOURCE, "year", "month", "type", "order_date", "status", "order_no", "customer_name"]


def _ledger_rows(orders: DataFrame, percent: int) -> DataFrame:
    vat = money.vat_inside(F.col("include_vat_c"), percent)
    return orders.withColumn("vat_c", vat).select(
        *LEDGER, (F.col("include_vat_c") - F.col("vat_c")).alias("before_vat_c"), "vat_c", "include_vat_c"
    )


def order_sales_ledger(orders: DataFrame, percent: int = VAT_PERCENT) -> DataFrame:
    """The goods row of every order."""
    goods = orders.withColumns({"type": F.lit(GOODS), "include_vat_c": F.col("goods_c")})
    return _ledger_rows(goods, percent)


def shipping_sales_ledger(orders: DataFrame, percent: int = VAT_PERCENT) -> DataFrame:
    """The service row of every order whose buyer paid shipping to the seller."""
    service = orders.filter(F.col("service_c") != 0).withColumns(
        {"type": F.lit(SERVICE), "include_vat_c": F.col("service_c")}
    )
    return _ledger_rows(service, percent)


def sales_ledger(orders: DataFrame, percent: int = VAT_PERCENT) -> DataFrame:
    """Goods and service rows from one pass over the order totals."""
    rows = F.array(
        F.struct(F.lit(GOODS).alias("type"), F.col("goods_c").alias("include_vat_c")),
        F.struct(F.lit(SERVICE).alias("type"), F.col("service_c").alias("include_vat_c")),
    )
    both = (
        orders.withColumn("row", F.explode(rows))
        .select("*", "row.type", "row.include_vat_c")
        .filter((F.col("type") == GOODS) | (F.col("include_vat_c") != 0))
    )
    return _ledger_rows(both, percent)


def union_ledgers(ledgers: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; a column that one ledger lacks becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ledgers)
