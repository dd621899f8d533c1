"""VAT return: output tax of the sales ledger less input tax of the fees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxweave.functions import money

PERIOD = ["taxpayer_id", "year", "month"]


def vat_return(sales: DataFrame, purchases: DataFrame) -> DataFrame:
    """Five measures per taxpayer and month. A side without rows counts as 0.

    Both ledgers are stacked and summed in one aggregate, so the lines are
    combined before the only shuffle and no join is needed.
    """
    nothing = F.lit(0).cast("long")
    stacked = sales.select(
        *PERIOD,
        F.col("before_vat_c").alias("sales_before_vat_c"),
        F.col("vat_c").alias("output_vat_c"),
        nothing.alias("expense_before_vat_c"),
        nothing.alias("input_vat_c"),
    ).unionByName(
        purchases.select(
            *PERIOD,
            nothing.alias("sales_before_vat_c"),
            nothing.alias("output_vat_c"),
            F.col("before_vat_c").alias("expense_before_vat_c"),
            F.col("vat_c").alias("input_vat_c"),
        )
    )
    measures = ["sales_before_vat_c", "output_vat_c", "expense_before_vat_c", "input_vat_c"]
    return (
        stacked.groupBy(*PERIOD)
        .agg(*[F.sum(m).alias(m) for m in measures])
        .withColumn("payable_c", F.col("output_vat_c") - F.col("input_vat_c"))
        .withColumn("payable_label", money.grouped_label(F.col("payable_c")))
    )
