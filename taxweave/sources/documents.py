"""Fee documents: first-page texts, files left out by name, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxweave.rules import RULES


def first_pages(docs: DataFrame) -> DataFrame:
    """First pages of the files that count, with their place in reading order.

    `sort_num` is the fifth dash-separated part of the name as a number
    (Shopee); TikTok files sort by name and Lazada files by upload_ord.
    """
    left_out = F.lit(False)
    for rule in RULES.values():
        for word in rule.skipped_files:
            left_out = left_out | ((F.col("platform") == rule.name) & F.col("file_name").contains(word))
    fifth = F.try_element_at(F.split("file_name", "-"), F.lit(5)).try_cast("int")
    return (
        docs.filter((F.col("page_no") == 0) & ~left_out)
        .withColumn("sort_num", F.when(F.col("platform") == "Shopee", fifth))
        .drop("page_no")
    )


def scan_invoice_docs(spark: SparkSession, path: str) -> DataFrame:
    """First pages from a Parquet table of page texts; the page and name
    filters reach the scan."""
    return first_pages(spark.read.parquet(path))
