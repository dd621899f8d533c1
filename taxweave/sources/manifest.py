"""Manifest of uploaded files, read from the folder listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxweave.sources.exports import list_files

PARTS = ("kind", "platform", "store", "taxpayer_id")


def scan_input_manifest(spark: SparkSession, root: str | list[str], pattern: str = "*", parts=PARTS) -> DataFrame:
    """One row per uploaded file: kind, platform, store, taxpayer and size.

    The folders are named kind=../platform=../store=../taxpayer_id=.. in any
    order (`parts`); contents are never opened.
    """
    files = list_files(spark, root, pattern)
    placed = [F.regexp_extract("path", f"/{name}=([^/]*)/", 1).alias(name) for name in parts]
    return files.select(*placed, F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "path")
