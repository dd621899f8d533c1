"""Written results: daily sales, tax ledgers, receipts, run audit.

Folders are years or months and, below them, a fixed number of taxpayer ranges. A folder per
taxpayer would make as many small files as there are taxpayers; instead rows are range-partitioned and
sorted by taxpayer, so Parquet statistics skip to one taxpayer's rows, and a
taxpayer with very many rows is spread over several files. Which files are live is
named by a manifest (`versions`), so a filing replaces its taxpayers' ranges at once.
"""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from taxweave.operators.lines import SOURCE
from taxweave.session import settling
from taxweave.sinks.versions import Conflict, Versions

#: Taxpayer ranges of a folder are as many as give this many rows each at the first write, unless its writer names a number.
ROWS_OF_RANGE, MOST_RANGES = 1_000_000, 4096
#: Rows that one task sorts and writes of a large report. Bytes of the shuffle don't tell its memory: rows of mostly zeros shrink to a thirtieth there.
ROWS_OF_TASK = 500_000


def read_written(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The live rows of what was written below path; no rows if nothing was yet."""
    table = Versions(spark, path)
    rows = table.read(table.state(), schema, fmt=fmt)
    return spark.createDataFrame([], schema) if rows is None else rows


def _fitting(rows: DataFrame, folders: list[str]) -> int:
    largest = rows.groupBy(*folders).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return min(MOST_RANGES, max(1, -(-largest // ROWS_OF_RANGE)))


def taxpayer_range(ranges: int) -> Column:
    return F.pmod(F.xxhash64(F.col("taxpayer_id").cast("string")), F.lit(ranges)).alias("range")


def _unit(folders: list[str], row: Row) -> str:
    return "/".join(f"{c}={row[c]}" for c in [*folders, "range"])


def _write_sorted(
    df: DataFrame, path: str, folders: list[str], order: list[str], fmt: str, run: DataFrame | None = None, ranges: int | None = None, tries: int = 5, written: bool = False
) -> None:
    """Replace the rows of the run's taxpayers in the run's folders; all other rows stay.

    `run` has the run's taxpayers and folders, also those without rows now, whose
    earlier rows go. Without it they are those of the rows themselves.

    With `written` the rows and the run are read from written tables, and the run has all taxpayers and folders of the rows.

    A folder's taxpayers are dealt into ranges by a hash; the table's first writer fixes how many. Only
    the ranges of the run's taxpayers are read and written, and one commit makes them live.
    """
    spark, table = df.sparkSession, Versions(df.sparkSession, path)
    unit = ["taxpayer_id", *folders]
    with settling(spark) as keep:
        new = df if written else keep(df, "report")
        touched = run if written else keep((new if run is None else new.select(*unit).union(run.select(*unit))).select(*unit).distinct(), "touched")
        for attempt in range(tries):
            seen = table.state()
            noted = seen.notes.get("ranges")
            ranges = int(noted) if noted else ranges or _fitting(new, folders)
            place = taxpayer_range(ranges)
            # At most one row for each folder and range.
            units = [_unit(folders, r) for r in touched.select(*folders, place).distinct().collect()]
            rows = new.select("*", place)
            old = table.read(seen, df.schema, units, fmt)
            if old is not None:
                same = [F.col(f"old.{c}").eqNullSafe(F.col(f"run.{c}")) for c in unit]
                rows = keep(old.alias("old").join(touched.alias("run"), same, "left_anti").select("*", place).unionByName(rows), "rows")
            version, target = table.fresh()
            # At most one row for each folder and range.
            sizes = {_unit(folders, r): r.n for r in rows.groupBy(*folders, "range").agg(F.count("*").alias("n")).collect()}
            tasks = -(-sum(sizes.values()) // ROWS_OF_TASK)
            (
                rows.repartitionByRange(*([tasks] if tasks > 1 else []), *folders, "range", *order)
                .sortWithinPartitions(*folders, "range", *order)
                .write.option("header", "true")
                .partitionBy(*folders, "range")
                .format(fmt)
                .save(target)
            )
            try:
                table.commit(seen, {u: version if u in sizes else None for u in units}, {"ranges": str(ranges)})
                return
            except Conflict:
                if attempt == tries - 1:
                    raise


def write_daily_sales(report: DataFrame, path: str, fmt: str = "parquet", ranges: int | None = None) -> None:
    """The daily report with sum and running total, by year. A
    year of the report's taxpayers is replaced as a whole; other years and taxpayers stay."""
    _write_sorted(report, path, ["year"], ["taxpayer_id", "date"], fmt, ranges=ranges)


def write_tax_ledgers(
    sales: DataFrame, purchases: DataFrame, path: str, fmt: str = "parquet", run: DataFrame | None = None, ranges: int | None = None, written: bool = False
) -> None:
    """Output-tax and input-tax reports, by year and month. `written`: see `_write_sorted`."""
    _write_sorted(sales, f"{path}/sales", ["year", "month"], [*SOURCE, "order_date", "order_no"], fmt, run, ranges, written=written)
    _write_sorted(purchases, f"{path}/purchases", ["year", "month"], [*SOURCE, "doc_date", "doc_num"], fmt, run, ranges, written=written)


def write_receipts(invoices: DataFrame, path: str, fmt: str = "parquet", run: DataFrame | None = None, ranges: int | None = None, written: bool = False) -> None:
    """The receipt manifest, by year and month."""
    order = ["taxpayer_id", "bundle", "doc_date", "doc_num", "file_name"]
    _write_sorted(_receipts(invoices), path, ["year", "month"], order, fmt, run, ranges, written=written)


BUNDLE = ["taxpayer_id", "year", "month", "bundle"]


def _receipts(invoices: DataFrame) -> DataFrame:
    bundle = F.concat("store", F.lit("_"), "platform", F.lit("_commission_receipt"))
    return invoices.withColumn("bundle", bundle).select(*BUNDLE, "doc_date", "doc_num", "file_name")


def receipt_manifest(invoices: DataFrame) -> DataFrame:
    """The receipts of each (store, platform) bundle in ascending date.

    One row per receipt in global order; a bundle is never gathered into one
    row or task, however many receipts it holds.
    """
    return _receipts(invoices).orderBy(*BUNDLE, "doc_date", "doc_num", "file_name")


def receipt_bundles(invoices: DataFrame) -> DataFrame:
    """Per bundle: number of receipts and the first and last date."""
    return (
        _receipts(invoices)
        .groupBy(*BUNDLE)
        .agg(
            F.count(F.lit(1)).alias("receipts"),
            F.min("doc_date").alias("first_date"),
            F.max("doc_date").alias("last_date"),
        )
    )


def run_audit(amounts: DataFrame, job: str, period, run_at: dt.datetime, user_type: str) -> DataFrame:
    """One row per taxpayer: the run, its stores joined by ', ' and the total.

    `amounts` has taxpayer_id, store, amount_c. Rows are summed per store
    first, so the list of store names is built from distinct names. No personal
    data is kept.
    """
    per_store = amounts.groupBy("taxpayer_id", "store").agg(F.sum("amount_c").alias("amount_c"))
    return per_store.groupBy("taxpayer_id").agg(
        F.lit(job).alias("job"),
        F.lit(str(period)).alias("period"),
        F.lit(run_at.strftime("%Y-%m-%d %H:%M:%S")).alias("run_at"),
        F.lit(user_type).alias("user_type"),
        F.concat_ws(", ", F.sort_array(F.collect_set("store"))).alias("stores"),
        F.sum("amount_c").alias("total_c"),
    )


def append_run_audit(audit: DataFrame, path: str, run_id: str | None = None) -> bool:
    """Add a run's rows, unless the run is there already, so a retried run adds nothing. Tells if it did.

    A run is known by `run_id`, or else by its job, period, time and user type.
    """
    spark, table = audit.sparkSession, Versions(audit.sparkSession, path)
    first = audit.select("job", "period", "run_at", "user_type").first()
    if first is None:
        return False
    unit = f"run={hashlib.sha256((run_id or repr(tuple(first))).encode()).hexdigest()}"
    seen = table.state()
    if unit in seen.units:
        return False
    version, target = table.fresh()
    audit.write.parquet(f"{target}/{unit}")
    try:
        table.commit(seen, {unit: version})
    except Conflict:  # the same run, from another driver
        return False
    return True
