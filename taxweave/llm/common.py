"""What several text operators share: tables in the shared folder, text columns, Arrow rows."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxweave.session import fresh_folder, tidy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "[\\x20\\x09-\\x0D]+"
#: Arrow batches are taken apart into pieces of so many bytes of text (a longer text is its own piece).
PIECE_BYTES = 1 << 20

_settled: dict[str, list[str]] = {}
_kept: dict[str, Callable[[], None]] = {}


def begin(operator: str, forget: Callable[[], None] | None = None) -> None:
    """What an operator's function calls in a Python worker when it begins, and how it gives up what it keeps there.

    Spark uses a worker again for later stages, so what other operators have kept goes now.
    """
    for other in [o for o in _kept if o != operator]:
        _kept.pop(other)()
    if forget is not None:
        _kept[operator] = forget


def settle(df: DataFrame, name: str, partition_by: str | None = None, large: bool = False) -> DataFrame:
    """Write to the shared folder and go on from the written table; `release` removes it.

    The shuffle files behind the table go with the write. What else Spark keeps goes when the driver has
    collected its garbage, which it is asked for behind a large table, so that it doesn't add up over the steps.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    _settled.setdefault(spark.sparkContext.applicationId, []).append(path)
    with tidy(spark):
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    if large:
        for _ in range(2):  # what the listeners still hold after the first time goes the second time
            gc.collect()
            spark.sparkContext._jvm.System.gc()
            time.sleep(1)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession) -> list[str]:
    """The tables settled and not released so far."""
    return list(_settled.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove these settled tables, once the results that read them are written."""
    context = spark.sparkContext
    left = _settled.get(context.applicationId, [])
    for path in paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        if path in left:
            left.remove(path)


def release_others(spark: SparkSession, kept: list[str], *names: str) -> None:
    """Of the tables settled since `kept` was listed only those of these names stay."""
    name = lambda path: path.rsplit("/", 1)[1].rsplit("-", 1)[0]
    release(spark, [p for p in settled(spark) if p not in kept and name(p) not in names])


def words(text: Column) -> Column:
    """Words between spaces and \\x09-\\x0D; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def in_class(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def pieces(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in parts of a bounded number of text bytes."""
    sizes = batch.column(column)
    start, held = 0, 0
    for row in range(batch.num_rows):
        held += len(sizes[row].as_buffer() or b"") if sizes[row].is_valid else 0
        if held >= PIECE_BYTES:
            yield batch.slice(start, row + 1 - start)
            start, held = row + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
