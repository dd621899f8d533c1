"""Order exports: headers, scan, union by column name.

Exports are landed as CSV or Parquet with the export's own columns. taxpayer_id
and store are columns of the file or parts of its folder, like store=x.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# pandas reads a doubled quote inside quotes as one quote; so does this.
CSV_OPTIONS = {"header": "true", "escape": '"', "encoding": "UTF-8"}
HEADER_BYTES = 1 << 16
CSV_FILES = "*.[cC][sS][vV]"


def list_files(spark: SparkSession, root: str | list[str], pattern: str = "*") -> DataFrame:
    """One row per file below a folder. File contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path", "length", "modificationTime")
    )


def _arrow_uri(path: str) -> str:
    """Spark lists file:/x and s3a://x, Arrow wants file:///x and s3://x."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = path.replace("file:/", "file:///", 1)
    return quote(path.replace("s3a://", "s3://", 1), safe=":/")


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for batch in batches:
        lines = []
        for path in batch["file_path"]:
            store, name = fs.FileSystem.from_uri(_arrow_uri(path))
            with store.open_input_stream(name) as stream:
                head = b""
                while b"\n" not in head:
                    more = stream.read(HEADER_BYTES)
                    if not more:
                        break
                    head += more
            lines.append(head.split(b"\n", 1)[0].rstrip(b"\r").decode("utf-8-sig"))
        yield pd.DataFrame({"file_path": batch["file_path"], "value": lines})


def csv_headers(
    spark: SparkSession, root: str | list[str], pattern: str = CSV_FILES, by_scan: bool = False
) -> DataFrame:
    """One row per CSV file: file_path and header (array of column names).

    Only the first bytes of each file are read, in parallel over the listing,
    so checking the columns does not cost a scan of the data. `by_scan` reads
    the files as text instead, for storage that only Spark can open.
    """
    if by_scan:
        lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
        placed = lines.select(
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.regexp_replace("value", "^\ufeff", "").alias("value"),
        )
        first = placed.filter(F.col("block") == 0).groupBy("file_path").agg(F.min_by("value", "row").alias("value"))
        return first.select("file_path", header_names(F.col("value")).alias("header"))
    # The path stays as listed: _metadata.file_path would be URL-encoded.
    files = list_files(spark, root, pattern).select(F.col("path").alias("file_path"))
    first = files.mapInPandas(_first_lines, "file_path string, value string")
    return first.select("file_path", header_names(F.col("value")).alias("header"))


def _parquet_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs, parquet

    for batch in batches:
        names = []
        for path in batch["file_path"]:
            store, name = fs.FileSystem.from_uri(_arrow_uri(path))
            names.append(parquet.read_schema(name, filesystem=store).names)
        yield pd.DataFrame({"file_path": batch["file_path"], "header": names})


def parquet_headers(spark: SparkSession, root: str | list[str], pattern: str = "*.parquet") -> DataFrame:
    """The same for Parquet exports: column names from each file's footer."""
    files = list_files(spark, root, pattern).select(F.col("path").alias("file_path"))
    return files.mapInPandas(_parquet_names, "file_path string, header array<string>")


def header_names(line):
    """Column names of a CSV header line. Commas inside quotes do not split."""
    parts = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(
        parts,
        lambda p: F.when(
            p.startswith('"') & p.endswith('"'),
            F.replace(F.regexp_replace(p, '^"|"$', ""), F.lit('""'), F.lit('"')),
        ).otherwise(p),
    )


def _plain_path(path: Column) -> Column:
    """One spelling of a path: listings say file:/x and readers file:///x."""
    return F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/")


def _own_path() -> Column:
    # The path is URL-encoded; a plus in it is a plus.
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def with_source(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add what the file's place tells: taxpayer and store where they are no
    columns, and the row order of the upload as file, block, row in block."""
    path = _own_path()
    placed = {
        name: F.nullif(F.regexp_extract(path, f"/{name}=([^/]*)/", 1), F.lit(""))
        for name in ("taxpayer_id", "store")
        if name not in (df.columns if columns is None else columns)
    }
    order = F.struct(
        path.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    return df.withColumns({**placed, "line_ord": order})


def whole_files(headers: DataFrame, required: list[str] | None) -> DataFrame:
    """The files whose header has all required columns."""
    if not required:
        return headers
    return headers.filter(F.size(F.array_except(F.array(*[F.lit(c) for c in required]), "header")) == 0)


def _scan_csv(spark: SparkSession, root: str | list[str], headers: DataFrame, multi_line: bool, required: list[str] | None) -> DataFrame:
    """One read of all files by position; a row's cells get the names of its own file's header."""
    # One row: as many names as the marketplace's exports have had columns.
    seen = headers.select(F.posexplode("header").alias("at", "name")).agg(F.max("at").alias("last"), F.array_sort(F.collect_set("name")).alias("names")).first()
    names = seen.names or sorted(required or [])
    width = 1 if seen.last is None else seen.last + 1
    places = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.nullif(F.array_position("header", n).cast("int"), F.lit(0)) - 1)
    files = headers.select(_plain_path(F.col("file_path")).alias("own_file"), places.alias("places"))
    cells = [f"c{i}" for i in range(width)]
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower()).schema(", ".join(f"{c} string" for c in cells))
    raw = with_source(reader.option("recursiveFileLookup", "true").option("pathGlobFilter", CSV_FILES).csv(root), names)
    added = [c for c in raw.columns if c not in cells and c != "line_ord"]
    # A row for each file, which the driver has listed: the cells aren't shuffled to meet it.
    joined = raw.withColumn("cells", F.array(*cells)).join(F.broadcast(files), _plain_path(F.col("line_ord.file")) == F.col("own_file"))
    named = [F.get("cells", F.get("places", F.lit(i))).alias(name) for i, name in enumerate(names)]
    return joined.select(*named, *added, "line_ord")


def _as_text(name: str, kind: str, date_format: str | None):
    """A cell as the export writes it; workbooks keep days as dates and times."""
    column = F.col(f"`{name}`")
    if date_format and (kind == "date" or kind.startswith("timestamp")):
        return F.date_format(column, date_format)
    return column.cast("string")


def export_headers(spark: SparkSession, root: str | list[str], fmt: str = "csv") -> DataFrame:
    """file_path and header of every export below a folder."""
    return parquet_headers(spark, root) if fmt == "parquet" else csv_headers(spark, root)


def scan_order_export(
    spark: SparkSession,
    root: str | list[str],
    multi_line: bool = True,
    fmt: str = "csv",
    date_format: str | None = None,
    required: list[str] | None = None,
) -> DataFrame:
    """All exports below a folder, every column as string, plus `line_ord`.

    Columns are matched by name. CSV files are listed and read once, by position, whatever number of header
    versions there are: the table of headers, a row for each file, says which cell is which column. `multi_line` lets
    quoted cells hold line breaks, but then a file is not split over tasks. `date_format` is how the
    platform writes dates and times, for landed workbooks that keep them typed. Files that lack one of the
    `required` columns are left out; `quality.missing_columns` lists them.
    """
    if fmt != "parquet":
        return _scan_csv(spark, root, whole_files(csv_headers(spark, root), required), multi_line, required)
    raw = with_source(spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(*([root] if isinstance(root, str) else root)))
    if required:
        whole = whole_files(parquet_headers(spark, root), required).select(_plain_path(F.col("file_path")).alias("own_file"))
        raw = raw.join(F.broadcast(whole), _plain_path(F.col("line_ord.file")) == F.col("own_file"), "left_semi")
    kept = [_as_text(c, kind, date_format).alias(c) for c, kind in raw.dtypes if c != "line_ord"]
    return raw.select(*kept, "line_ord")


def with_numbered_order(raw: DataFrame, root: str | list[str]) -> DataFrame:
    """Scanned rows with `file_no`, which rises with the files' names, and with `line_ord` as one number in place of file, block and
    row, in the same order: aggregates by it can hash, and no row carries its file's name. The rows of a block are in one task."""
    files = list_files(raw.sparkSession, root).select(_plain_path(F.col("path")).alias("own_file")).distinct().orderBy("own_file")
    files = files.withColumn("file_no", F.monotonically_increasing_id())
    part = lambda c, unit: c.cast("decimal(20,0)") * F.lit(Decimal(unit))
    # Whole bytes for each, which shuffles compress.
    place = part(F.col("file_no"), 1 << 80) + part(F.col("line_ord.block"), 1 << 40) + F.col("line_ord.row").bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(20,0)")
    joined = raw.join(F.broadcast(files), _plain_path(F.col("line_ord.file")) == F.col("own_file"))
    return joined.select(*[F.col(f"`{c}`") for c in raw.columns if c != "line_ord"], "file_no", place.cast("decimal(38,0)").alias("line_ord"))


def union_exports(exports: list[DataFrame]) -> DataFrame:
    """Concatenate exports with columns aligned by name; absent ones are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), exports)
