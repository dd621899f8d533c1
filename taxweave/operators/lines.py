"""Order lines: one schema for all platforms, filters, exact copies.

An order line has the columns

    taxpayer_id, store, platform   the source
    order_no, status, order_date, year, month, customer_name
    item_c, disc_c, ship_c         satang
    line_ord                       any orderable value; the upload's row order
    copies                         how many equal rows the upload held (after dedup_lines)
    print_a, print_b               128 bits that stand for all columns of the export's row
    extra                          the row only adds copies of one that was landed before
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxweave.functions import calendar, money
from taxweave.rules import RULES

SOURCE = ["taxpayer_id", "store", "platform"]
ROW_ORDER = "line_ord"
PRINTS = ["print_a", "print_b"]


def per_platform(value, otherwise: Column | None = None) -> Column:
    """`value(rule)` chosen by the row's platform."""
    chain = None
    for rule in RULES.values():
        hit = F.col("platform") == rule.name
        picked = value(rule)
        chain = F.when(hit, picked) if chain is None else chain.when(hit, picked)
    return chain if otherwise is None else chain.otherwise(otherwise)


def normalise_order_lines(raw: DataFrame, platform: str) -> DataFrame:
    """Bring one platform's export rows (all strings) to order lines.

    Rows whose time or money cannot be read keep NULL there; see
    `quality.unreadable_lines`. Columns the export lacks become NULL.
    """
    rule = RULES[platform]

    def text(name: str) -> Column:
        column = rule.columns.get(name)
        if column is None or column not in raw.columns:
            return F.lit(None).cast("string")
        return F.col(f"`{column}`")

    day = calendar.parse_day(F.trim(F.replace(text("ordered_at"), F.lit("\t"), F.lit(""))), rule.time_format)
    kept = [c for c in (ROW_ORDER, "copies", "file_no", *PRINTS) if c in raw.columns]
    return raw.select(
        "taxpayer_id",
        "store",
        F.lit(platform).alias("platform"),
        F.replace(text("order_no"), F.lit("\t"), F.lit("")).alias("order_no"),
        text("status").alias("status"),
        day.alias("order_date"),
        text("customer_name").alias("customer_name"),
        money.parse_money(text("item")).alias("item_c"),
        money.parse_money(text("discount")).alias("disc_c"),
        money.parse_money(text("shipping")).alias("ship_c"),
        *kept,
    ).withColumns({"year": F.year("order_date"), "month": F.month("order_date")})


def is_cancelled() -> Column:
    hit = per_platform(lambda rule: F.col("status").isin(*rule.cancelled))
    return F.coalesce(hit, F.lit(False))


def is_open() -> Column:
    """Not completed; an unknown status counts as open."""
    done = per_platform(lambda rule: F.col("status") == rule.done)
    return ~F.coalesce(done, F.lit(False))


def drop_cancelled(lines: DataFrame) -> DataFrame:
    """Drop cancelled lines. Lines without a status stay."""
    return lines.filter(~is_cancelled())


def drop_cancelled_export(raw: DataFrame, platform: str) -> DataFrame:
    """The same filter on rows that still have the export's columns."""
    rule = RULES[platform]
    hit = F.col(f"`{rule.columns['status']}`").isin(*rule.cancelled)
    return raw.filter(~F.coalesce(hit, F.lit(False)))


def filter_period(lines: DataFrame, year: int, month: int | None = None) -> DataFrame:
    return lines.filter(calendar.in_period(year, month))


def exclude_open_month(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """In the running year keep only days up to the last closed month; in
    January keep the days up to `as_of`. Other years are untouched."""
    last = calendar.last_counted_day(as_of)
    return lines.filter((F.col("year") != as_of.year) | (F.col("order_date") <= F.lit(last)))


def with_prints(rows: DataFrame, columns: list[str], platform: str = "") -> DataFrame:
    """Adds a fingerprint of the named columns, by which equal rows of different uploads are found.

    Two 64-bit hashes of the cells that aren't NULL, each with its column's name: an absent column and
    one of NULLs are the same, and cells don't take each other's place.
    """
    cell = lambda c: F.concat(F.lit(f"{c}\0"), F.col(f"`{c}`").cast("string"))
    cells = F.array_compact(F.array(F.lit(platform), *[cell(c) for c in sorted(columns)]))
    return rows.withColumns({"print_a": F.xxhash64(cells), "print_b": F.xxhash64(F.lit("second"), cells)})


def dedup_lines(lines: DataFrame) -> DataFrame:
    """One row per set of rows equal in all columns but the row order.

    NULL equals NULL. The first row's order is kept and `copies` says how many
    rows there were, so a job that must count the copies can still do so. The
    aggregate combines copies before the shuffle: a single row repeated over a
    third of the data leaves each map task as one row. Copies counted already are added up.
    """
    # Year and month follow from the day; they need not be compared or shuffled.
    derived = ["year", "month"] if "order_date" in lines.columns else []
    keys = [c for c in lines.columns if c not in (ROW_ORDER, "copies", "extra", *derived)]
    counted = F.sum("copies") if "copies" in lines.columns else F.count(F.lit(1))
    unique = lines.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.min(ROW_ORDER).alias(ROW_ORDER), counted.alias("copies"))
    if derived:
        unique = unique.withColumns({"year": F.year("order_date"), "month": F.month("order_date")})
    return unique


def dedup_uploads(lines: DataFrame, file: str = f"{ROW_ORDER}.file") -> DataFrame:
    """`dedup_lines` over files: copies count inside a file, and of several files the
    one with most of them counts, so an export uploaded twice is no more than once."""
    derived = ["year", "month"] if "order_date" in lines.columns else []
    keys = [F.col(f"`{c}`") for c in lines.columns if c not in (ROW_ORDER, file, *derived)]
    in_file = lines.groupBy(*keys, F.col(file).alias("upload_file")).agg(
        F.min(ROW_ORDER).alias(ROW_ORDER), F.count(F.lit(1)).alias("copies")
    )
    unique = in_file.groupBy(*keys).agg(F.min(ROW_ORDER).alias(ROW_ORDER), F.max("copies").alias("copies"))
    return unique.withColumns({"year": F.year("order_date"), "month": F.month("order_date")}) if derived else unique


def without_copies(lines: DataFrame) -> DataFrame:
    """`dedup_lines`, unless the lines are already free of copies."""
    return lines if "copies" in lines.columns else dedup_lines(lines)


def first_copies(lines: DataFrame) -> DataFrame:
    """Each line once, for jobs that never count copies."""
    unique = without_copies(lines)
    return unique.filter(~F.col("extra")) if "extra" in unique.columns else unique


def daily_weight(lines: DataFrame) -> Column:
    """Times a line counts in the daily job: copies count where the platform's
    export is not freed of duplicates there."""
    if "copies" not in lines.columns:
        return F.lit(1)
    once = F.when(F.col("extra"), 0).otherwise(1) if "extra" in lines.columns else F.lit(1)
    return per_platform(lambda rule: once.cast("long") if rule.dedup_daily else F.col("copies"))
