"""Running totals that are carried from landing to landing.

The table has a row for each taxpayer and day with sales: the day's total and the running total of the year. It remembers the
landed state it was made from. An update compares that state's manifest with the newest one and reads only the months
of batches that have changed. Of them only the days that an old or new line of such a batch lies in are summed again; running
totals go on from the last day before the first such day of the year, so late lines and replaced or withdrawn uploads
are taken up too. Taxpayer ranges and years without a changed day are neither read nor written.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxweave.operators import daily, lines
from taxweave.rules import AMBER_SATANG, THRESHOLD_SATANG
from taxweave.session import settling
from taxweave.sinks.reports import taxpayer_range
from taxweave.sinks.versions import Conflict, State, Versions

LANDED = "landed"
#: Taxpayer ranges of a year, unless the first update says otherwise: a year has 366 rows a taxpayer at most.
RANGES = 8


def _schema(landed: DataFrame) -> T.StructType:
    fields = [T.StructField("taxpayer_id", landed.schema["taxpayer_id"].dataType), T.StructField("year", T.IntegerType()), T.StructField("date", T.DateType())]
    return T.StructType([*fields, T.StructField("sum_c", T.LongType()), T.StructField("cum_c", T.LongType())])


def _changed(table: Versions, before: State, now: State) -> tuple[DataFrame | None, set[str]]:
    """taxpayer_id, date of the lines of units that aren't what they were, and the months of these units."""
    units = {u for u in {**before.units, **now.units} if before.units.get(u) != now.units.get(u)}
    days = None
    for state in (before, now):
        rows = table.read(state, None, sorted(units))
        if rows is not None:
            some = rows.select("taxpayer_id", F.col("order_date").alias("date"))
            days = some if days is None else days.union(some)
    return days, {u.split("/", 1)[1] for u in units}


def update(spark: SparkSession, lines_path: str, path: str, ranges: int = RANGES, tries: int = 5) -> int:
    """Take up what has been landed since the last update. Returns the number of taxpayer-days summed."""
    landed, table = Versions(spark, lines_path), Versions(spark, path)
    for attempt in range(tries):
        seen, now = table.state(), landed.state()
        before = landed.state(int(seen.notes.get(LANDED, 0)))
        days, months = _changed(landed, before, now)
        if days is None:
            return 0
        ranges = int(seen.notes.get("ranges", ranges))
        with settling(spark) as keep:
            days = keep(days.filter("date is not null").distinct().withColumn("year", F.year("date")), "days")
            first = days.groupBy("taxpayer_id", "year").agg(F.min("date").alias("first"))
            near = [u for u in now.units if u.split("/", 1)[1] in months]
            counted = landed.read(now, None, near)
            if counted is None:  # all that was landed is withdrawn
                totals = spark.createDataFrame([], T.StructType([f for f in _schema(days).fields if f.name in ("taxpayer_id", "date", "sum_c")]))
            else:
                own = counted.filter("live = 1").join(days.select("taxpayer_id", F.col("date").alias("order_date")), ["taxpayer_id", "order_date"], "left_semi")
                totals = daily.row_total(daily.order_totals_by_day(lines.drop_cancelled(own)).withColumnRenamed("order_date", "date"))
            fresh = totals.withColumns({"year": F.year("date"), "cum_c": F.lit(None).cast("long")}).select(*_schema(days).names)
            place = taxpayer_range(ranges)
            units = [f"year={r.year}/range={r.range}" for r in days.select("year", place).distinct().collect()]
            old = table.read(seen, _schema(days), units)
            rows = fresh
            if old is not None:
                rows = old.join(days, ["taxpayer_id", "year", "date"], "left_anti").select(*fresh.columns).union(fresh)
            # At most 366 rows of a taxpayer's year: what lies before its first changed day keeps its running total.
            by_day = Window.partitionBy("taxpayer_id", "year").orderBy("date")
            kept = F.col("first").isNull() | (F.col("date") < F.col("first"))
            carried = F.max_by(F.when(kept, F.col("cum_c")), F.when(kept, F.col("date"))).over(Window.partitionBy("taxpayer_id", "year"))
            added = F.sum(F.when(~kept, F.col("sum_c")).otherwise(0)).over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            joined = rows.join(first, ["taxpayer_id", "year"], "left")
            running = joined.withColumn("cum_c", F.when(kept, F.col("cum_c")).otherwise(F.coalesce(carried, F.lit(0)) + added)).drop("first")
            running = keep(running.select(*fresh.columns, place), "running")
            version, target = table.fresh()
            order = ["year", "range", "taxpayer_id", "date"]
            running.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("year", "range").parquet(target)
            written = {f"year={r.year}/range={r.range}" for r in running.select("year", "range").distinct().collect()}
            try:
                table.commit(seen, {u: version if u in written else None for u in units}, {"ranges": str(ranges)}, alone=True, marks={LANDED: str(now.number)})
                return days.count()
            except Conflict:
                if attempt == tries - 1:
                    raise
    return 0


def running(spark: SparkSession, path: str) -> DataFrame:
    """taxpayer_id, year, date, sum_c, cum_c of the last update."""
    table = Versions(spark, path)
    rows = table.read(table.state(), None)
    if rows is None:
        raise FileNotFoundError(f"no balances in {path}")
    return rows.select("taxpayer_id", "date", "sum_c", F.col("year").cast("int").alias("year"), "cum_c")


def status(spark: SparkSession, path: str, limit: int = THRESHOLD_SATANG, amber: int = AMBER_SATANG) -> DataFrame:
    """The verdict of each taxpayer and year, from the carried totals."""
    return daily.threshold_status(running(spark, path), limit, amber)


def balances(spark: SparkSession, path: str) -> DataFrame:
    """Of each taxpayer and year the last day with sales and the running total on it."""
    return running(spark, path).groupBy("taxpayer_id", "year").agg(F.max("date").alias("last_day"), F.max_by("cum_c", "date").alias("balance_c"))
