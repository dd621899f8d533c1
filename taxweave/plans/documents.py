"""Fee documents landed as extracted fields, so that a document's text is read once.

A document is known by its source, month, id, name and place in the upload, and by a fingerprint of these and its text. A landing extracts only
the documents of its months that aren't there yet; documents handed in again are left out, and a document whose text has
changed is extracted anew and replaces its earlier state. Months are folders, and a month's documents are read alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxweave.operators import invoices, lines
from taxweave.session import settling
from taxweave.sinks.versions import Conflict, Versions

KEY = [*lines.SOURCE, *invoices.PERIOD, "doc_id"]


def land_documents(docs: DataFrame, path: str, tries: int = 5) -> int:
    """Land first pages (`documents.first_pages`). Returns how many documents were extracted."""
    spark, table = docs.sparkSession, Versions(docs.sparkSession, path)
    with settling(spark) as keep:
        marked = lines.with_prints(docs, [*KEY, "file_name", "upload_ord", "text"])
        months = [f"year={r.year}/month={r.month}" for r in docs.select(*invoices.PERIOD).distinct().collect()]  # a row for each month
        for attempt in range(tries):
            seen = table.state()
            there = table.read(seen, None, [u for u in seen.units if u.rsplit("/", 1)[0] in months])
            new = marked
            if there is not None:
                latest = _latest(there.select(*KEY, *lines.PRINTS, "landing"))
                new = marked.join(latest.select(*KEY, *lines.PRINTS), [*KEY, *lines.PRINTS], "left_anti")
            landing = seen.number + 1
            extracted = invoices.extract_invoice_fields(invoices.classify_invoice_docs(new.select(*marked.columns)))
            rows = keep(extracted.withColumn("landing", F.lit(landing)), "extracted")
            units = [f"year={r.year}/month={r.month}/landing={landing}" for r in rows.select(*invoices.PERIOD).distinct().collect()]
            if not units:
                return 0
            version, target = table.fresh()
            by = [*invoices.PERIOD, *KEY]
            rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy(*invoices.PERIOD, "landing").parquet(target)
            try:
                table.commit(seen, dict.fromkeys(units, version), alone=True)
                return rows.count()
            except Conflict:
                if attempt == tries - 1:
                    raise
    return 0


def _latest(rows: DataFrame) -> DataFrame:
    """Of each document the state that was landed last."""
    last = rows.groupBy(*KEY).agg(F.max("landing").alias("landing"))
    return rows.join(last, [*KEY, "landing"], "left_semi")


def read_documents(spark: SparkSession, path: str, year: int | None = None, month: int | None = None) -> DataFrame:
    """The extracted fields of landed documents, of all months or of one year or month."""
    table = Versions(spark, path)
    state = table.state()
    wanted = "" if year is None else f"year={year}/" if month is None else f"year={year}/month={month}/"
    rows = table.read(state, None, [u for u in state.units if u.startswith(wanted)])
    if rows is None:
        rows = table.read(state, None)
        if rows is None:
            raise FileNotFoundError(f"no documents landed in {path}")
        rows = rows.limit(0)
    return _latest(rows).drop(*lines.PRINTS, "landing")


def purchases(spark: SparkSession, path: str, year: int | None = None, month: int | None = None, strict: bool = False) -> DataFrame:
    """The input-tax ledger of landed documents."""
    return invoices.ledger_of_extracted(read_documents(spark, path, year, month), strict)
