"""Checks and filters that compare the stores' selection with what was uploaded.

All are semi or anti joins on the source. Which side is broadcast is left to
Spark, which decides by measured size; a hot source on a large left side is
split by the adaptive skew join. Where rows of each period are joined, both sides are sorted: Spark measures a written table by its
compressed file, in which sources and periods repeat, and would send millions of rows through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxweave.operators.lines import SOURCE
from taxweave.rules import INPUT_KINDS


def missing_inputs(selection: DataFrame, manifest: DataFrame, kinds=INPUT_KINDS) -> DataFrame:
    """Selected (store, platform, kind) without an uploaded file."""
    wanted = selection.select(*SOURCE).withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    return wanted.distinct().join(manifest, [*SOURCE, "kind"], "left_anti")


def wanted_inputs(selection: DataFrame, periods: DataFrame, kinds=INPUT_KINDS) -> DataFrame:
    """Every upload that a run needs: of each selected source, each period of its taxpayer and each kind.

    `periods` has taxpayer_id and the columns of a period.
    """
    sources = selection.select(*SOURCE).distinct().join(periods.distinct().hint("merge"), "taxpayer_id")
    return sources.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))


def completeness(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Per taxpayer and period: how many uploads are wanted, how many of them are missing, and whether none is."""
    keys = wanted.columns
    period = [c for c in keys if c not in (*SOURCE, "kind")]
    there = manifest.select(*keys).distinct().withColumn("there", F.lit(True))
    state = wanted.join(there.hint("merge"), keys, "left").groupBy("taxpayer_id", *period)
    counted = state.agg(F.count("*").alias("wanted"), F.count_if(F.col("there").isNull()).alias("missing"))
    return counted.withColumn("complete", F.col("missing") == 0)


def lacking(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """The wanted uploads that the manifest doesn't have."""
    return wanted.join(manifest.select(*wanted.columns).distinct().hint("merge"), wanted.columns, "left_anti")


def drop_incomplete(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of taxpayers and periods that `completeness` finds no upload missing for."""
    keys = [c for c in state.columns if c not in ("wanted", "missing", "complete")]
    return rows.join(state.filter(~F.col("complete")).select(*keys).hint("merge"), keys, "left_anti").select(*rows.columns)


def prune_inputs(manifest: DataFrame, selection: DataFrame) -> DataFrame:
    """Drop uploads of platforms or stores that are no longer selected."""
    return manifest.join(selection, SOURCE, "left_semi")


def filter_selected_platforms(ledger: DataFrame, selection: DataFrame) -> DataFrame:
    """Keep ledger rows of selected (store, platform) pairs."""
    return ledger.join(selection, SOURCE, "left_semi")


def store_name_findings(selection: DataFrame) -> DataFrame:
    """Store names that are used twice, hold '_' or are empty.

    `selection` has one row per name as entered: taxpayer_id, store.
    """
    findings = F.array_compact(
        F.array(
            F.when(F.col("entries") > 1, F.lit("duplicate")),
            F.when(F.col("store").contains("_"), F.lit("underscore")),
            F.when(F.trim("store") == "", F.lit("empty")),
        )
    )
    return (
        selection.select("taxpayer_id", F.coalesce("store", F.lit("")).alias("store"))
        .groupBy("taxpayer_id", "store")
        .agg(F.count(F.lit(1)).alias("entries"))
        .select("taxpayer_id", "store", "entries", F.explode(findings).alias("finding"))
    )
