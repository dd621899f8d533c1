"""Monthly VAT return for many taxpayers and months in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from taxweave.operators import inputs, invoices, ledger, lines, returns
from taxweave.session import settle, settling
from taxweave.sinks import reports


@dataclass(frozen=True)
class VatMonths:
    """Lazy results. `file_returns` computes each ledger once."""

    sales: DataFrame
    purchases: DataFrame
    summary: DataFrame


def sales_from_lines(order_lines: DataFrame, year: int | None = None, month: int | None = None) -> DataFrame:
    kept = lines.drop_cancelled(order_lines)
    if year is not None:
        kept = lines.filter_period(kept, year, month)
    return ledger.sales_ledger(ledger.order_totals(lines.first_copies(kept)))


def vat_months(
    order_lines: DataFrame,
    docs: DataFrame,
    selection: DataFrame | None = None,
    chosen_tax_ids: DataFrame | None = None,
    year: int | None = None,
    month: int | None = None,
    strict: bool = False,
) -> VatMonths:
    """Both ledgers and the five measures. Without year and month, all periods.

    The selection is applied to the ledgers, which are far smaller than order
    lines and page texts, so a large selection does not shuffle those.
    """
    sales = sales_from_lines(order_lines, year, month)
    handed_in = docs if year is None else lines.filter_period(docs, year, month)
    purchases = invoices.purchase_ledger(handed_in, strict)
    if selection is not None:
        sales = inputs.filter_selected_platforms(sales, selection)
        purchases = inputs.filter_selected_platforms(purchases, selection)
    if chosen_tax_ids is not None:
        purchases = invoices.select_tax_ids(purchases, chosen_tax_ids)
    return VatMonths(sales, purchases, returns.vat_return(sales, purchases))


def open_choices(purchases: DataFrame) -> DataFrame:
    """taxpayer_id, year, month and tax_ids of periods whose invoices name several tax ids."""
    return invoices.distinct_taxpayers(purchases).filter("needs_choice").drop("needs_choice")


def gated(months: VatMonths) -> VatMonths:
    """The months without periods where a tax id is still to be chosen (`open_choices`).

    The ledgers are far smaller than lines and texts; the purchases are written once, as both
    the choice and the returns need them.
    """
    purchases = settle(months.purchases, "purchases")
    waiting = open_choices(purchases)
    sales, fees = (side.join(waiting, ["taxpayer_id", "year", "month"], "left_anti") for side in (months.sales, purchases))
    sales, fees = sales.select(*months.sales.columns), fees.select(*purchases.columns)
    return VatMonths(sales, fees, returns.vat_return(sales, fees))


def complete_months(months: VatMonths, selection: DataFrame, manifest: DataFrame) -> tuple[VatMonths, DataFrame]:
    """The months of taxpayers who have handed in sales and fees of every selected store and platform, and the
    uploads that the others lack.

    `manifest` has the source, kind, year and month of each upload. The ledgers are written once, as their periods
    say what is wanted.
    """
    period = ["taxpayer_id", "year", "month"]
    sales, fees = settle(months.sales, "sales"), settle(months.purchases, "purchases")
    wanted = inputs.wanted_inputs(selection, sales.select(*period).union(fees.select(*period)))
    state = settle(inputs.completeness(wanted, manifest), "completeness")
    sales, fees = (inputs.drop_incomplete(side, state) for side in (sales, fees))
    missing = inputs.lacking(wanted, manifest)
    return VatMonths(sales, fees, returns.vat_return(sales, fees)), missing


def file_returns(months: VatMonths, path: str, refiled: DataFrame | None = None, choose: bool = False) -> DataFrame:
    """Write both ledgers and the receipt manifest below `path` and compute the
    returns from what was written, so lines and texts are read once.

    Filed are the taxpayers and months that either side has rows of, and those
    of `refiled` (taxpayer_id, year, month), whose earlier rows go even where nothing
    comes instead. Other taxpayers' and months' rows stay. With `choose`, periods whose tax id is still to be
    chosen (`open_choices`) aren't filed. Returns what was filed.
    """
    months = gated(months) if choose else months
    spark = months.sales.sparkSession
    unit = ["taxpayer_id", "year", "month"]
    with settling(spark) as keep:
        sales, fees = keep(months.sales, "sales"), keep(months.purchases, "purchases")
        run = sales.select(*unit).union(fees.select(*unit))
        run = settle((run if refiled is None else run.union(refiled.select(*unit))).distinct(), "filed")
        reports.write_tax_ledgers(sales, fees.select(*invoices.PURCHASES), path, run=run, written=True)
        reports.write_receipts(fees, f"{path}/receipts", run=run, written=True)
    written = [
        reports.read_written(spark, f"{path}/{side}", schema).join(run, unit, "left_semi")
        for side, schema in (("sales", months.sales.schema), ("purchases", fees.select(*invoices.PURCHASES).schema))
    ]
    return returns.vat_return(*written)
