import datetime as dt
import random
from pathlib import Path

import pytest

from taxweave.operators import inputs, ledger, lines, quality
from taxweave.plans import landing
from taxweave.rules import RULES
from taxweave.sinks import reports
from taxweave.sources import exports, manifest

TIKTOK = RULES["TikTok"]
HEADER = list(TIKTOK.columns.values())


def put(root: Path, name: str, header: list[str], rows: list[list[str]], bom: bool = False) -> None:
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    text = "\n".join(",".join(r) for r in [header, *rows]) + "\n"
    path.write_text(text, encoding="utf-8-sig" if bom else "utf-8")


def row(order, at, item, discount="THB 0", shipping="THB 0", status="Completed", who="x"):
    values = dict(order_no=order, status=status, ordered_at=at, item=item, discount=discount, shipping=shipping, customer_name=who)
    return [f'"{values[n]}"' for n in TIKTOK.columns]


def test_columns_are_matched_by_name(spark, tmp_path):
    at = "05/03/2024 10:00:00\t"
    put(tmp_path, "taxpayer_id=7/store=s1/m1.csv", HEADER, [row("001\t", at, "THB 1,000.00", who='say ""hi""')])
    other = [*reversed(HEADER), "Extra, quoted"]
    quoted = [f'"{h}"' for h in other]
    put(tmp_path, "taxpayer_id=7/store=s1/m 2.csv", quoted, [[*reversed(row("002\t", at, "THB 2.00")), "e"]], bom=True)
    raw = exports.scan_order_export(spark, str(tmp_path))
    assert "Extra, quoted" in raw.columns
    got = lines.normalise_order_lines(raw, "TikTok").orderBy("order_no").collect()
    assert [(r.taxpayer_id, r.store, r.order_no, r.item_c, r.order_date) for r in got] == [
        ("7", "s1", "001", 100000, dt.date(2024, 3, 5)),
        ("7", "s1", "002", 200, dt.date(2024, 3, 5)),
    ]
    assert got[0].customer_name == 'say "hi"'


def test_first_line_is_the_files_first(spark, tmp_path):
    at = "05/03/2024 10:00:00\t"
    rows = [row("1", at, "THB 1", shipping=f"THB {n}", status=s) for n, s in ((9, "z"), (1, "a"), (5, "m"))]
    put(tmp_path, "taxpayer_id=7/store=s1/b.csv", HEADER, [row("1", at, "THB 1", shipping="THB 4", status="later file")])
    put(tmp_path, "taxpayer_id=7/store=s1/a.csv", HEADER, rows + rows[:1])
    unique = lines.dedup_lines(lines.drop_cancelled_export(exports.scan_order_export(spark, str(tmp_path)), "TikTok"))
    order = ledger.order_totals(lines.normalise_order_lines(unique, "TikTok")).first()
    assert (order.status, order.service_c, order.goods_c) == ("z", 900, 400)


def test_parquet_export(spark, tmp_path):
    rule = RULES["Shopee"]
    names = [*rule.columns.values(), *rule.carried]
    frame = spark.createDataFrame([("1", "a", *["5"] * len(names))], "taxpayer_id string, store string, " + ", ".join(f"`{n}` string" for n in names))
    frame.write.parquet(str(tmp_path / "x"))
    raw = exports.scan_order_export(spark, str(tmp_path / "x"), fmt="parquet")
    frame.drop(rule.columns["item"]).write.mode("append").parquet(str(tmp_path / "x"))
    headers = exports.parquet_headers(spark, str(tmp_path / "x"))
    assert {r.missing for r in quality.missing_columns(headers, rule.required_columns()).collect()} == {rule.columns["item"]}
    assert set(names) <= set(raw.columns) and raw.select("line_ord.file").first()[0].endswith(".parquet")


def test_any_number_of_header_versions_is_one_scan(spark, tmp_path):
    at = "05/03/2024 10:00:00\t"
    pick = random.Random(4)
    for k in range(12):
        names = [*HEADER, f"more {k}", 'a, "b"'][: len(HEADER) + k % 3]
        cells = dict(zip(HEADER, row(f"{k:03d}\t", at, f"THB {k}.50"))) | {f"more {k}": f"m{k}", 'a, "b"': "q"}
        order = pick.sample(names, len(names))
        quoted = ['"' + n.replace('"', '""') + '"' if "," in n else n for n in order]
        put(tmp_path, f"taxpayer_id=7/store=s {k}/f+{k}.csv", quoted, [[cells[n] for n in order]] * (k % 2 + 1), bom=k % 4 == 0)
    raw = exports.scan_order_export(spark, str(tmp_path))
    assert raw._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    read = lines.normalise_order_lines(raw, "TikTok").collect()
    assert sorted((r.order_no, r.item_c, r.store, r.taxpayer_id) for r in read) == sorted((f"{k:03d}", k * 100 + 50, f"s {k}", "7") for k in range(12) for _ in range(k % 2 + 1))
    assert {r["a, \"b\""] for r in raw.collect()} == {"q", None} and {r["more 4"] for r in raw.collect()} == {"m4", None}


def test_short_rows_and_rows_of_quoted_lines(spark, tmp_path):
    put(tmp_path, "a.csv", ["x", "y", "z"], [["1", '"two\nlines"', "3"], ["4"], ["5", "6"]])
    put(tmp_path, "b.csv", ["z", "w"], [["7", "8"]])
    raw = exports.scan_order_export(spark, str(tmp_path))
    assert sorted(((r.w, r.x, r.y, r.z) for r in raw.collect()), key=repr) == sorted(
        [(None, "1", "two\nlines", "3"), (None, "4", None, None), (None, "5", "6", None), ("8", None, None, "7")], key=repr
    )


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_files_without_a_column_are_left_out(spark, tmp_path, fmt):
    rule = RULES["Lazada"]
    names = [*rule.columns.values(), *rule.carried]
    schema = "taxpayer_id string, store string, " + ", ".join(f"`{n}` string" for n in names)
    frame = spark.createDataFrame([("7", "a", *(["1"] * len(names)))], schema)
    good, bad, none = (str(tmp_path / n) for n in ("good", "bad", "none"))
    for path, dropped in ((good, []), (bad, []), (bad, [rule.columns["item"]]), (none, [rule.columns["item"]])):
        frame.drop(*dropped).coalesce(1).write.mode("append").option("header", "true").format(fmt).save(path)
    landed = {p: landing.lines_from_exports(spark, {"Lazada": p}, {"Lazada": fmt}).collect() for p in (good, bad, none)}
    assert [len(landed[p]) for p in (good, bad, none)] == [1, 1, 0] and landed[bad][0].item_c == 100
    found = landing.quarantined_exports(spark, {"Lazada": bad}, {"Lazada": fmt}).collect()
    assert [(r.platform, r.missing) for r in found] == [("Lazada", rule.columns["item"])] and "/bad/" in found[0].file_path


def test_missing_columns(spark, tmp_path):
    put(tmp_path, "store=a/full.csv", [*HEADER, "more"], [])
    short = [h for h in HEADER if h not in ("Order Status", "Created Time", "Buyer Username")]
    put(tmp_path, "store=a/short.csv", short, [["x"] * len(short)] * 3)
    for by_scan in (False, True):
        headers = exports.csv_headers(spark, str(tmp_path), by_scan=by_scan)
        found = quality.missing_columns(headers, TIKTOK.required_columns()).collect()
        assert {r.file_path.rsplit("/", 1)[1]: r.missing for r in found} == {"short.csv": "Created Time, Order Status"}


def test_manifest_and_inputs(spark, tmp_path):
    for kind, store, platform in [("sale", "a", "Shopee"), ("commission", "a", "Shopee"), ("sale", "b", "TikTok"), ("sale", "old", "Lazada")]:
        put(tmp_path, f"taxpayer_id=1/store={store}/platform={platform}/kind={kind}/f.csv", ["x"], [["1"]])
    files = manifest.scan_input_manifest(spark, str(tmp_path))
    assert files.count() == 4 and set(files.columns) >= {"kind", "platform", "store", "taxpayer_id", "file_name", "length"}
    selection = spark.createDataFrame([("1", "a", "Shopee"), ("1", "b", "TikTok"), ("1", "b", "Lazada")], "taxpayer_id string, store string, platform string")
    absent = {(r.store, r.platform, r.kind) for r in inputs.missing_inputs(selection, files).collect()}
    assert absent == {("b", "TikTok", "commission"), ("b", "Lazada", "sale"), ("b", "Lazada", "commission")}
    assert {r.store for r in inputs.prune_inputs(files, selection).collect()} == {"a", "b"}


def test_gates(spark):
    source = "taxpayer_id long, store string, platform string"
    selection = spark.createDataFrame([(1, "a", "Shopee"), (1, "a", "Shopee"), (1, "b", "Lazada"), (2, "a", "Shopee")], source)
    uploads = [(1, "a", "Shopee", "sale", 1), (1, "a", "Shopee", "commission", 1), (1, "b", "Lazada", "sale", 1), (1, "b", "Lazada", "commission", 1)]
    uploads += [(1, "a", "Shopee", "sale", 2), (2, "a", "Shopee", "sale", 1), (2, "a", "Shopee", "sale", 1), (2, "a", "TikTok", "commission", 1)]
    files = spark.createDataFrame([(*u[:4], 2024, u[4]) for u in uploads], source + ", kind string, year int, month int")
    periods = spark.createDataFrame([(1, 2024, 1), (1, 2024, 2), (2, 2024, 1), (3, 2024, 1)], "taxpayer_id long, year int, month int")
    state = inputs.completeness(inputs.wanted_inputs(selection, periods), files)
    assert sorted((r.taxpayer_id, r.month, r.wanted, r.missing, r.complete) for r in state.collect()) == [(1, 1, 4, 0, True), (1, 2, 4, 3, False), (2, 1, 2, 1, False)]
    # Taxpayers without a selection want nothing, so nothing of theirs is held back.
    assert sorted((r.taxpayer_id, r.month) for r in inputs.drop_incomplete(periods, state).collect()) == [(1, 1), (3, 1)]


def test_an_audit_run_is_recorded_once(spark, tmp_path):
    amounts = spark.createDataFrame([(1, "a", 5), (1, "b", 6), (2, "a", 7)], "taxpayer_id long, store string, amount_c long")
    run = lambda at: reports.run_audit(amounts, "vat", "2024-03", dt.datetime(2024, 4, at), "person")
    path = str(tmp_path / "audit")
    done = [reports.append_run_audit(run(1), path), reports.append_run_audit(run(1), path), reports.append_run_audit(run(2), path)]
    done += [reports.append_run_audit(run(3), path, "r"), reports.append_run_audit(run(4), path, "r"), reports.append_run_audit(run(5).limit(0), path)]
    assert done == [True, False, True, True, False, False]
    read = reports.read_written(spark, path, run(1).schema).collect()
    assert sorted((r.run_at[:10], r.taxpayer_id, r.stores, r.total_c) for r in read) == [(f"2024-04-0{d}", *x) for d in (1, 2, 3) for x in ((1, "a, b", 11), (2, "a", 7))]


def test_store_names(spark):
    names = spark.createDataFrame([(1, "a"), (1, "a"), (1, "x_y"), (1, " "), (1, None), (2, "a")], "taxpayer_id long, store string")
    found = {(r.taxpayer_id, r.store, r.finding) for r in inputs.store_name_findings(names).collect()}
    assert found == {(1, "a", "duplicate"), (1, "x_y", "underscore"), (1, " ", "empty"), (1, "", "empty")}


def test_rewriting_one_year_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "daily")
    schema = "taxpayer_id long, date date, year int, sum_c long"
    first = [(1, dt.date(2023, 1, 1), 2023, 1), (1, dt.date(2024, 1, 1), 2024, 2)]
    reports.write_daily_sales(spark.createDataFrame(first, schema), path)
    reports.write_daily_sales(spark.createDataFrame([(1, dt.date(2024, 1, 1), 2024, 9)], schema), path)
    live = reports.read_written(spark, path, spark.createDataFrame([], schema).schema)
    assert sorted((r.year, r.sum_c) for r in live.collect()) == [(2023, 1), (2024, 9)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_ledgers_in_both_formats(spark, tmp_path, fmt):
    sales = spark.createDataFrame([(1, "a", "Shopee", 2024, 3, dt.date(2024, 3, 1), "1")], "taxpayer_id long, store string, platform string, year int, month int, order_date date, order_no string")
    fees = spark.createDataFrame([(1, "a", "Shopee", 2024, 3, dt.date(2024, 3, 1), "n")], "taxpayer_id long, store string, platform string, year int, month int, doc_date date, doc_num string")
    reports.write_tax_ledgers(sales, fees, str(tmp_path / fmt), fmt)
    assert len(list((tmp_path / fmt / "sales").glob("version=*/year=2024/month=3/range=*"))) == 1
    assert [tuple(r) for r in reports.read_written(spark, str(tmp_path / fmt / "purchases"), fees.schema, fmt).collect()] == [tuple(fees.first())]
