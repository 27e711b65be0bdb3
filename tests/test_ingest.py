from __future__ import annotations

import json
from datetime import date
from pathlib import Path

import pytest

from tidemark.operators import normalize, validate
from tidemark.plans import ingest
from tidemark.schemas import EQUITY, INDEX, WEIGHTS, MissingColumns
from tidemark.sources import landed
from tidemark.sources.catalogs import INDUSTRIES
from tidemark.sources.days import read_days, write_days


def raw(spark, table, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in table.rename) for r in rows], table.raw_schema)


def bar(day, ticker="600000", exchange="XSHG", **more):
    return {"secID": f"{ticker}.{exchange}", "ticker": ticker, "exchangeCD": exchange, "tradeDate": day, "closePrice": "1.5", "dealAmount": "3.0", "isOpen": "1"} | more


def cal(spark, days):
    return spark.createDataFrame([(date.fromisoformat(d), 1) for d in days], "calendar_date date, is_open int")


DAYS = ["2024-01-02", "2024-01-03", "2024-01-04"]


def test_equity_rows(spark):
    rows = [bar("20240102"), bar("2024-01-02", "000001", "XNAS", closePrice="--"), bar(None)]
    got = {r["ticker"]: r for r in normalize.equity(raw(spark, EQUITY, rows)).collect()}
    assert got["600000"]["symbol"] == "600000.SH" and got["000001"]["symbol"] == "000001.XNAS"
    assert got["000001"]["close"] is None and got["600000"]["deal_count"] == 3
    assert normalize.equity(raw(spark, EQUITY, rows)).schema.simpleString() == EQUITY.schema.simpleString()


def test_missing_columns(spark):
    with pytest.raises(MissingColumns, match="closePrice"):
        normalize.equity(raw(spark, EQUITY, [bar("20240102")]).drop("closePrice"))


def test_equity_run_is_incremental(spark, tmp_path):
    root, source = f"{tmp_path}/equity", raw(spark, EQUITY, [bar(d, t) for d in DAYS[:2] for t in ("600001", "600000")])
    assert [d[:2] for d in ingest.run_equity(source, cal(spark, DAYS), root, "20240101", "20240131").days] == [(DAYS[0], 2), (DAYS[1], 2)]
    again = ingest.run_equity(source.union(raw(spark, EQUITY, [bar(DAYS[2])])), cal(spark, DAYS), root, "20240101", "20240131")
    assert [d[0] for d in again.days] == [DAYS[2]]  # a day without rows stayed missing; stored ones are skipped
    assert ingest.run_equity(source, cal(spark, DAYS), root, "20240101", "20240131").days == []
    stored = read_days(spark, root, EQUITY)
    assert stored.count() == 5 and {r["month"] for r in stored.select("month").collect()} == {"01"}


@pytest.mark.parametrize("change", [{"tradeDate": "bad"}, {"dealAmount": "1.5"}, {"isOpen": "300"}])
def test_equity_run_stops_before_writing(spark, tmp_path, change):
    with pytest.raises(validate.ValidationError):
        ingest.run_equity(raw(spark, EQUITY, [bar(DAYS[0]), bar(DAYS[0]) | change]), cal(spark, DAYS), f"{tmp_path}/e", "20240101", "20240131")
    assert not Path(f"{tmp_path}/e").exists()


def test_index_versions(spark, tmp_path):
    def row(day, ticker):
        return {"indexID": ticker, "ticker": ticker, "tradeDate": day, "closeIndex": "2"}

    rows = [row("2021-12-10", "801030"), row("2021-12-13", "801030"), row("2021-12-13", "000300"), row("2021-12-13", "999999")]
    report = ingest.run_index(raw(spark, INDEX, rows), cal(spark, ["2021-12-10", "2021-12-13"]), f"{tmp_path}/i", "20211201", "20211231")
    assert report.days == [("2021-12-10", 1, True), ("2021-12-13", 2, True)]
    got = {(str(r["trade_date"]), r["ticker"]): (r["index_family"], r["classification_version"], r["classification_name"]) for r in read_days(spark, f"{tmp_path}/i", INDEX).collect()}
    assert got["2021-12-10", "801030"] == ("sw_level1", "SW2014", "化工") and got["2021-12-13", "801030"][2] == "基础化工"
    assert got["2021-12-13", "000300"] == ("broad_market", "not_applicable", "沪深300")
    with pytest.raises(validate.ValidationError, match="801020"):
        ingest.run_index(raw(spark, INDEX, [row("2021-12-13", "801020")]), cal(spark, ["2021-12-13"]), f"{tmp_path}/j", "20211201", "20211231")


def snapshot(day, version="SW2021", weight="1.0"):
    return [{"secID": f"I{t}", "ticker": t, "consID": f"C{t}", "consTickerSymbol": t, "consExchangeCD": "XSHE", "effDate": day, "weight": weight} for t in INDUSTRIES[version]]


def run(spark, tmp_path, rows, start="20220101", end="20231231", **more):
    return ingest.run_weights(raw(spark, WEIGHTS, rows), f"{tmp_path}/w", start, end, **more)


def head(path):
    return json.loads(next(Path(path).glob("part-*")).read_text())


def test_weights_run(spark, tmp_path):
    rows = snapshot("2022-01-31") + snapshot("2023-01-31", weight="100")
    found = head(run(spark, tmp_path, rows))
    assert found["status"] == "success" and found["summary"]["files_written"] == 2 and found["summary"]["unique_index_tickers"] == 31
    assert found["quality"]["weight_scale_counts"] == {"percent": 31, "ratio": 31} and len(found["completed_windows"]) == 2
    again = head(run(spark, tmp_path, rows))
    assert again["summary"]["files_skipped"] == 2 and again["summary"]["files_written"] == 0
    assert head(run(spark, tmp_path, rows[:31], end="20221231", overwrite=True))["summary"]["files_written"] == 1
    assert read_days(spark, f"{tmp_path}/w", WEIGHTS).count() == 62


def broken(change, row=0):
    rows = snapshot("2022-01-31")
    rows[row] = rows[row] | change
    return rows


@pytest.mark.parametrize(("rows", "rule"), [
    ([], "empty_window"), (broken({"ticker": "801020"}), "unknown_ticker"), (broken({"effDate": "bad"}), "bad_date"), (broken({"effDate": None}), "bad_date"),
    (broken({"consID": None}), "null_key"), (broken({"weight": "abc"}), "bad_weight"), (broken({"weight": None}), "bad_weight"), (broken({"weight": "-0.1"}), "negative_weight"),
    (snapshot("2022-01-31") * 2, "duplicate_key"), (snapshot("2022-01-31")[1:], "incomplete_snapshot"), (broken({"weight": "inf"}), "bad_total"), (broken({"weight": "50"}), "bad_total"),
    (broken({"weight": "-1"}) + snapshot("2022-01-31"), "negative_weight"),
])
def test_weight_rules(spark, tmp_path, rows, rule):
    with pytest.raises(validate.ValidationError) as error:
        run(spark, tmp_path, rows, end="20220131")
    assert error.value.rule == rule


def test_failure_in_a_later_window(spark, tmp_path):
    rows = snapshot("2022-01-31") + snapshot("2023-01-31")[1:] + snapshot("2024-01-31")
    with pytest.raises(validate.ValidationError) as error:
        run(spark, tmp_path, rows, end="20241231")
    assert (error.value.rule, error.value.window) == ("incomplete_snapshot", 2)
    assert {str(r[0]) for r in read_days(spark, f"{tmp_path}/w", WEIGHTS).select("effective_date").collect()} == {"2022-01-31"}
    (path,) = Path(f"{tmp_path}/w/_manifests").iterdir()
    found = head(path)
    assert found["status"] == "failed" and found["failure"]["window"]["start_date"] == "20230101" and len(found["completed_windows"]) == 1


def test_window_of_no_month_end_may_be_empty(spark, tmp_path):
    assert head(run(spark, tmp_path, [], start="20220502", end="20220530"))["status"] == "success"


def test_a_landed_request_keeps_its_window(spark, tmp_path):
    from pyspark.sql import functions as F

    rows = raw(spark, WEIGHTS, snapshot("2024-01-31")).withColumn("window_id", F.lit(1))
    with pytest.raises(validate.ValidationError, match="outside_window"):
        ingest.run_weights(rows, f"{tmp_path}/w", "20220101", "20221231")


def test_requests_of_runs(spark, tmp_path):
    """Equity days in chunks of twenty; index runs cut at stored days, at the change of version and after twenty."""
    days = [date.fromordinal(date(2021, 11, 22).toordinal() + k).isoformat() for k in range(50)]
    report = ingest.run_equity(raw(spark, EQUITY, [bar(d) for d in days]), cal(spark, days), f"{tmp_path}/e", "20211101", "20220131")
    assert report.requests == [(days[0], days[19], 20), (days[20], days[39], 20), (days[40], days[49], 10)] and len(report.days) == 50
    index = raw(spark, INDEX, [{"indexID": "i", "ticker": "000300", "tradeDate": d.replace("-", ""), "closeIndex": "1"} for d in days])
    ingest.run_index(index, cal(spark, [days[4]]), f"{tmp_path}/i", "20211101", "20220131")
    report = ingest.run_index(index, cal(spark, days), f"{tmp_path}/i", "20211101", "20220131")
    assert report.requests == [(days[0], days[3], 4), (days[5], days[20], 16), (days[21], days[40], 20), (days[41], days[49], 9)] and len(report.days) == 49


def test_typed_dates_and_long_lists(spark, monkeypatch):
    """Dates and timestamps keep their day; many days are a range and a semi-join with the same rows."""
    from pyspark.sql import functions as F

    rows = raw(spark, EQUITY, [bar("2024-01-02"), bar("20240103"), bar("2024-01-05"), bar("bad"), bar(None)])
    spans = [(date(2024, 1, 2), date(2024, 1, 3)), (date(2024, 1, 9), date(2024, 1, 9))]
    for most in (200, 0):
        monkeypatch.setattr(landed, "MOST_LITERALS", most)
        assert sorted(str(r["tradeDate"]) for r in landed.of_days(rows, "tradeDate", spans).collect()) == ["2024-01-02", "20240103", "None", "bad"]
        for kind in ("date", "timestamp"):
            typed = rows.where("tradeDate like '2024-%'").withColumn("tradeDate", F.col("tradeDate").cast(kind))
            assert landed.of_days(typed, "tradeDate", spans).count() == 1
            assert {str(r["trade_date"]) for r in normalize.equity(typed).collect()} == {"2024-01-02", "2024-01-05"}
    assert landed.of_days(rows, "tradeDate", []).count() == 0


def test_rows_outside_of_the_run_are_counted(spark, tmp_path):
    found = head(run(spark, tmp_path, snapshot("2022-01-31") + snapshot("2024-01-31"), end="20221231"))
    assert found["summary"]["rows_outside"] == 31 and found["summary"]["rows_downloaded"] == 31


def test_a_large_day_is_dealt_to_files(spark, tmp_path):
    rows = normalize.equity(raw(spark, EQUITY, [bar(DAYS[0], f"{k:06}") for k in range(90)] + [bar(DAYS[1])]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # would put small parts together again
    try:
        write_days(rows, str(tmp_path / "d"), EQUITY, rows_per_file=30)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert 1 < len(list((tmp_path / "d").rglob(f"*{DAYS[0]}/run=*/*.parquet"))) <= 3 and len(list((tmp_path / "d").rglob(f"*{DAYS[1]}/run=*/*.parquet"))) == 1
    assert read_days(spark, str(tmp_path / "d"), EQUITY).count() == 91


def test_replacing_a_day_leaves_others(spark, tmp_path):
    rows = normalize.equity(raw(spark, EQUITY, [bar(d) for d in DAYS]))
    write_days(rows, str(tmp_path / "d"), EQUITY)
    write_days(rows.where("trade_date = '2024-01-03'").withColumn("close", rows["close"] + 1), str(tmp_path / "d"), EQUITY)
    assert sorted(r["close"] for r in read_days(spark, str(tmp_path / "d"), EQUITY).collect()) == [1.5, 1.5, 2.5]
    files = list((tmp_path / "d").rglob("*.parquet"))
    assert len(files) == 4 and all("zstd" in f.name for f in files)  # the snapshot before keeps its file of the replaced day


def test_scan_formats_and_empty_union(spark, tmp_path):
    rows = raw(spark, EQUITY, [bar("20240102", "000001")])
    rows.write.option("header", True).csv(str(tmp_path / "c"))
    rows.write.json(str(tmp_path / "j"))
    rows.write.parquet(str(tmp_path / "p"))
    for fmt, name in (("csv", "c"), ("parquet", "p")):
        got = landed.scan(spark, str(tmp_path / name), EQUITY, fmt, landed.on_days("tradeDate", ["20240102"])).collect()
        assert [r["ticker"] for r in got] == ["000001"]
    assert landed.scan(spark, str(tmp_path / "j"), EQUITY, "json", landed.in_range("tradeDate", "20240101", "20240103")).first()["ticker"] == "000001"
    assert landed.union([], spark, EQUITY).schema == EQUITY.schema and landed.union([], spark, EQUITY).count() == 0


def test_a_large_day_is_cut_at_quantiles_of_its_order(spark, tmp_path):
    """Files of a day don't overlap in its order, and a hot symbol is no obstacle."""
    from pyspark.sql import functions as F

    rows = normalize.equity(raw(spark, EQUITY, [bar(DAYS[0], f"{k % 40 and k:06}", closePrice=str(k)) for k in range(4000)]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        write_days(rows, str(tmp_path / "d"), EQUITY, rows_per_file=500)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = read_days(spark, str(tmp_path / "d"), EQUITY).groupBy(F.input_file_name()).agg(F.min("symbol").alias("a"), F.max("symbol").alias("b"), F.count("*").alias("n")).orderBy("a", "b").collect()
    assert len(files) > 5 and sum(f["n"] for f in files) == 4000 and max(f["n"] for f in files) < 1200
    assert all(x["b"] <= y["a"] for x, y in zip(files, files[1:], strict=False))


def test_a_run_reads_its_raw_scan_once(spark, tmp_path):
    """Rows that the raw scan hands out, counted where it is: no more than it has."""
    rows = raw(spark, EQUITY, [bar(d, f"{k:06}") for d in DAYS for k in range(50)] + [bar(None)])
    seen = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = rows.mapInArrow(tell, rows.schema)
    report = ingest.run_equity(counted, cal(spark, DAYS), f"{tmp_path}/e", "20240101", "20240131")
    assert (report.rows, report.null_date, len(report.days), seen.value) == (151, 1, 3, 151)
    index = raw(spark, INDEX, [{"indexID": "i", "ticker": "000300", "tradeDate": d, "closeIndex": "1"} for d in DAYS])
    seen.value = 0
    assert ingest.run_index(index.mapInArrow(tell, index.schema), cal(spark, DAYS), f"{tmp_path}/i", "20240101", "20240131").rows == 3 == seen.value
    weights = raw(spark, WEIGHTS, snapshot("2022-01-31"))
    seen.value = 0
    ingest.run_weights(weights.mapInArrow(tell, weights.schema), f"{tmp_path}/w", "20220101", "20220131")
    assert seen.value == 31


def test_readers_see_whole_snapshots(spark, tmp_path):
    """A run that dies after its files, before its log, changes nothing; a reader of the snapshot before keeps its files."""
    from tidemark.sources import snapshots

    root, rows = str(tmp_path / "d"), normalize.equity(raw(spark, EQUITY, [bar(d) for d in DAYS[:2]]))
    write_days(rows, root, EQUITY)
    before = read_days(spark, root, EQUITY)
    values = lambda df: sorted((str(r["trade_date"]), r["close"]) for r in df.collect())
    publish = snapshots.publish
    changed = normalize.equity(raw(spark, EQUITY, [bar(d, closePrice="9") for d in DAYS]))
    try:
        snapshots.publish = lambda *_: (_ for _ in ()).throw(RuntimeError("killed"))
        with pytest.raises(RuntimeError, match="killed"):
            write_days(changed, root, EQUITY)
    finally:
        snapshots.publish = publish
    assert values(read_days(spark, root, EQUITY)) == [(DAYS[0], 1.5), (DAYS[1], 1.5)]  # old days, none missing or double
    write_days(changed, root, EQUITY)
    assert values(read_days(spark, root, EQUITY)) == [(d, 9.0) for d in DAYS]
    assert values(before) == [(DAYS[0], 1.5), (DAYS[1], 1.5)]
    for price in ("3", "4"):
        write_days(changed.withColumn("close", changed["close"] * 0 + float(price)), root, EQUITY)
    assert values(read_days(spark, root, EQUITY)) == [(d, 4.0) for d in DAYS]
    assert len(list(Path(root).rglob("*.parquet"))) == 3 + 3 + 3  # of the dead run, of the two newest snapshots
    assert snapshots.sweep(spark, root) == 3 and len(list(Path(root).rglob("*.parquet"))) == 3 + 3
    assert values(read_days(spark, root, EQUITY)) == [(d, 4.0) for d in DAYS]
    assert len(list(Path(root, "_snapshots").glob("*.json"))) == 2


def test_two_runs_at_once(spark, tmp_path):
    """The second to publish fails, and nothing of it is visible."""
    from tidemark.sources import snapshots

    root = str(tmp_path / "d")
    start = snapshots.Snapshot()
    first = snapshots.publish(spark, root, start, "a", {("2024-01-02",): 1})
    with pytest.raises(snapshots.ConcurrentRun):
        snapshots.publish(spark, root, start, "b", {("2024-01-02",): 5})
    assert snapshots.current(spark, root) == first and first.tokens() == ["2024-01-02/a"]


def test_runs_by_exchange(spark, tmp_path):
    """Each exchange has its own calendar, missing days, requests and stored days."""
    days = [date.fromordinal(date(2024, 1, 1).toordinal() + k).isoformat() for k in range(30)]
    closed = {("XSHG", days[4]), ("XSHE", days[20])}
    calendar = spark.createDataFrame([(e, date.fromisoformat(d), int((e, d) not in closed)) for e in ("XSHG", "XSHE") for d in days], "exchange_cd string, calendar_date date, is_open int")
    rows = [bar(d, exchange=e) for e in ("XSHG", "XSHE", "XNAS") for d in days] + [bar(None), bar(days[0], exchange=None)]
    root = f"{tmp_path}/x"
    first = ingest.run_equity(raw(spark, EQUITY, [r for r in rows if r["exchangeCD"] == "XSHG"]), calendar, root, "20240101", "20240110", by_exchange=True)
    assert {d[1] for d in first.days} == {"XSHG"} and len(first.days) == 9 and first.null_date == 1
    assert first.requests == [("XSHE", days[0], days[9], 10), ("XSHG", days[0], days[9], 9)]
    second = ingest.run_equity(raw(spark, EQUITY, rows), calendar, root, "20240101", "20240130", by_exchange=True)
    assert second.requests == [("XSHE", days[0], days[19], 20), ("XSHE", days[21], days[29], 9), ("XSHG", days[10], days[29], 20)]
    assert len(second.days) == 29 + 20 and all(d[3] for d in second.days)
    stored = read_days(spark, root, ingest.EXCHANGES)
    assert {(r["part_exchange_cd"], r["n"]) for r in stored.groupBy("part_exchange_cd").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {("XSHG", 29), ("XSHE", 29)}
    assert ingest.run_equity(raw(spark, EQUITY, rows), calendar, root, "20240101", "20240130", by_exchange=True).days == []


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_a_backfill_opens_the_files_of_its_days(spark, tmp_path, fmt):
    days = [date.fromordinal(date(2024, 1, 1).toordinal() + k).isoformat() for k in range(12)]
    table = landed.Landed(spark, f"{tmp_path}/raw", EQUITY, fmt)
    assert table.scan([(date(2024, 1, 1), date(2024, 1, 2))]).count() == 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        table.append(raw(spark, EQUITY, [bar(d, f"{k:06}") for d in days[:8] for k in range(20)]), parts=8)
        table.append(raw(spark, EQUITY, [bar(d.replace("-", ""), "000001") for d in days[8:]]), parts=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = table.index().collect()
    assert sum(r["n_rows"] for r in index) == 164 and len(index) >= 6
    of = lambda a, b: {r["file"] for r in index if str(r["first_day"]) <= b and str(r["last_day"]) >= a}
    for a, b in ((days[2], days[2]), (days[7], days[9]), (days[10], days[11])):
        rows = table.scan([(date.fromisoformat(a), date.fromisoformat(b))])
        opened = {"/".join(f.split("/")[-2:]) for f in rows.inputFiles()}
        assert opened == of(a, b) and len(opened) < len(index) / 2
        assert {r["tradeDate"].replace("-", "") for r in rows.collect()} == {d.replace("-", "") for d in days if a <= d <= b}
    ingest.run_equity(table, cal(spark, [d for d in days if d != days[5]]), f"{tmp_path}/e", "20240101", "20240131")
    report = ingest.run_equity(table, cal(spark, days), f"{tmp_path}/e", "20240101", "20240131")
    assert report.days == [(days[5], 20, True)] and report.rows == 20
    table.append(raw(spark, EQUITY, [bar("bad")]))
    with pytest.raises(validate.ValidationError, match="bad_date"):  # its file is opened for any day
        ingest.run_equity(table, cal(spark, ["2024-02-01"]), f"{tmp_path}/e", "20240201", "20240201")


def test_windows_without_a_nested_loop(spark):
    """Rows find their window by binary search: no join with the windows."""
    from tidemark.operators import calendars

    plan = [r.asDict() for r in calendars.version_windows(spark, "20140305", "20230401").orderBy("window_id").collect()]
    days = ["2014-03-04", "2014-03-05", "20141231", "2015-01-01", "2021-12-12", "2021-12-13", "2023-04-01", "2023-04-02", None, "bad"]
    tagged = ingest._in_windows(raw(spark, WEIGHTS, [{"effDate": d} for d in days]), plan)
    got = [(r["effDate"], r["window_id"], r["version"]) for r in tagged.collect()]
    assert got == [
        ("2014-03-04", None, None), ("2014-03-05", 1, "SW2014"), ("20141231", 1, "SW2014"), ("2015-01-01", 2, "SW2014"), ("2021-12-12", 8, "SW2014"), ("2021-12-13", 9, "SW2021"),
        ("2023-04-01", 11, "SW2021"), ("2023-04-02", None, None), (None, 1, "SW2014"), ("bad", 1, "SW2014"),
    ]
    assert "Join" not in tagged._jdf.queryExecution().executedPlan().toString()


def test_quality_records_lie_beside_the_head(spark, tmp_path):
    from tidemark.sources.manifest import read_manifests, read_quality

    for _ in range(2):
        run(spark, tmp_path, snapshot("2022-01-31") + snapshot("2023-01-31", weight="100"))
    heads, rows = read_manifests(spark, f"{tmp_path}/w"), read_quality(spark, f"{tmp_path}/w")
    assert heads.count() == 2 and heads.select("run_path").distinct().count() == 2 and rows.count() == 124
    assert {(r["run_path"], r["scale"], r["n"]) for r in rows.groupBy("run_path", "scale").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()} == {(h["run_path"], s, 31) for h in heads.collect() for s in ("ratio", "percent")}


def test_gaps_by_bitmaps(spark):
    """Missing and extra names, also such as no version knows; nulls are no members."""
    draw = __import__("random").Random(2)
    names = [f"n{k:03}" for k in range(70)]
    expected = {"a": sorted(names[:50]), "b": sorted(names[20:])}
    rows = [(g, v, draw.choice([*expected[v], *expected[v], *names, "unknown1", "unknown2", None])) for g in range(12) for v in ("a", "b") for _ in range(400)]
    rows += [(99, "a", n) for n in expected["a"]]
    got = validate.snapshot_gaps(spark.createDataFrame(rows, "g int, version string, name string"), spark.createDataFrame(list(expected.items()), "version string, members array<string>"), ["g", "version"], "name")
    want = {}
    for g, v, n in rows:
        if n is not None:
            want.setdefault((g, v), set()).add(n)
    want = {k: (sorted(set(expected[k[1]]) - s), sorted(s - set(expected[k[1]]))) for k, s in want.items()}
    assert {(r["g"], r["version"]): (r["missing"], r["extra"]) for r in got.collect()} == {k: v for k, v in want.items() if v != ([], [])}
