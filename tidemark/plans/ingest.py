"""The three ingest runs: equity bars, index bars, industry weights.

Each reads its raw scan once: the rows that were asked for are normalised and staged by one job,
which also observes all counts and broken rules. A broken rule discards the stage; else its days
are written, and a new snapshot of the table is published at the end."""

from __future__ import annotations

from contextlib import ExitStack
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import bad_date, compact_date, date_or_null
from ..operators import calendars, normalize, quality, validate
from ..schemas import EQUITY, INDEX, WEIGHTS, Table, require
from ..sources.catalogs import index_catalog
from ..sources.days import stored_days, write_days
from ..sources.landed import Landed, of_days, of_tickers
from ..sources.manifest import manifest, write_manifest
from ..sources.snapshots import folder_of
from .staging import Watch, staged


@dataclass(frozen=True)
class Report:
    """days: (day, rows, written) of each day, with the exchange after the day in a run by exchange;
    rows and null_date of the raw input that was asked for; requests: (first day, last day, days) of
    each chunk of missing days, with the exchange before them in a run by exchange."""

    days: list[tuple]
    requests: list[tuple]
    rows: int
    null_date: int


def _open_days(calendar: DataFrame, start: str, end: str) -> DataFrame:
    first, last = calendar.sparkSession.range(1).select(compact_date(F.lit(start)), compact_date(F.lit(end))).first()
    if first is None or last is None or first > last:
        raise ValueError(f"bad range {start} to {end}")
    return calendars.open_days(calendar, first, last)


def _requests(plan: DataFrame, *by: str, of: tuple[str, ...] = ()) -> list[tuple[date, date, int]]:
    """First day, last day and number of days of each chunk, in order."""
    chunks = plan.groupBy(*of, *by).agg(F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count("*").alias("n"))
    return sorted(tuple(r) for r in chunks.select(*of, "first", "last", "n").collect())  # a row for every twenty days at most


def _source(table: Table) -> str:
    return next(a for a, b in table.rename.items() if b == table.date)


def _asked(raw: DataFrame | Landed, table: Table, spans: list[tuple[date, date]]) -> DataFrame:
    """Rows of the spans and rows without a readable date; of a landed table with an index only the files that have any."""
    rows = raw.scan(spans) if isinstance(raw, Landed) else of_days(raw, _source(table), spans)
    require(rows, table)
    return rows


def _counts(raw: DataFrame) -> dict[str, Column]:
    return {"rows": F.count(F.lit(1)), "null_date": F.count_if(F.col("tradeDate").isNull())}


def run_equity(raw: DataFrame | Landed, calendar: DataFrame, root: str, start: str, end: str, by_exchange: bool = False) -> Report:
    """Stores the missing days of equity bars, asked for in chunks of twenty days.

    Bad dates, and integers that are none, stop the run before anything is visible.

    by_exchange: the calendar has exchange_cd, and a day is missing, asked for, stored and reported
    for each exchange by itself. Rows of an exchange that no calendar knows are not asked for."""
    spark = calendar.sparkSession
    table, of = (EXCHANGES, ("exchange_cd",)) if by_exchange else (EQUITY, ())
    missing = calendars.missing_days(_open_days(calendar, start, end), stored_days(spark, root, table), of).select(*of, "trade_date")
    days = [tuple(r) for r in missing.collect()]  # of a calendar
    if not days:
        return Report([], [], 0, 0)
    requests = _requests(calendars.chunk_days(spark.createDataFrame(days, missing.schema), by=of), "chunk", of=of)
    if by_exchange:
        spans = {e: [(d, d) for x, d in days if x == e] for e in sorted({x for x, _ in days})}
        part = _asked(raw, EQUITY, sorted({s for own in spans.values() for s in own}))
        day = date_or_null(F.col(_source(EQUITY)))
        wanted = spark.createDataFrame(days, missing.select(F.col("exchange_cd").alias("wanted"), F.col("trade_date").alias("on")).schema)
        dated = part.join(F.broadcast(wanted), (F.col("exchangeCD") == F.col("wanted")) & (day == F.col("on")), "left_semi")  # a row per exchange and day
        part = dated.unionByName(part.where(day.isNull() & F.col("exchangeCD").isin(list(spans))))
    else:
        part = _asked(raw, EQUITY, [(d, d) for (d,) in days])
    watch = Watch()
    rows, rules = validate.equity_rules(part)
    with staged(normalize.equity(watch.rows(rows, rules, **_counts(rows)))) as stage:
        found = watch.found()
        validate.judge(found, tuple(rules), EQUITY)
        return Report(write_days(stage, root, table), [_text(r) for r in requests], found["rows"], found["null_date"])


#: Equity bars stored by day and exchange.
EXCHANGES = Table(EQUITY.name, EQUITY.rename, EQUITY.columns, EQUITY.date, EQUITY.order, EQUITY.key, ("exchange_cd",))


def _text(request: tuple) -> tuple:
    return tuple(str(x) if isinstance(x, date) else x for x in request)


def run_index(raw: DataFrame | Landed, calendar: DataFrame, root: str, start: str, end: str) -> Report:
    """Stores the missing days of index bars: runs of missing days, cut at the change of the
    classification and after twenty days, are asked for from their first to their last day.

    Only catalog tickers are fetched; one unknown to the day's version stops the run."""
    spark = calendar.sparkSession
    plan = calendars.plan_backfill(_open_days(calendar, start, end), stored_days(spark, root, INDEX))
    requests = _requests(plan, "island", "version", "chunk")
    if not requests:
        return Report([], [], 0, 0)
    part = of_tickers(_asked(raw, INDEX, [(a, b) for a, b, _ in requests]), index_catalog(spark))
    watch, c = Watch(), F.col
    rows = watch.rows(part, {"bad_date": bad_date(c("tradeDate"))}, **_counts(part))
    unknown = c("index_family").isNull()
    processed = watch.rows(normalize.index(rows), {"unknown_ticker": unknown}, example=F.min(F.when(unknown, c("ticker"))))
    with staged(processed) as stage:
        found = watch.found()
        validate.judge(found, ("bad_date", "unknown_ticker"), INDEX)
        return Report(write_days(stage, root, INDEX), [_text(r) for r in requests], found["rows"], found["null_date"])


def _in_windows(raw: DataFrame, plan: list[dict]) -> DataFrame:
    """Raw rows with window_id (null outside of all windows), version, start_date and end_date.

    A row's window is found by its day, see `window_place`. Rows without a readable date go to the first."""
    if "window_id" in raw.columns:
        rows = raw.withColumn("window_id", F.when(F.col("window_id").isin([w["window_id"] for w in plan]), F.col("window_id").cast("int")))
    else:
        day = date_or_null(F.col("effDate"))
        rows = raw.withColumn("window_id", F.when(day.isNull(), F.lit(1)).otherwise(calendars.window_place(day, [(w["start_date"], w["end_date"]) for w in plan]) + 1))
    of = lambda name: F.get(F.array(*(F.lit(w[name]) for w in plan)), F.col("window_id") - 1)
    return rows.withColumns({n: of(n) for n in ("version", "start_date", "end_date")})


def run_weights(raw: DataFrame, root: str, start: str, end: str, overwrite: bool = False, source_api: str = "landed") -> str:
    """Validates and stores industry weights window by window; returns the manifest's path.

    Rows belong to the window of their date, or of their window_id column where raw has
    one (a landed request); rows without a readable date go to the first window, where
    they fail. Without window_id, rows dated outside the run were not asked for: they are
    counted in the manifest (rows_outside) and left alone. All windows are judged in a fixed number of jobs. On a failure the windows
    before it are written, the others are not, a failed manifest is tried, and the error
    is raised."""
    spark = raw.sparkSession
    windows = calendars.version_windows(spark, start, end)
    plan = [r.asDict() for r in windows.orderBy("window_id").collect()]
    windows = F.broadcast(spark.createDataFrame([tuple(w.values()) for w in plan], windows.schema))
    require(raw, WEIGHTS)
    asked = "window_id" in raw.columns
    watch, c = Watch(), F.col
    tagged = _in_windows(raw.select(*WEIGHTS.rename, *["window_id"] * asked), plan)
    tagged = watch.rows(tagged, {"rows_outside": c("window_id").isNull()}).where(c("window_id").isNotNull())
    known = index_catalog(spark, broad=False).select(c("version").alias("__v"), c("catalog_ticker"))
    tagged = tagged.join(known, (c("ticker").cast("string") == c("catalog_ticker")) & (c("version") == c("__v")), "left")
    tagged = tagged.withColumn("known", c("catalog_ticker").isNotNull()).withColumns(validate.weight_flags()).drop("catalog_ticker", "__v")
    with ExitStack() as stages:
        stage = stages.enter_context(staged(normalize.weights(tagged, "version", "window_id", *validate.ROW_RULES)))
        outside = 0 if asked else watch.found()["rows_outside"]
        every = stages.enter_context(staged(quality.weight_totals(stage, ("window_id", *quality.BY))))  # a row for each group, for the check and the manifest
        failure, counts = validate.check_weights(stage, windows, every)
        last = failure.window if failure else len(plan) + 1
        good = stage.where(c("window_id") < last).select(*WEIGHTS.schema.names)
        stored = write_days(good, root, WEIGHTS, "replace" if overwrite else "skip")
        span = lambda w: {"classification_version": w["version"], "start_date": f"{w['start_date']:%Y%m%d}", "end_date": f"{w['end_date']:%Y%m%d}"}
        tried = [w for w in plan if w["window_id"] <= last]
        broken = next((w for w in plan if failure and w["window_id"] == failure.window), None)
        sums = quality.summary(good, "index_ticker", "effective_date").first()
        files = [({"path": folder_of(root, (WEIGHTS.date,), (d,), "*").removesuffix("/run=*"), "effective_date": d, "rows": n}, new) for d, n, new in stored]
        head = {
            "status": "failed" if failure else "success",
            "source_api": source_api,
            "parameters": {"start_date": start, "end_date": end, "output_root": root, "overwrite": overwrite},
            "calls": [span(w) | {"tickers": [], "status": "failed" if w is broken else "success", "rows": counts[w["window_id"]], "error_type": failure.rule if w is broken else None} for w in tried],
            "completed_windows": [span(w) for w in tried if w is not broken],
            "files": {"written": [f for f, new in files if new], "skipped": [f for f, new in files if not new]},
            "summary": {
                "api_calls": len(tried), "rows_downloaded": sum(counts[w["window_id"]] for w in tried), "files_written": sum(new for _, new in files),
                "files_skipped": sum(not new for _, new in files), "unique_index_tickers": sums["n_tickers"], "unique_effective_dates": sums["n_dates"],
                "rows_outside": outside,
            },
            "failure": {"error_type": "ValidationError", "window": span(broken)} if broken else None,
        }
        totals = every.where(c("window_id") < last).drop("window_id")
        if not failure:
            return write_manifest(*manifest(spark, head, totals), root)
        error = validate.ValidationError(failure.rule, failure.window, failure.detail)
        try:
            write_manifest(*manifest(spark, head, totals), root)
        except Exception as second:  # the run's own error matters more
            error.add_note(f"the manifest could not be written: {second}")
        raise error
