"""Registered queries: each operator on the given tables, with the same in SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import coerce
from .functions.exact import exact_sums
from .operators import calendars, normalize, quality, validate
from .plans import ingest
from .schemas import EQUITY, INDEX, WEIGHTS, MissingColumns, Table, require
from .sources import landed
from .sources.catalogs import INDUSTRIES, MARKET, NEW, OLD, SECTOR, index_catalog
from .sources.days import read_days, stored_days, write_days
from .sources.folders import working_folder
from .sources.landed import on_days, union
from .sources.manifest import read_manifests

CUT = date(1998, 1, 1)
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
c = F.col


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, columns: tuple[str, ...], key: tuple[str, ...]) -> DataFrame:
    """The given columns of a table that is to be landed, dealt to partitions by their key, so that few given files become many.

    Rows move while they are narrow, and by a hash: dealt out in turn they would be sorted first."""
    return load(spark, sf_dir, name).select(*columns).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *key)


def order_days(spark: SparkSession, sf_dir: str, urgent: bool = False) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    if urgent:
        orders = orders.where("o_orderpriority = '1-URGENT'")
    return orders.select(c("o_orderdate").cast("date").alias("trade_date")).distinct()


def order_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from the first to the last order; open if it has one."""
    days = order_days(spark, sf_dir)
    every = days.agg(F.min("trade_date").alias("a"), F.max("trade_date").alias("b")).select(calendars.every_day(c("a"), c("b")).alias("calendar_date"))
    return every.join(days, c("calendar_date") == c("trade_date"), "left").select("calendar_date", c("trade_date").isNotNull().cast("int").alias("is_open"))


def open_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.open_days(order_calendar(spark, sf_dir), "1995-06-01", "2000-12-31")


def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.missing_days(order_days(spark, sf_dir), order_days(spark, sf_dir, urgent=True))


def chunk_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.chunk_days(order_days(spark, sf_dir))


def island_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.plan_backfill(order_days(spark, sf_dir), order_days(spark, sf_dir, urgent=True), cut=CUT)


def backfill_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calendars.backfill_ranges(island_batches(spark, sf_dir))


def exchange_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands and chunks by exchange: each order status is an exchange, open on the days of its orders; days of urgent ones are stored."""
    days = load(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')").select(c("o_orderstatus").alias("exchange_cd"), c("o_orderdate").cast("date").alias("trade_date"), (c("o_orderpriority") == "1-URGENT").alias("urgent"))
    of = ("exchange_cd",)
    return calendars.plan_backfill(days.select(*of, "trade_date").distinct(), days.where("urgent").select(*of, "trade_date").distinct(), cut=CUT, by=of)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = order_days(spark, sf_dir).agg(coerce.day_text(F.min("trade_date")), coerce.day_text(F.max("trade_date"))).first()
    return calendars.version_windows(spark, first, last, CUT)


def version_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = _windows(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").select(_window_id(windows, c("o_orderdate").cast("date")))
    counts = orders.where("window_id is not null").groupBy("window_id").agg(F.count("*").alias("n_rows"))
    return counts.join(F.broadcast(windows), "window_id").select("window_id", "version", "start_date", "end_date", "n_rows")


def _window_id(windows: DataFrame, day: Column) -> Column:
    """The window of a day, found by binary search in the few windows."""
    spans = [tuple(r) for r in windows.orderBy("window_id").select("start_date", "end_date").collect()]
    return (calendars.window_place(day, spans) + 1).alias("window_id")


def month_end_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with the last day of a month, their rows, and those of one status: none would be an error."""
    windows = _windows(spark, sf_dir)
    orders = load(spark, sf_dir, "orders").select(_window_id(windows, c("o_orderdate").cast("date")), (c("o_orderstatus") == "P").alias("pending"))
    counts = orders.groupBy("window_id").agg(F.count("*").alias("n"), F.count_if("pending").alias("p"))
    found = (F.coalesce("n", F.lit(0)).alias("n_rows"), F.coalesce("p", F.lit(0)).alias("n_pending"))
    return windows.join(counts, "window_id", "left").select("window_id", calendars.covers_month_end(c("start_date"), c("end_date")).alias("covers"), *found)


def symbol_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = F.broadcast(spark.createDataFrame([("AFRICA", "AF"), ("ASIA", "AS"), ("EUROPE", "EU")], "r_name string, suffix string"))
    places = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey")).join(suffixes, "r_name", "left")
    rows = load(spark, sf_dir, "supplier").join(F.broadcast(places), c("s_nationkey") == c("n_nationkey"), "left")
    return rows.select("s_suppkey", coerce.symbol(c("s_suppkey"), c("suffix"), c("s_name")).alias("symbol"))


def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = load(spark, sf_dir, "orders").select(F.substring("o_orderpriority", 1, 1).alias("text")).unionByName(load(spark, sf_dir, "part").select(c("p_type").alias("text")))
    texts = texts.unionByName(load(spark, sf_dir, "part").select(F.concat(F.lit(" "), c("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit("e1 ")).alias("text")))
    return texts.groupBy("text").agg(F.count("*").alias("n")).select("text", "n", coerce.number_or_null(c("text")).alias("value"))


def exact_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select(F.concat(c("l_quantity").cast("int").cast("string"), F.when(c("l_returnflag") == "R", ".5").otherwise(".0")).alias("text"))
    found = rows.groupBy("text").agg(F.count("*").alias("n"))
    return found.select("text", "n", coerce.exact_long(c("text")).alias("value"), coerce.exact_tiny(c("text")).cast("int").alias("tiny"), coerce.inexact_long(c("text")).alias("inexact"))


def date_parse_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = c("o_orderdate").cast("date")
    text = F.when(c("o_orderstatus") == "F", coerce.day_text(day)).when(c("o_orderstatus") == "O", day.cast("string")).otherwise(F.concat(F.lit("x"), day.cast("string")))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", text.alias("raw"))
    year, month = coerce.path_parts(coerce.date_or_null(c("raw")))
    return rows.select("o_orderkey", coerce.date_or_null(c("raw")).alias("day"), coerce.day_text(coerce.date_or_null(c("raw"))).alias("text"), year.alias("year"), month.alias("month"))


def strict_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight digits that are a real day: the 31st of the order's month often is not."""
    text = F.concat(F.date_format("o_orderdate", "yyyyMM"), F.lit("31"))
    rows = load(spark, sf_dir, "orders").select(text.alias("text"), c("o_orderdate").cast("date").cast("string").alias("dashed"))
    rules = {"good": coerce.compact_date(c("text")).isNotNull(), "bad": coerce.bad_date(c("text")), "dashed_compact": coerce.compact_date(c("dashed")).isNotNull()}
    return validate.rule_counts(rows, rules)


def drop_undated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a readable date go; day counts of the rest."""
    rows = date_parse_format(spark, sf_dir).where(c("day").isNotNull())
    return quality.rows_per_day(rows, "day")


def rename_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = Table("part", {"p_partkey": "sec_id", "p_name": "short_name", "p_retailprice": "close", "p_size": "volume"}, "short_name string, sec_id string, close double, volume double", "")
    return normalize.typed(normalize.project(load(spark, sf_dir, "part"), part), part).withColumn("version", F.lit(NEW))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-version catalog: regions 0 to 3 in the old, 1 to 4 in the new; two broad members in both."""
    nation, broad = load(spark, sf_dir, "nation"), ["CHINA", "JAPAN"]
    eras = [nation.where(f"n_regionkey between {a} and {b}").select(F.lit(v).alias("version"), c("n_name").alias("catalog_ticker"), F.concat(c("n_name"), F.lit(f" {v}")).alias("catalog_name"), F.lit(SECTOR).alias("family")) for v, a, b in ((OLD, 0, 3), (NEW, 1, 4))]
    both = union(eras, spark, INDEX).where(~c("catalog_ticker").isin(broad))
    whole = [nation.where(c("n_name").isin(broad)).select(F.lit(v).alias("version"), c("n_name").alias("catalog_ticker"), c("n_name").alias("catalog_name"), F.lit(MARKET).alias("family")) for v in (OLD, NEW)]
    return union([both, *whole], spark, INDEX)


def _traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name")
    orders = load(spark, sf_dir, "orders").select("o_custkey", calendars.version_of(c("o_orderdate").cast("date"), CUT).alias("version"))
    return orders.join(customers, c("o_custkey") == c("c_custkey")).groupBy("version", c("n_name").alias("ticker")).agg(F.count("*").alias("n"))


def classify_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.classified(_traded(spark, sf_dir), "ticker", "version", _nations(spark, sf_dir))
    return out.where(c("index_family").isNotNull())


def unknown_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _nations(spark, sf_dir).select("version", c("catalog_ticker").alias("ticker"))
    return validate.unknown_keys(_traded(spark, sf_dir), catalog, ["version", "ticker"])


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey")).alias("total"))
    return items.select("l_orderkey", (c("l_extendedprice") / c("total")).alias("weight"))


def weight_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = quality.weight_totals(_shares(spark, sf_dir), ("l_orderkey",))
    return totals.select("l_orderkey", F.round("weight_total", 6).alias("weight_total"), "scale")


def _quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.weight_totals(load(spark, sf_dir, "lineitem"), ("l_orderkey",), "l_quantity")


def exact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices summed by supplier, exactly, and rounded once: every bit of the total is fixed."""
    return exact_sums(load(spark, sf_dir, "lineitem"), ("l_suppkey",), "l_extendedprice", "total")


def scale_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scale_counts(_quantities(spark, sf_dir))


def bad_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.unrecognized(_quantities(spark, sf_dir)).select("l_orderkey", F.round("weight_total", 6).alias("weight_total"))


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.duplicate_keys(load(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"))


def snapshot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").join(F.broadcast(load(spark, sf_dir, "nation")), c("c_nationkey") == c("n_nationkey")).select("c_custkey", "n_name")
    rows = load(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("month")).join(customers, c("o_custkey") == c("c_custkey"))
    members = load(spark, sf_dir, "nation").where("n_regionkey < 4").agg(F.array_sort(F.collect_set("n_name")).alias("members"))
    gaps = validate.snapshot_gaps(rows, members, ["month"], "n_name")
    return gaps.select("month", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"))


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = c("l_shipdate").cast("date")
    rules = {
        "outside": ~day.between(F.lit("1995-01-01").cast("date"), F.lit("1999-12-31").cast("date")), "null_key": c("l_orderkey").isNull() | c("l_partkey").isNull(),
        "not_numeric": coerce.number_or_null(c("l_returnflag")).isNull(), "negative": c("l_extendedprice") < 0, "n_rows": F.lit(True),
    }
    return validate.rule_counts(load(spark, sf_dir, "lineitem"), rules)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "lineitem").select("l_suppkey", c("l_shipdate").cast("date").alias("day"))
    return quality.summary(rows, "l_suppkey", "day")


def union_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each priority, put together again."""
    orders = load(spark, sf_dir, "orders")
    batches = [orders.where(on_days("o_orderpriority", [p])).select("o_orderkey", F.lit(p).alias("batch")) for p in PRIORITIES]
    return union(batches, spark, EQUITY).groupBy("batch").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def days_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored by the first day of their month: one day wrong, all others, that day again; read back."""
    table = Table("orders", {}, "o_orderkey bigint, o_totalprice double, day date", "day", ("o_orderkey",))
    rows = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.trunc("o_orderdate", "month").alias("day"))
    root = working_folder(spark)
    first = rows.agg(F.min("day")).first()[0]
    write_days(rows.where(c("day") == F.lit(first)).withColumn("o_totalprice", F.lit(-1.0)), root, table)
    write_days(rows, root, table, "skip")
    write_days(rows.where(c("day") == F.lit(first)), root, table)
    return read_days(spark, root, table)


def stored_day_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days found in a stored table by its partitions alone."""
    table = Table("days", {}, "o_orderkey bigint, day date", "day", ("o_orderkey",))
    root = working_folder(spark)
    write_days(load(spark, sf_dir, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("day")), root, table)
    return stored_days(spark, root, table)


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What raw bars are made of, dealt for landing."""
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return dealt(spark, sf_dir, "lineitem", columns, ("l_orderkey", "l_linenumber"))


def _raw_equity(items: DataFrame) -> DataFrame:
    """Line items as raw bars, all text, with some unknown exchanges and unusable numbers."""
    money = lambda x: x.cast("decimal(18,2)").cast("string")
    exchange = F.when(c("l_returnflag") == "A", "XSHG").when(c("l_returnflag") == "N", "XSHE").otherwise("XNAS")
    price = money(c("l_extendedprice"))
    return items.select(
        F.concat(F.lit("S"), c("l_orderkey"), F.lit("-"), c("l_linenumber"), F.lit("-"), c("l_partkey")).alias("secID"), F.lpad(c("l_partkey").cast("string"), 6, "0").alias("ticker"),
        c("l_linestatus").alias("secShortName"), exchange.alias("exchangeCD"), c("l_shipdate").cast("date").cast("string").alias("tradeDate"),
        *(price.alias(x) for x in ("preClosePrice", "actPreClosePrice", "openPrice", "highestPrice", "lowestPrice")), F.when(c("l_tax") > 0.04, "--").otherwise(price).alias("closePrice"),
        money(c("l_quantity")).alias("turnoverVol"), price.alias("turnoverValue"), money(c("l_quantity")).alias("dealAmount"), money(c("l_discount")).alias("turnoverRate"),
        F.lit("1").alias("accumAdjFactor"), price.alias("negMarketValue"), price.alias("marketValue"), c("l_linenumber").cast("string").alias("isOpen"), F.lit("nan").alias("vwap"),
    )


def equity_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.equity(_raw_equity(load(spark, sf_dir, "lineitem")))
    return out.select("sec_id", "ticker", "symbol", "exchange_cd", "trade_date", "open", "close", "volume_hfq", "deal_count", c("is_open").cast("int").alias("is_open"), "vwap")


def equity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with planted faults: words for dates, halves for counts, 300 for flags."""
    raw = _raw_equity(load(spark, sf_dir, "lineitem"))
    raw = raw.withColumns({
        "tradeDate": F.when(c("turnoverRate") == "0.03", F.concat(F.lit("day "), "tradeDate")).when(c("turnoverRate") == "0.04", F.regexp_replace("tradeDate", "-", "")).otherwise(c("tradeDate")),
        "dealAmount": F.when(c("secShortName") == "O", F.concat(F.lit("1"), F.regexp_replace("dealAmount", "00$", "50"))).otherwise(c("dealAmount")),
        "isOpen": F.when(c("exchangeCD") == "XSHG", "300").otherwise(c("isOpen")),
    })
    rows, rules = validate.equity_rules(raw)
    return validate.rule_counts(rows, rules | {"bad_close": coerce.number_or_null(c("closePrice")).isNull(), "n_rows": F.lit(True)})


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw index bars: three catalog codes and one that only the old version has."""
    code = F.when(c("o_orderstatus") == "F", "801010").when(c("o_orderstatus") == "O", "000300").otherwise("801020")
    day = F.date_add(c("o_orderdate").cast("date"), 8400)
    price = c("o_totalprice").cast("decimal(18,2)").cast("string")
    raw = load(spark, sf_dir, "orders").select(
        c("o_orderkey").cast("string").alias("indexID"), code.alias("ticker"), c("o_orderpriority").alias("secShortName"), F.lit("XSHG").alias("exchangeCD"), coerce.day_text(day).alias("tradeDate"),
        *(price.alias(x) for x in ("preCloseIndex", "openIndex", "lowestIndex", "highestIndex", "closeIndex", "turnoverVol", "turnoverValue", "CHG", "CHGPct")),
    )
    return normalize.index(raw).select("index_id", "ticker", "trade_date", "index_family", "classification_version", "classification_name", "close")


def industry_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as constituents of one sector, weighed by quantity."""
    code = F.when(c("l_returnflag") == "A", "801030").when(c("l_returnflag") == "N", "801150").otherwise("801950")
    exchange = F.when(c("l_linestatus") == "O", "XBSE").otherwise("XNAS")
    day = F.date_add(c("l_shipdate").cast("date"), 8400)
    raw = load(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("I"), code).alias("secID"), code.alias("ticker"), F.lit("x").alias("secShortName"), c("l_orderkey").cast("string").alias("consID"), c("l_linestatus").alias("consShortName"),
        c("l_partkey").cast("string").alias("consTickerSymbol"), exchange.alias("consExchangeCD"), day.cast("string").alias("effDate"), c("l_quantity").cast("string").alias("weight"), calendars.version_of(day).alias("version"),
    )
    out = normalize.weights(raw).select(*WEIGHTS.schema.names)
    return out.groupBy("index_ticker", "classification_version", "classification_name", "constituent_symbol").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


def _land(spark: SparkSession, raw: DataFrame, fmt: str = "parquet") -> str:
    """The raw rows in a working folder, with a field that no pipeline knows."""
    path = working_folder(spark)
    writer = raw.withColumn("unknownField", F.lit("x")).write.format(fmt).option("header", True)
    (writer.option("compression", "zstd") if fmt == "parquet" else writer).save(path)
    return path


def equity_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed table of text bars, read with known fields only and a range of days next to the scan."""
    path = _land(spark, _raw_equity(_line_items(spark, sf_dir)))
    return landed.scan(spark, path, EQUITY, where=landed.in_range("tradeDate", "1997-01-01", "1998-12-31")).groupBy("exchangeCD", "tradeDate").agg(F.count("*").alias("n"), F.min("ticker").alias("first_ticker"))


def _raw_index(orders: DataFrame) -> DataFrame:
    code = F.when(c("o_orderstatus") == "F", "801010").when(c("o_orderstatus") == "O", "000300").otherwise("899999")
    price = c("o_totalprice").cast("decimal(18,2)").cast("string")
    return orders.select(
        c("o_orderkey").cast("string").alias("indexID"), code.alias("ticker"), c("o_orderpriority").alias("secShortName"), F.lit("XSHG").alias("exchangeCD"), coerce.day_text(F.date_add(c("o_orderdate").cast("date"), 8400)).alias("tradeDate"),
        *(price.alias(x) for x in ("preCloseIndex", "openIndex", "lowestIndex", "highestIndex", "closeIndex", "turnoverVol", "turnoverValue", "CHG", "CHGPct")),
    )


def index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index bars landed as CSV; only the catalog's tickers are kept."""
    orders = dealt(spark, sf_dir, "orders", ("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate"), ("o_orderkey",))
    rows = landed.scan(spark, _land(spark, _raw_index(orders), "csv"), INDEX, "csv")
    return landed.of_tickers(rows, index_catalog(spark)).select("indexID", "ticker", "tradeDate", "closeIndex")


def _raw_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every month of orders a full snapshot of its version: a third of each ticker's weight in three constituents."""
    months = load(spark, sf_dir, "orders").select(F.last_day(F.date_add(c("o_orderdate").cast("date"), 8400)).alias("day")).distinct()
    codes = index_catalog(spark, broad=False).select("version", "catalog_ticker")
    rows = months.withColumn("version", calendars.version_of(c("day"))).join(codes, "version").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    weight = F.when(c("k") == 3, 0.5).otherwise(0.25) * F.when(F.month("day") <= 6, 100).otherwise(1)
    return rows.select(
        F.concat(F.lit("I"), "catalog_ticker").alias("secID"), c("catalog_ticker").alias("ticker"), F.lit("x").alias("secShortName"), F.concat(F.lit("C"), "k").alias("consID"), F.lit("y").alias("consShortName"),
        F.concat(F.lit("00000"), "k").alias("consTickerSymbol"), F.lit("XSHE").alias("consExchangeCD"), c("day").cast("string").alias("effDate"), weight.cast("string").alias("weight"),
    )


def weights_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights landed as JSON, read as text; a filter on days and tickers."""
    rows = landed.scan(spark, _land(spark, _raw_weights(spark, sf_dir), "json"), WEIGHTS, "json", landed.in_range("effDate", "2020-01-01", "2022-12-31") & c("ticker").isin("801010", "801950"))
    return rows.groupBy("ticker", "effDate").agg(F.count("*").alias("n"), F.sum(coerce.number_or_null(c("weight"))).alias("weight"))


def landed_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A landed calendar in text: every day of the orders, open if it has one."""
    days = order_calendar(spark, sf_dir).select(coerce.day_text(c("calendar_date")).alias("calendarDate"), c("is_open").alias("isOpen"))
    return landed.calendar(spark, _land(spark, days))


def typed_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of a range without an open day stores nothing, and its table reads as the typed columns; so does no batch."""
    raw, days, root = _stored(spark, sf_dir)
    if ingest.run_equity(raw, days, root, "19000101", "19001231") != ingest.Report([], [], 0, 0):
        raise AssertionError("a day was found")
    whole = union([landed.empty(spark, EQUITY), read_days(spark, root, EQUITY).select(*EQUITY.schema.names)], spark, EQUITY)
    kinds = [(f.dataType.simpleString(), f.name) for f in whole.schema]
    counted = spark.createDataFrame(kinds, "kind string, name string").groupBy("kind").agg(F.count("*").alias("n_fields"))
    return counted.join(whole.agg(F.count("*").alias("n_rows")), F.lit(True)).select("kind", "n_fields", "n_rows")


def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that each given table lacks to be raw bars: what the error names."""
    wanted = Table("bars", {"o_orderkey": "sec_id", "o_orderdate": "trade_date", "closePrice": "close", "isOpen": "is_open"}, "sec_id string, trade_date date, close double, is_open tinyint", "trade_date")
    try:
        require(load(spark, sf_dir, "orders"), wanted)
    except MissingColumns as error:
        return load(spark, sf_dir, "orders").groupBy().agg(F.count("*").alias("n_rows")).withColumn("message", F.lit(str(error)))
    raise AssertionError("nothing is missing")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """Raw bars dealt for landing, a calendar of their days, and a folder to store them in."""
    raw = _raw_equity(_line_items(spark, sf_dir))
    days = _raw_equity(load(spark, sf_dir, "lineitem")).select(c("tradeDate").cast("date").alias("calendar_date")).distinct().withColumn("is_open", F.lit(1))
    return raw, days, working_folder(spark)


def equity_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of equity bars over a landed table: 1996 to 1997, then 1996 to 1998; days, rows and what the second wrote."""
    raw, days, root = _stored(spark, sf_dir)
    raw = landed.scan(spark, _land(spark, raw.withColumn("isOpen", F.lit("1"))), EQUITY)
    first = ingest.run_equity(raw, days, root, "19960101", "19971231")
    second = ingest.run_equity(raw, days, root, "19960101", "19981231")
    if ingest.run_equity(raw, days, root, "19960101", "19981231").days:
        raise AssertionError("a stored day was asked for again")
    runs = [(1, *d) for d in first.days] + [(2, *d) for d in second.days]
    reported = spark.createDataFrame(runs, "run int, day string, reported bigint, written boolean")
    stored = read_days(spark, root, EQUITY).groupBy("trade_date", "year", "month").agg(F.count("*").alias("n_rows"), F.round(F.sum("open"), 2).alias("total"))
    return stored.join(F.broadcast(reported), c("day") == c("trade_date").cast("string"), "left").select("trade_date", "year", "month", "n_rows", "total", "run", "reported")


def equity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one run reports of a landed table with undated rows: rows, undated rows, days and requests, all counted by the job that stages it."""
    raw, days, root = _stored(spark, sf_dir)
    raw = raw.withColumns({"isOpen": F.lit("1"), "tradeDate": F.when(c("turnoverRate") == "0.03", None).otherwise(c("tradeDate"))})
    report = ingest.run_equity(landed.scan(spark, _land(spark, raw), EQUITY), days, root, "19970101", "19970630")
    row = [(report.rows, report.null_date, len(report.days), sum(d[1] for d in report.days), len(report.requests))]
    return spark.createDataFrame(row, "n_rows bigint, null_date bigint, n_days bigint, stored bigint, n_requests bigint")


def exchange_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars stored by day and exchange: one exchange is stored up to February 1996, then both up to April; days of each run."""
    raw, days, root = _stored(spark, sf_dir)
    raw = landed.scan(spark, _land(spark, raw.withColumn("isOpen", F.lit("1"))), EQUITY)
    several = days.crossJoin(F.broadcast(spark.createDataFrame([("XSHG",), ("XSHE",)], "exchange_cd string")))  # a calendar for each of two exchanges
    first = ingest.run_equity(raw, several.where("exchange_cd = 'XSHG'"), root, "19960101", "19960229", by_exchange=True)
    second = ingest.run_equity(raw, several, root, "19960101", "19960430", by_exchange=True)
    reported = spark.createDataFrame([(1, *d) for d in first.days] + [(2, *d) for d in second.days], "run int, day string, exchange_cd string, reported bigint, written boolean")
    stored = read_days(spark, root, ingest.EXCHANGES).groupBy("trade_date", c("part_exchange_cd").alias("exchange_cd")).agg(F.count("*").alias("n_rows"))
    return stored.join(F.broadcast(reported.withColumn("trade_date", c("day").cast("date"))), ["trade_date", "exchange_cd"], "left").select("trade_date", "exchange_cd", "n_rows", "run", "reported")


def landed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars landed in two batches with an index of their files; a scan of three spans opens some of the files and finds all rows."""
    raw = _raw_equity(load(spark, sf_dir, "lineitem"))
    table = landed.Landed(spark, working_folder(spark), EQUITY)
    for batch in ("tradeDate < '1998-01-01'", "tradeDate >= '1998-01-01'"):
        table.append(raw.where(batch), parts=12)
    spans = [(date(1995, 3, 1), date(1995, 3, 31)), (date(1997, 12, 20), date(1998, 1, 10)), (date(2001, 1, 1), date(2001, 1, 1))]
    if len(table.files(spans)) > table.index().count() // 2:
        raise AssertionError("files without a day of the spans are opened")
    return table.scan(spans).groupBy("tradeDate").agg(F.count("*").alias("n"), F.min("secID").alias("first_id"))


def index_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticker that the day's version does not know stops a run of index bars; nothing is stored."""
    raw = _raw_index(load(spark, sf_dir, "orders")).withColumn("ticker", F.when(c("ticker") == "899999", "801020").otherwise(c("ticker")))
    every = raw.select(coerce.date_or_null(c("tradeDate")).alias("calendar_date")).distinct().withColumn("is_open", F.lit(1))
    root = working_folder(spark)
    try:
        ingest.run_index(raw, every, root, "20211101", "20220228")
    except validate.ValidationError as error:
        return read_days(spark, root, INDEX).agg(F.count("*").alias("n_stored")).withColumn("message", F.lit(str(error)))
    raise AssertionError("the ticker passed")


def index_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index bars: days of urgent orders are stored before; a run plans the rest over the change of version."""
    raw = _raw_index(load(spark, sf_dir, "orders")).where("ticker <> '899999'")
    day = coerce.date_or_null(c("tradeDate"))
    planned = raw.where(day.between("2020-01-01", "2023-12-31"))
    urgent = planned.where("secShortName = '1-URGENT'").select(day.alias("wanted")).distinct()
    every = raw.select(day.alias("calendar_date")).distinct().withColumn("is_open", F.lit(1))
    root = working_folder(spark)
    first = write_days(normalize.index(planned.join(F.broadcast(urgent), day == c("wanted"), "left_semi")), root, INDEX)
    second = ingest.run_index(raw, every, root, "20200101", "20231231").days
    runs = [(1, *d) for d in first] + [(2, *d) for d in second]
    reported = spark.createDataFrame(runs, "run int, day string, reported bigint, written boolean")
    stored = read_days(spark, root, INDEX).groupBy("trade_date", "classification_version").agg(F.count("*").alias("n_rows"))
    return stored.join(F.broadcast(reported), c("day") == c("trade_date").cast("string"), "left").select("trade_date", "classification_version", "n_rows", "run")


def _weights_manifests(spark: SparkSession, sf_dir: str) -> str:
    """The root of a table of weights after a run and its repetition."""
    raw, root = landed.scan(spark, _land(spark, _raw_weights(spark, sf_dir)), WEIGHTS), working_folder(spark)
    first, last = (x.replace("-", "") for x in raw.agg(F.min("effDate"), F.max("effDate")).first())
    for _ in range(2):
        ingest.run_weights(raw, root, first, last)
    return root


def weights_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industry weights of all months, validated window by window and stored by day; read back."""
    root = _weights_manifests(spark, sf_dir)
    stored = read_days(spark, root, WEIGHTS)
    return stored.groupBy("effective_date", "classification_version", "year", "month").agg(F.count("*").alias("n_rows"), F.count_distinct("index_ticker").alias("n_tickers"), F.round(F.sum("weight"), 6).alias("weight"), F.min("constituent_symbol").alias("first_symbol"))


def weights_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticker is absent from one snapshot of 2020: earlier windows stay stored, later ones are not written, the manifest says failed."""
    raw, root = landed.scan(spark, _land(spark, _raw_weights(spark, sf_dir).where("not (ticker = '801010' and effDate = '2020-05-31')")), WEIGHTS), working_folder(spark)
    first, last = (x.replace("-", "") for x in raw.agg(F.min("effDate"), F.max("effDate")).first())
    try:
        ingest.run_weights(raw, root, first, last)
    except validate.ValidationError as error:
        heads = read_manifests(spark, root).select("status", F.size("completed_windows").cast("long").alias("n_completed"), c("failure.window.start_date").alias("failed_from"), "summary.files_written", F.element_at("calls", -1)["error_type"].alias("rule"))
        stored = read_days(spark, root, WEIGHTS).agg(F.count("*").alias("n_rows"), F.max("effective_date").alias("last_day"))
        return heads.crossJoin(stored).withColumn("detail", F.lit(error.detail))  # one row each
    raise AssertionError("the gap passed")


def run_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a run and of its repetition: windows, files, totals by scale."""
    rows = read_manifests(spark, _weights_manifests(spark, sf_dir)).withColumn("run", F.row_number().over(Window.orderBy("created_at_utc")))
    counts = (F.coalesce(F.try_element_at("quality.weight_scale_counts", F.lit(s)), F.lit(0)).alias(s) for s in ("ratio", "percent", "unrecognized"))
    return rows.select("run", "status", F.size("completed_windows").cast("long").alias("n_windows"), "summary.rows_downloaded", "summary.files_written", "summary.files_skipped", "summary.unique_index_tickers", "summary.unique_effective_dates", *counts)


def _in_order(spark: SparkSession, sf_dir: str, table: Table, rows: DataFrame) -> DataFrame:
    """What each stored file looks like: rows by their place in it, and how many stand before a smaller one."""
    root = working_folder(spark)
    write_days(rows, root, table)
    name = F.substring_index(F.input_file_name(), "/", -1)  # of one folder a day; whole paths would be most of what the window holds
    stored = read_days(spark, root, table).withColumns({"file": name, "at": F.monotonically_increasing_id()})
    own = F.struct(*(x for k in table.order if k != table.date for x in (c(k).isNull(), c(k))))
    before = F.lag(own).over(Window.partitionBy(table.date, "file").orderBy("at"))
    placed = stored.select(c(table.date).alias("day"), "file", (before > own).alias("late"))
    return placed.groupBy("day").agg(F.count("*").alias("n_rows"), F.count_distinct("file").alias("n_files"), F.count_if("late").alias("n_late"))


def equity_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(spark, sf_dir, EQUITY, normalize.equity(_raw_equity(load(spark, sf_dir, "lineitem"))).withColumn("trade_date", F.trunc("trade_date", "month")))


def index_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_order(spark, sf_dir, INDEX, normalize.index(_raw_index(load(spark, sf_dir, "orders"))).withColumn("trade_date", F.trunc("trade_date", "month")))


def weights_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw_weights(spark, sf_dir)
    return _in_order(spark, sf_dir, WEIGHTS, normalize.weights(raw.withColumn("version", calendars.version_of(c("effDate").cast("date")))).select(*WEIGHTS.schema.names))


QUERIES = {f.__name__: f for f in (
    open_days, missing_days, chunk_days, island_batches, backfill_ranges, version_windows, month_end_cover, symbol_suffix, numeric_coerce, exact_int, date_parse_format,
    strict_dates, drop_undated, rename_project, classify_index, unknown_keys, weight_totals, scale_counts, bad_totals, duplicate_keys, snapshot_gaps, rule_counts, run_summary,
    union_batches, days_roundtrip, stored_day_list, equity_bars, equity_checks, index_bars, industry_weights, equity_scan, index_scan, weights_scan, landed_calendar, typed_empty,
    required_columns, equity_run, index_run, weights_run, run_manifest, equity_order, index_order, weights_order, exchange_batches, exact_totals, equity_report, exchange_run, landed_days,
    index_unknown, weights_failure,
)}

_DAYS = "days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), urgent AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority = '1-URGENT')"
_PLAN = _DAYS + """, places AS (SELECT d, row_number() OVER (ORDER BY d) AS p FROM days), gaps AS (
    SELECT d, p - row_number() OVER (ORDER BY d) AS g, CASE WHEN d >= DATE '1998-01-01' THEN 'SW2021' ELSE 'SW2014' END AS version FROM places WHERE d NOT IN (SELECT d FROM urgent)
), numbered AS (SELECT d, dense_rank() OVER (ORDER BY g) - 1 AS island, version FROM gaps
), plan AS (SELECT d AS trade_date, island::INT AS island, version, ((row_number() OVER (PARTITION BY island, version ORDER BY d) - 1) // 20)::INT AS chunk FROM numbered)"""
_WINDOWS = """span AS (SELECT min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders), eras AS (
    SELECT 'SW2014' AS version, a AS lo, least(b, DATE '1997-12-31') AS hi FROM span UNION ALL SELECT 'SW2021', greatest(a, DATE '1998-01-01'), b FROM span
), years AS (SELECT version, lo, hi, unnest(generate_series(year(lo), year(hi))) AS y FROM eras WHERE lo <= hi
), cut AS (SELECT version, greatest(lo, make_date(y, 1, 1)) AS start_date, least(hi, make_date(y, 12, 31)) AS end_date FROM years
), windows AS (SELECT row_number() OVER (ORDER BY start_date)::INT AS window_id, version, start_date, end_date FROM cut)"""
_NATIONS = """catalog AS (
    SELECT 'SW2014' AS version, n_name AS ticker, n_name || ' SW2014' AS name, 'sw_level1' AS family FROM nation WHERE n_regionkey BETWEEN 0 AND 3 AND n_name NOT IN ('CHINA', 'JAPAN')
    UNION ALL SELECT 'SW2021', n_name, n_name || ' SW2021', 'sw_level1' FROM nation WHERE n_regionkey BETWEEN 1 AND 4 AND n_name NOT IN ('CHINA', 'JAPAN')
    UNION ALL SELECT v, n_name, n_name, 'broad_market' FROM nation, (VALUES ('SW2014'), ('SW2021')) e(v) WHERE n_name IN ('CHINA', 'JAPAN')
), traded AS (SELECT CASE WHEN o_orderdate >= DATE '1998-01-01' THEN 'SW2021' ELSE 'SW2014' END AS version, n_name AS ticker, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
_PARSED = """texts AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y%m%d') WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'x' || strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders
), parsed AS (SELECT o_orderkey, coalesce(try_strptime(raw, '%Y-%m-%d'), CASE WHEN regexp_full_match(raw, '[0-9]{8}') THEN try_strptime(raw, '%Y%m%d') END)::DATE AS day FROM texts)"""
_CLASS = "CASE WHEN abs(t - CAST(1 AS DOUBLE)) <= CAST(0.01 AS DOUBLE) THEN 'ratio' WHEN abs(t - CAST(100 AS DOUBLE)) <= CAST(0.5 AS DOUBLE) THEN 'percent' ELSE 'unrecognized' END"
_QUANTITIES = f"sums AS (SELECT l_orderkey, sum(l_quantity) AS t FROM lineitem GROUP BY l_orderkey), classed AS (SELECT l_orderkey, t, {_CLASS} AS scale FROM sums)"

_CODES = "codes AS (" + " UNION ALL ".join(f"SELECT '{v}' AS version, unnest([{', '.join(repr(t) for t in known)}]) AS code" for v, known in INDUSTRIES.items()) + ")"
_SNAPSHOTS = f"""{_CODES}, months AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE) + 8400) AS day FROM orders), rows_ AS (
    SELECT day, code, m.version, k, CASE WHEN k = 3 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END * CASE WHEN month(day) <= 6 THEN 100 ELSE 1 END AS weight
    FROM (SELECT day, CASE WHEN day >= DATE '2021-12-13' THEN 'SW2021' ELSE 'SW2014' END AS version FROM months) m JOIN codes USING (version), range(1, 4) r(k))"""
_INDEX = "bars AS (SELECT o_orderkey::VARCHAR AS id, CASE o_orderstatus WHEN 'F' THEN '801010' WHEN 'O' THEN '000300' ELSE '899999' END AS code, CAST(o_orderdate AS DATE) + 8400 AS day, o_orderpriority AS priority, o_totalprice::DECIMAL(18,2) AS price FROM orders)"

ORACLE_SQL = {
    "open_days": f"WITH {_DAYS} SELECT d AS trade_date FROM days WHERE d BETWEEN DATE '1995-06-01' AND DATE '2000-12-31'",
    "missing_days": f"WITH {_DAYS} SELECT d AS trade_date FROM days WHERE d NOT IN (SELECT d FROM urgent)",
    "chunk_days": f"WITH {_DAYS} SELECT d AS trade_date, ((row_number() OVER (ORDER BY d) - 1) // 20)::INT AS chunk FROM days",
    "island_batches": f"WITH {_PLAN} SELECT trade_date, island, version, chunk FROM plan",
    "backfill_ranges": f"WITH {_PLAN} SELECT island, version, chunk, min(trade_date) AS start_date, max(trade_date) AS end_date, count(*) AS n_days FROM plan GROUP BY ALL",
    "version_windows": f"WITH {_WINDOWS} SELECT window_id, version, start_date, end_date, count(*) AS n_rows FROM windows JOIN orders ON CAST(o_orderdate AS DATE) BETWEEN start_date AND end_date GROUP BY ALL",
    "month_end_cover": f"WITH {_WINDOWS} SELECT window_id, last_day(start_date) <= end_date AS covers, (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN start_date AND end_date) AS n_rows, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P' AND CAST(o_orderdate AS DATE) BETWEEN start_date AND end_date) AS n_pending FROM windows",
    "symbol_suffix": """SELECT s_suppkey, coalesce(s_suppkey::VARCHAR || '.' || CASE r_name WHEN 'AFRICA' THEN 'AF' WHEN 'ASIA' THEN 'AS' WHEN 'EUROPE' THEN 'EU' END, s_name) AS symbol
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "numeric_coerce": """WITH texts AS (SELECT substr(o_orderpriority, 1, 1) AS text FROM orders UNION ALL SELECT p_type FROM part UNION ALL SELECT ' ' || CAST(p_retailprice AS DECIMAL(12,2))::VARCHAR || 'e1 ' FROM part)
        SELECT text, count(*) AS n, try_cast(text AS DOUBLE) AS value FROM texts GROUP BY text""",
    "exact_int": """WITH texts AS (SELECT l_quantity::INT::VARCHAR || CASE WHEN l_returnflag = 'R' THEN '.5' ELSE '.0' END AS text FROM lineitem), nums AS (SELECT text, count(*) AS n, text::DOUBLE AS v FROM texts GROUP BY text)
        SELECT text, n, CASE WHEN v = floor(v) THEN v::BIGINT END AS value, CASE WHEN v = floor(v) AND v BETWEEN -128 AND 127 THEN v::INT END AS tiny, v <> floor(v) AS inexact FROM nums""",
    "date_parse_format": f"WITH {_PARSED} SELECT o_orderkey, day, strftime(day, '%Y%m%d') AS text, strftime(day, '%Y') AS year, strftime(day, '%m') AS month FROM parsed",
    "strict_dates": """SELECT count(*) FILTER (try_strptime(strftime(o_orderdate, '%Y%m') || '31', '%Y%m%d') IS NOT NULL) AS good,
        count(*) FILTER (try_strptime(strftime(o_orderdate, '%Y%m') || '31', '%Y%m%d') IS NULL) AS bad, count(*) FILTER (regexp_full_match(strftime(o_orderdate, '%Y-%m-%d'), '[0-9]{8}')) AS dashed_compact FROM orders""",
    "drop_undated": f"WITH {_PARSED} SELECT day, count(*) AS n_rows FROM parsed WHERE day IS NOT NULL GROUP BY day",
    "rename_project": "SELECT p_name AS short_name, p_partkey::VARCHAR AS sec_id, p_retailprice AS close, p_size::DOUBLE AS volume, 'SW2021' AS version FROM part",
    "classify_index": f"""WITH {_NATIONS} SELECT t.version, t.ticker, t.n, c.family AS index_family, CASE WHEN c.family = 'broad_market' THEN 'not_applicable' ELSE t.version END AS classification_version, c.name AS classification_name
        FROM traded t JOIN catalog c ON t.version = c.version AND t.ticker = c.ticker""",
    "unknown_keys": f"WITH {_NATIONS} SELECT t.version, t.ticker FROM traded t ANTI JOIN catalog c ON t.version = c.version AND t.ticker = c.ticker",
    "weight_totals": f"""WITH shares AS (SELECT l_orderkey, l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey) AS w FROM lineitem), sums AS (SELECT l_orderkey, sum(w) AS t FROM shares GROUP BY l_orderkey)
        SELECT l_orderkey, round(t, 6) AS weight_total, {_CLASS} AS scale FROM sums""",
    "scale_counts": f"WITH {_QUANTITIES} SELECT scale, count(*) AS n FROM classed GROUP BY scale",
    "bad_totals": f"WITH {_QUANTITIES} SELECT l_orderkey, round(t, 6) AS weight_total FROM classed WHERE scale = 'unrecognized'",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "snapshot_gaps": """WITH found AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        ), months AS (SELECT DISTINCT month FROM found), wanted AS (SELECT month, n_name FROM months, nation WHERE n_regionkey < 4
        ), lacking AS (SELECT month, string_agg(n_name, ',' ORDER BY n_name) AS names FROM wanted w ANTI JOIN found f USING (month, n_name) GROUP BY month
        ), extra AS (SELECT month, string_agg(n_name, ',' ORDER BY n_name) AS names FROM found f ANTI JOIN wanted w USING (month, n_name) GROUP BY month)
        SELECT m.month, coalesce(l.names, '') AS missing, coalesce(e.names, '') AS extra FROM months m LEFT JOIN lacking l USING (month) LEFT JOIN extra e USING (month) WHERE l.names IS NOT NULL OR e.names IS NOT NULL""",
    "rule_counts": """SELECT count(*) FILTER (CAST(l_shipdate AS DATE) NOT BETWEEN DATE '1995-01-01' AND DATE '1999-12-31') AS outside, count(*) FILTER (l_orderkey IS NULL OR l_partkey IS NULL) AS null_key,
        count(*) FILTER (try_cast(l_returnflag AS DOUBLE) IS NULL) AS not_numeric, count(*) FILTER (l_extendedprice < 0) AS negative, count(*) AS n_rows FROM lineitem""",
    "run_summary": "SELECT count(*) AS n_rows, count(DISTINCT l_suppkey) AS n_tickers, count(DISTINCT CAST(l_shipdate AS DATE)) AS n_dates FROM lineitem",
    "union_batches": "SELECT o_orderpriority AS batch, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1",
    "days_roundtrip": "SELECT o_orderkey, o_totalprice, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, CAST(date_trunc('month', o_orderdate) AS DATE) AS day FROM orders",
    "stored_day_list": "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS trade_date FROM orders",
    "equity_bars": """SELECT 'S' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS sec_id, lpad(l_partkey::VARCHAR, 6, '0') AS ticker,
        CASE l_returnflag WHEN 'A' THEN lpad(l_partkey::VARCHAR, 6, '0') || '.SH' WHEN 'N' THEN lpad(l_partkey::VARCHAR, 6, '0') || '.SZ' ELSE 'S' || l_orderkey || '-' || l_linenumber || '-' || l_partkey END AS symbol,
        CASE l_returnflag WHEN 'A' THEN 'XSHG' WHEN 'N' THEN 'XSHE' ELSE 'XNAS' END AS exchange_cd, CAST(l_shipdate AS DATE) AS trade_date, l_extendedprice::DECIMAL(18,2)::DOUBLE AS open,
        CASE WHEN l_tax > 0.04 THEN NULL ELSE l_extendedprice::DECIMAL(18,2)::DOUBLE END AS close, l_quantity::DECIMAL(18,2)::DOUBLE AS volume_hfq, l_quantity::BIGINT AS deal_count, l_linenumber AS is_open, NULL::DOUBLE AS vwap FROM lineitem""",
    "equity_checks": "SELECT count(*) FILTER (round(l_discount, 2) = 0.03) AS bad_date, count(*) FILTER (l_linestatus = 'O') AS inexact_count, count(*) FILTER (l_returnflag = 'A') AS inexact_flag, count(*) FILTER (l_tax > 0.04) AS bad_close, count(*) AS n_rows FROM lineitem",
    "index_bars": """WITH raw AS (SELECT o_orderkey::VARCHAR AS index_id, CASE o_orderstatus WHEN 'F' THEN '801010' WHEN 'O' THEN '000300' ELSE '801020' END AS ticker, CAST(o_orderdate AS DATE) + 8400 AS trade_date, o_totalprice::DECIMAL(18,2)::DOUBLE AS close FROM orders
        ), eras AS (SELECT *, CASE WHEN trade_date >= DATE '2021-12-13' THEN 'SW2021' ELSE 'SW2014' END AS version FROM raw)
        SELECT index_id, ticker, trade_date, CASE WHEN ticker = '000300' THEN 'broad_market' WHEN ticker = '801020' AND version = 'SW2021' THEN NULL ELSE 'sw_level1' END AS index_family,
        CASE WHEN ticker = '000300' THEN 'not_applicable' WHEN ticker = '801020' AND version = 'SW2021' THEN NULL ELSE version END AS classification_version,
        CASE WHEN ticker = '000300' THEN '沪深300' WHEN ticker = '801010' THEN '农林牧渔' WHEN version = 'SW2014' THEN '采掘' END AS classification_name, close FROM eras""",
    "industry_weights": """WITH raw AS (SELECT CASE l_returnflag WHEN 'A' THEN '801030' WHEN 'N' THEN '801150' ELSE '801950' END AS index_ticker, CASE WHEN CAST(l_shipdate AS DATE) + 8400 >= DATE '2021-12-13' THEN 'SW2021' ELSE 'SW2014' END AS classification_version,
        CASE WHEN l_linestatus = 'O' THEN l_partkey::VARCHAR || '.BJ' ELSE l_orderkey::VARCHAR END AS constituent_symbol, l_quantity AS weight FROM lineitem)
        SELECT index_ticker, classification_version, CASE WHEN index_ticker = '801150' THEN '医药生物' WHEN index_ticker = '801030' AND classification_version = 'SW2021' THEN '基础化工' WHEN index_ticker = '801030' THEN '化工' WHEN classification_version = 'SW2021' THEN '煤炭' END AS classification_name,
        constituent_symbol, count(*) AS n, round(sum(weight), 4) AS weight FROM raw GROUP BY ALL""",
    "equity_scan": """SELECT CASE l_returnflag WHEN 'A' THEN 'XSHG' WHEN 'N' THEN 'XSHE' ELSE 'XNAS' END AS "exchangeCD", strftime(l_shipdate, '%Y-%m-%d') AS "tradeDate", count(*) AS n, min(lpad(l_partkey::VARCHAR, 6, '0')) AS first_ticker
        FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY ALL""",
    "index_scan": f"WITH {_INDEX} SELECT id AS \"indexID\", code AS ticker, strftime(day, '%Y%m%d') AS \"tradeDate\", price::VARCHAR AS \"closeIndex\" FROM bars WHERE code <> '899999'",
    "weights_scan": f"WITH {_SNAPSHOTS} SELECT code AS ticker, strftime(day, '%Y-%m-%d') AS \"effDate\", count(*) AS n, sum(weight) AS weight FROM rows_ WHERE day BETWEEN DATE '2020-01-01' AND DATE '2022-12-31' AND code IN ('801010', '801950') GROUP BY ALL",
    "landed_calendar": f"WITH {_DAYS}, every AS (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY))::DATE AS d FROM days) SELECT e.d AS calendar_date, (o.d IS NOT NULL)::INT AS is_open FROM every e LEFT JOIN days o ON e.d = o.d",
    "typed_empty": "SELECT kind, n_fields::BIGINT AS n_fields, (SELECT count(*) FROM lineitem WHERE false) AS n_rows FROM (VALUES ('string', 5), ('date', 1), ('double', 13), ('bigint', 1), ('tinyint', 1)) k(kind, n_fields)",
    "required_columns": "SELECT count(*) AS n_rows, 'bars: missing columns [''closePrice'', ''isOpen'']' AS message FROM orders",
    "equity_run": """SELECT CAST(l_shipdate AS DATE) AS trade_date, strftime(l_shipdate, '%Y') AS year, strftime(l_shipdate, '%m') AS month, count(*) AS n_rows, round(sum(l_extendedprice::DECIMAL(18,2)::DOUBLE), 2) AS total,
        CASE WHEN CAST(l_shipdate AS DATE) < DATE '1998-01-01' THEN 1 ELSE 2 END AS run, count(*) AS reported FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY ALL""",
    "index_run": f"""WITH {_INDEX}, planned AS (SELECT * FROM bars WHERE code <> '899999' AND day BETWEEN DATE '2020-01-01' AND DATE '2023-12-31'), urgent AS (SELECT DISTINCT day FROM planned WHERE priority = '1-URGENT')
        SELECT day AS trade_date, CASE WHEN code = '000300' THEN 'not_applicable' WHEN day >= DATE '2021-12-13' THEN 'SW2021' ELSE 'SW2014' END AS classification_version, count(*) AS n_rows, CASE WHEN day IN (SELECT day FROM urgent) THEN 1 ELSE 2 END AS run FROM planned GROUP BY ALL""",
    "weights_run": f"""WITH {_SNAPSHOTS} SELECT day AS effective_date, version AS classification_version, strftime(day, '%Y') AS year, strftime(day, '%m') AS month, count(*) AS n_rows, count(DISTINCT code) AS n_tickers, round(sum(weight), 6) AS weight, min('00000' || k || '.SZ') AS first_symbol
        FROM rows_ GROUP BY ALL""",
    "run_manifest": f"""WITH {_SNAPSHOTS}, eras AS (SELECT version, year(day) AS y FROM rows_ GROUP BY ALL), totals AS (SELECT day, code, sum(weight) AS t FROM rows_ GROUP BY ALL)
        SELECT run::INT AS run, 'success' AS status, (SELECT count(*) FROM eras) AS n_windows, (SELECT count(*) FROM rows_) AS rows_downloaded,
        CASE run WHEN 1 THEN (SELECT count(DISTINCT day) FROM rows_) ELSE 0 END AS files_written, CASE run WHEN 2 THEN (SELECT count(DISTINCT day) FROM rows_) ELSE 0 END AS files_skipped,
        (SELECT count(DISTINCT code) FROM rows_) AS unique_index_tickers, (SELECT count(DISTINCT day) FROM rows_) AS unique_effective_dates,
        (SELECT count(*) FROM totals WHERE abs(t - 1) <= 0.01) AS ratio, (SELECT count(*) FROM totals WHERE abs(t - 100) <= 0.5) AS percent, (SELECT count(*) FROM totals WHERE abs(t - 1) > 0.01 AND abs(t - 100) > 0.5) AS unrecognized FROM range(1, 3) r(run)""",
    "equity_order": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS day, count(*) AS n_rows, 1::BIGINT AS n_files, 0::BIGINT AS n_late FROM lineitem GROUP BY 1",
    "index_order": f"WITH {_INDEX} SELECT CAST(date_trunc('month', day) AS DATE) AS day, count(*) AS n_rows, 1::BIGINT AS n_files, 0::BIGINT AS n_late FROM bars GROUP BY 1",
    "weights_order": f"WITH {_SNAPSHOTS} SELECT day, count(*) AS n_rows, 1::BIGINT AS n_files, 0::BIGINT AS n_late FROM rows_ GROUP BY 1",
    "exchange_batches": """WITH days AS (SELECT DISTINCT o_orderstatus AS e, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus IN ('F', 'O')), urgent AS (SELECT DISTINCT o_orderstatus AS e, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority = '1-URGENT'
        ), places AS (SELECT e, d, row_number() OVER (PARTITION BY e ORDER BY d) AS p FROM days), gaps AS (
            SELECT e, d, p - row_number() OVER (PARTITION BY e ORDER BY d) AS g, CASE WHEN d >= DATE '1998-01-01' THEN 'SW2021' ELSE 'SW2014' END AS version FROM places ANTI JOIN urgent USING (e, d)
        ), numbered AS (SELECT e, d, dense_rank() OVER (PARTITION BY e ORDER BY g) - 1 AS island, version FROM gaps)
        SELECT e AS exchange_cd, d AS trade_date, island::INT AS island, version, ((row_number() OVER (PARTITION BY e, island, version ORDER BY d) - 1) // 20)::INT AS chunk FROM numbered""",
    "exact_totals": """WITH sums AS (SELECT l_suppkey, sum((l_extendedprice * 17592186044416)::HUGEINT) AS s FROM lineitem GROUP BY 1
        ), cut AS (SELECT l_suppkey, s, greatest(floor(log2(s::DOUBLE))::INT - 52, 0) AS k FROM sums), parts AS (SELECT l_suppkey, k, s // (1::HUGEINT << k) AS q, s % (1::HUGEINT << k) AS r, (1::HUGEINT << k) AS unit FROM cut)
        SELECT l_suppkey, (q + CASE WHEN 2 * r > unit OR (2 * r = unit AND q % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE * unit::DOUBLE / 17592186044416::DOUBLE AS total FROM parts""",
    "equity_report": """WITH rows_ AS (SELECT CAST(l_shipdate AS DATE) AS d, round(l_discount, 2) = 0.03 AS undated FROM lineitem), open_ AS (SELECT count(DISTINCT d) AS n FROM rows_ WHERE NOT undated AND d BETWEEN DATE '1997-01-01' AND DATE '1997-06-30')
        SELECT count(*) FILTER (undated OR d BETWEEN DATE '1997-01-01' AND DATE '1997-06-30') AS n_rows, count(*) FILTER (undated) AS null_date, (SELECT n FROM open_) AS n_days, count(*) FILTER (NOT undated AND d BETWEEN DATE '1997-01-01' AND DATE '1997-06-30') AS stored,
            (SELECT (count(DISTINCT d) + 19) // 20 FROM rows_ WHERE d BETWEEN DATE '1997-01-01' AND DATE '1997-06-30')::BIGINT AS n_requests FROM rows_""",
    "exchange_run": """SELECT CAST(l_shipdate AS DATE) AS trade_date, CASE l_returnflag WHEN 'A' THEN 'XSHG' ELSE 'XSHE' END AS exchange_cd, count(*) AS n_rows, CASE WHEN l_returnflag = 'A' AND CAST(l_shipdate AS DATE) <= DATE '1996-02-29' THEN 1 ELSE 2 END AS run, count(*) AS reported
        FROM lineitem WHERE l_returnflag IN ('A', 'N') AND CAST(l_shipdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-04-30' GROUP BY ALL""",
    "landed_days": """SELECT strftime(l_shipdate, '%Y-%m-%d') AS "tradeDate", count(*) AS n, min('S' || l_orderkey || '-' || l_linenumber || '-' || l_partkey) AS first_id FROM lineitem
        WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1995-03-01' AND DATE '1995-03-31' OR CAST(l_shipdate AS DATE) BETWEEN DATE '1997-12-20' AND DATE '1998-01-10' OR CAST(l_shipdate AS DATE) = DATE '2001-01-01' GROUP BY ALL""",
    "index_unknown": f"WITH {_INDEX} SELECT 0::BIGINT AS n_stored, 'unknown_ticker: ' || count(*) || ' rows of index_daily, e.g. 801020' AS message FROM bars WHERE code = '899999' AND day BETWEEN DATE '2021-12-13' AND DATE '2022-02-28'",
    "weights_failure": f"""WITH {_SNAPSHOTS}, eras AS (SELECT DISTINCT version, year(day) AS y FROM rows_ WHERE day < DATE '2020-01-01')
        SELECT 'failed' AS status, (SELECT count(*) FROM eras) AS n_completed, '20200101' AS failed_from, count(DISTINCT day) AS files_written, 'incomplete_snapshot' AS rule, count(*) AS n_rows, max(day) AS last_day, '2020-05-31 missing 801010 extra ' AS detail
        FROM rows_ WHERE day < DATE '2020-01-01'""",
}
