"""Raw rows to processed rows: projection, coercion, lookups, column order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from ..schemas import EQUITY, INDEX, WEIGHTS, Table, require, unused
from ..sources.catalogs import MARKET, NO_VERSION, exchange_suffixes, index_catalog
from .calendars import version_of


def project(raw: DataFrame, table: Table, *extra: str) -> DataFrame:
    """Only the known fields, renamed; an absent one is an error before any job."""
    require(raw, table)
    return raw.select(*(F.col(a).alias(b) for a, b in table.rename.items()), *extra)


def typed(df: DataFrame, table: Table, *extra: str) -> DataFrame:
    """The processed columns in order, each coerced to its type; bad dates and numbers become null."""
    simple = {"double": coerce.number_or_null, "date": coerce.date_or_null}
    exact = {"bigint": coerce.exact_long, "tinyint": coerce.exact_tiny}
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}
    names = {c: unused(f"number of {c}", df.columns) for c, kind in kinds.items() if kind in exact}
    df = df.withColumns({name: coerce.number_or_null(F.col(c)) for c, name in names.items()})  # parsed once, used often
    value = lambda c, kind: exact[kind](F.col(c), F.col(names[c])) if kind in exact else simple.get(kind, lambda x: x.cast("string"))(F.col(c))
    return df.select(*(value(c, kind).alias(c) for c, kind in kinds.items()), *extra)


def with_symbol(df: DataFrame, ticker: str, exchange: str, sec_id: str, out: str) -> DataFrame:
    """Exchange-suffixed symbol by a broadcast lookup; an unknown or null exchange, or a null ticker, falls back to sec_id."""
    code, suffix = unused("code", df.columns), unused("suffix", df.columns)
    known = F.broadcast(exchange_suffixes(df.sparkSession).withColumnsRenamed({"exchange_cd": code, "suffix": suffix}))
    joined = df.join(known, F.col(exchange) == F.col(code), "left")
    return joined.withColumn(out, coerce.symbol(F.col(ticker), F.col(suffix), F.col(sec_id))).drop(code, suffix)


def dated(df: DataFrame, table: Table) -> DataFrame:
    """Rows with a date; the others belong to no day."""
    return df.where(F.col(table.date).isNotNull())


def equity(raw: DataFrame) -> DataFrame:
    df = with_symbol(project(raw, EQUITY), "ticker", "exchange_cd", "sec_id", "symbol")
    return dated(typed(df, EQUITY), EQUITY)


def classified(df: DataFrame, ticker: str, version: str, catalog: DataFrame | None = None) -> DataFrame:
    """Adds index_family, classification_version and classification_name, by default from the index catalog. Broad indexes go first and have no version; family is null for unknown tickers."""
    known = index_catalog(df.sparkSession) if catalog is None else F.broadcast(catalog)
    known = known.withColumnRenamed("version", "__v")
    joined = df.join(known, (F.col(ticker).cast("string") == F.col("catalog_ticker")) & (F.col(version) == F.col("__v")), "left")
    label = F.when(F.col("family") == MARKET, NO_VERSION).when(F.col("family").isNotNull(), F.col(version))
    return joined.select(*df.columns, F.col("family").alias("index_family"), label.alias("classification_version"), F.col("catalog_name").alias("classification_name"))


def index(raw: DataFrame) -> DataFrame:
    """Rows of unknown tickers keep a null family; validation counts them before a write."""
    df = project(raw, INDEX).withColumn("__version", version_of(coerce.date_or_null(F.col("trade_date"))))
    return dated(typed(classified(df, "ticker", "__version").drop("__version"), INDEX), INDEX)


def weights(raw: DataFrame, version: str = "version", *extra: str) -> DataFrame:
    """Industry weights of one or many windows; `version` names the column of the window's version."""
    df = project(raw, WEIGHTS, version, *extra)
    known = index_catalog(df.sparkSession, broad=False).withColumnRenamed("version", "__v")
    df = df.join(known, (F.col("index_ticker").cast("string") == F.col("catalog_ticker")) & (F.col(version) == F.col("__v")), "left")
    df = df.withColumns({"classification_name": F.col("catalog_name"), "classification_version": F.col(version)})
    df = with_symbol(df, "constituent_ticker", "constituent_exchange_cd", "constituent_sec_id", "constituent_symbol")
    return typed(df, WEIGHTS, *extra, *([version] if version not in extra else []))
