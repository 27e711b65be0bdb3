"""Fixed columns of the three market tables, raw and processed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Table:
    """rename: raw to processed names. columns: processed names and types, in order. split: columns that, with the day, make up what is stored as a whole."""

    name: str
    rename: dict[str, str]
    columns: str
    date: str
    order: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    split: tuple[str, ...] = ()

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.columns)

    @property
    def raw_schema(self) -> T.StructType:
        """Raw fields land as text."""
        return T.StructType([T.StructField(c, T.StringType()) for c in self.rename])


# Field names, their new names, and the processed columns in order.
EQUITY = Table(
    "equity_daily",
    {
        "secID": "sec_id", "ticker": "ticker", "secShortName": "sec_short_name", "exchangeCD": "exchange_cd", "tradeDate": "trade_date",
        "preClosePrice": "pre_close_hfq", "actPreClosePrice": "pre_close_raw", "openPrice": "open", "highestPrice": "high", "lowestPrice": "low",
        "closePrice": "close", "turnoverVol": "volume_hfq", "turnoverValue": "amount", "dealAmount": "deal_count", "turnoverRate": "turnover_rate",
        "accumAdjFactor": "adj_factor", "negMarketValue": "float_market_cap", "marketValue": "market_cap", "isOpen": "is_open", "vwap": "vwap",
    },
    "sec_id string, ticker string, symbol string, sec_short_name string, exchange_cd string, trade_date date, pre_close_hfq double, pre_close_raw double, "
    "open double, high double, low double, close double, volume_hfq double, amount double, deal_count bigint, turnover_rate double, adj_factor double, "
    "float_market_cap double, market_cap double, is_open tinyint, vwap double",
    "trade_date",
    ("symbol", "sec_id"),
)
INDEX = Table(
    "index_daily",
    {
        "indexID": "index_id", "ticker": "ticker", "secShortName": "sec_short_name", "exchangeCD": "exchange_cd", "tradeDate": "trade_date",
        "preCloseIndex": "pre_close", "openIndex": "open", "lowestIndex": "low", "highestIndex": "high", "closeIndex": "close",
        "turnoverVol": "volume", "turnoverValue": "amount", "CHG": "change", "CHGPct": "change_pct",
    },
    "index_id string, ticker string, sec_short_name string, exchange_cd string, trade_date date, index_family string, classification_version string, "
    "classification_name string, pre_close double, open double, low double, high double, close double, volume double, amount double, change double, change_pct double",
    "trade_date",
    ("index_family", "ticker", "index_id"),
)
WEIGHTS = Table(
    "industry_weights",
    {
        "secID": "index_sec_id", "ticker": "index_ticker", "secShortName": "index_short_name_source", "consID": "constituent_sec_id",
        "consShortName": "constituent_short_name", "consTickerSymbol": "constituent_ticker", "consExchangeCD": "constituent_exchange_cd",
        "effDate": "effective_date", "weight": "weight",
    },
    "index_sec_id string, index_ticker string, index_short_name_source string, classification_version string, classification_name string, "
    "constituent_sec_id string, constituent_ticker string, constituent_symbol string, constituent_short_name string, constituent_exchange_cd string, "
    "effective_date date, weight double",
    "effective_date",
    ("effective_date", "index_ticker", "constituent_symbol", "constituent_sec_id"),
    ("classification_version", "index_ticker", "constituent_sec_id", "effective_date"),
)


class MissingColumns(ValueError):
    pass


def require(df: DataFrame, table: Table) -> None:
    """Raises with the sorted names of absent raw fields; runs no job."""
    absent = sorted(set(table.rename) - set(df.columns))
    if absent:
        raise MissingColumns(f"{table.name}: missing columns {absent}")


def unused(name: str, columns: list[str]) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
