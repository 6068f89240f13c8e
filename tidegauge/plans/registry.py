"""Queries by name, each with its equivalent in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.scalars import round6
from tidegauge.sources.stored import stored
from tidegauge.sources.tables import build_bars, read_ticks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ticks(spark, f"{sf_dir}/events.parquet")


def bars(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    return build_bars(ticks(spark, sf_dir), tf)


def stored_bars(spark: SparkSession, sf_dir: str, tf: str = "1h") -> DataFrame:
    """Bars as a table of their own, for queries that read them many times: far fewer rows than the ticks."""
    return stored(bars(spark, sf_dir, tf), "bars")


def shown(df: DataFrame, *columns: str, keys: tuple[str, ...] = ("symbol", "bar_ts")) -> DataFrame:
    """Keys and columns; doubles to 6 decimals."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *((round6(c) if kinds[c] == "double" else F.col(c)).alias(c) for c in columns))


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def bars_sql(tf: str = "1h") -> str:
    """The common table expression `bars`."""
    n = {"15min": 900, "1h": 3600, "4h": 14400, "3h": 10800, "8h": 28800}[tf]
    return f"""bars AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS bar_idx FROM (
        SELECT event_type AS symbol, '{tf}' AS tf, CAST(date_trunc('day', ts) + to_seconds(CAST(floor((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / {n}) * {n} AS BIGINT)) AS TIMESTAMP) AS bar_ts,
               arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS tick_volume
        FROM events GROUP BY 1, 2, 3))"""


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY bar_ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


BEFORE = "OVER (PARTITION BY symbol ORDER BY bar_ts)"
