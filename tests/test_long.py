"""Histories of millions of bars."""

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import lifecycle, swings
from tidegauge.sources.tables import with_bar_idx


def test_first_bar_in_ten_million_bars(spark):
    n = 10_000_000
    at = F.col("id")
    # a slow wave on a slow rise: the first hit may be the next bar or millions of bars away
    close = F.round(at / 1e5 + 20 * F.sin(at / 5e5) + F.pmod(at * 7919, F.lit(1000)) / 1000, 3)
    bars = spark.range(0, n, numPartitions=8).select(F.lit("a").alias("symbol"), at.cast("int").alias("bar_idx"), close.alias("close"), (close + 0.5).alias("high"), (close - 0.5).alias("low"))
    i = np.arange(n)
    high = np.round(i / 1e5 + 20 * np.sin(i / 5e5) + i * 7919 % 1000 / 1000, 3) + 0.5
    rng = np.random.default_rng(3)
    asks = [(k, "a", int(a), float(high[a] + d)) for k, (a, d) in enumerate(zip(rng.integers(0, n, 40), rng.exponential(25, 40)))]
    assert lifecycle.levels_of(bars) == 4
    q = spark.createDataFrame(asks, "k int, symbol string, at int, goal double")
    got = {r["k"]: r["hit_idx"] for r in lifecycle.first_bar(q, ("k",), bars, "at", lambda cl, ch, lo, hi: hi >= F.col("goal")).collect()}
    want = {k: int(a + 1 + np.argmax(high[a + 1 :] >= g)) for k, _, a, g in asks if (high[a + 1 :] >= g).any()}
    assert set(got) == set(want) and max(want[k] - asks[k][2] for k in want) > 1_000_000
    # Spark's and numpy's sines may differ in the last place, and so a rounded close by a thousandth
    assert all(abs(high[got[k]] - asks[k][3]) < 0.0021 or got[k] == want[k] for k in want) and sum(got[k] == want[k] for k in want) > 0.9 * len(want)


def _long(spark, n, parts=8):
    """A symbol of n bars of 15 minutes, with gaps, without numbers."""
    at = F.col("id")
    close = F.round(100 + 10 * F.sin(at / 7) + 5 * F.sin(at / 211) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 250, 2)
    ts = F.timestamp_seconds(1_700_000_000 + (at + F.floor(at / 500) * 700) * 900).cast("timestamp_ntz")
    return spark.range(0, n, numPartitions=parts).select(F.lit("a").alias("symbol"), F.lit("15min").alias("tf"), ts.alias("bar_ts"), close.alias("close"), close.alias("open"), (close + 0.3).alias("high"), (close - 0.3).alias("low"))


def test_spans_number_bars_and_find_swings_alike(spark, tmp_path):
    _long(spark, 30_000).write.parquet(str(tmp_path / "bars"))
    b = spark.read.parquet(str(tmp_path / "bars"))
    whole, cut = with_bar_idx(b), with_bar_idx(b, 30)
    assert whole.exceptAll(cut.select(*whole.columns)).count() == 0 and cut.count() == 30_000
    want, got = swings.swings(whole), swings.swings_in_spans(cut, size=700)
    assert want.count() > 500
    assert want.exceptAll(got.select(*want.columns)).count() == got.select(*want.columns).exceptAll(want).count() == 0


def test_a_long_symbol_is_many_tasks(spark, tmp_path):
    _long(spark, 600_000).write.parquet(str(tmp_path / "bars"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        b = with_bar_idx(spark.read.parquet(str(tmp_path / "bars")), 64)
        rows = [r["n"] for r in b.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert len(rows) == 4 and max(rows) < 0.6 * sum(rows)  # all tasks of the session have bars of the one symbol
        assert b.agg(F.max("bar_idx"), F.countDistinct("bar_idx")).first() == (599_999, 600_000)
        s = swings.swings_in_spans(b, size=20_000).where("confirmed")
        assert s.agg(F.count("*"), F.countDistinct("leg_id"), F.min("leg_id")).first()[1] == s.count() > 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
