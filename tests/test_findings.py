"""Findings of reviews: queries against their SQL on rows that differed once, and plans that must stay bounded."""

from collections import Counter

import duckdb
import pytest

from tidegauge.plans.all_queries import oracle_sql, queries

LARGE = "/root/testdata/sf0.1"


def _plain(x):
    return None if x is None or x != x else round(x, 9) if isinstance(x, float) else str(x)


def _against_sql(spark, folder, name, **tables):
    """A query's rows and its SQL's over tables given as SQL."""
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    c.execute("SET threads = 1")  # sums of doubles in the order of the rows; on more threads their last digits vary from run to run
    for t, text in tables.items():
        c.execute(f"COPY ({text}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = queries()[name](spark, str(folder))
    result = c.execute(oracle_sql()[name])
    columns = [d[0] for d in result.description]
    return Counter(tuple(map(_plain, r)) for r in df.select(*columns).collect()), Counter(tuple(map(_plain, r)) for r in result.fetchall())


@pytest.mark.parametrize("name", ["candidates_gated", "candidates_gated_losses"])
def test_gates_on_bars_without_a_structure(spark, tmp_path, name):
    """Prices of 0 leave bars without a setup, on which strategies have no turn."""
    events = f"SELECT * REPLACE ('s' || user_id % 40 AS event_type, greatest(value - 20, 0) AS value) FROM '{LARGE}/events.parquet' WHERE user_id % 40 IN (12, 16, 18, 28)"
    ours, theirs = _against_sql(spark, tmp_path, name, events=events)
    assert ours == theirs and ours


def test_labels_of_a_price_of_zero(spark, tmp_path):
    events = f"SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS value) FROM '{LARGE}/events.parquet' WHERE event_id < 300"
    ours, theirs = _against_sql(spark, tmp_path, "text_labels", events=events)
    assert ours == theirs and ours


def test_equal_customers_have_equal_sums(spark, tmp_path):
    """Copies of customers, whose rows lie in several row groups that are read by several tasks."""
    orders = f"SELECT * REPLACE (o_orderkey + 150000 * k AS o_orderkey, o_custkey + 15000 * k AS o_custkey) FROM range(2) r(k), '{LARGE}/orders.parquet' ORDER BY o_orderkey"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        ours, theirs = _against_sql(spark, tmp_path, "sorted_results", orders=orders)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert ours == theirs and ours


def _plan(spark, df):
    """The plan without broadcasts, as for large tables."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        return df()._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_legs_without_tickets_spread_over_tasks(spark, sf):
    """Their null must not be the only key of an exchange."""
    plan = _plan(spark, lambda: queries()["reconcile"](spark, sf))
    assert "hashpartitioning(coalesce(ticket" in plan and "hashpartitioning(ticket" not in plan


def test_first_touch_sorts_no_pairs(spark, sf):
    """Pairs of starts and bars go to a hash aggregation of their times, not to a sorted one of rows."""
    assert "SortAggregate(key=[event_id" not in _plan(spark, lambda: queries()["first_touch"](spark, sf))


def test_levels_are_computed_once(spark, sf):
    """Each use of a value inside a lambda computes it again, unless it is bound."""
    plan = queries()["base_distance"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lambdafunction(") < 100  # 407 once
