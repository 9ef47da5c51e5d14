"""Registered queries: names, SQL, values beside DuckDB, and plan shapes."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import table

SAMPLE = ["a01_a02_bars_microstructure", "a15_p19_volume_profile", "b10_book_trade_flow", "d04_flow_vote", "f01_ofi_time_windows",
          "g01_merge_quality", "h05_enhanced_row", "j01_asof_backward", "j13_recent_book_rows", "k01_barrier_outcomes", "m02_quantile_label",
          "m09_walk_forward_folds", "q01_q02_rules", "r01_r02_regimes", "s11_incremental_merge", "st01_closed_candles", "st09_feature_refresh",
          "t08_adx", "t30_t31_adaptive", "w06_w18_rolling_agents", "w16_w17_fill_and_interpolate"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET max_temp_directory_size = '2GB'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def test_registry_is_importable_without_a_session():
    q, sql = entry.queries(), entry.oracle_sql()
    assert len(q) > 250 and set(sql) <= set(q)
    text = {n for n in q if n == "pipeline" or n.startswith("op")}  # the text operators come with a package of their own
    assert not {n for n in q if n not in sql} - text


def test_every_sql_binds(con):
    for name, sql in entry.oracle_sql().items():
        con.execute(f"EXPLAIN {sql}")


@pytest.mark.parametrize("name", os.environ.get("QUERIES", ",".join(SAMPLE)).split(","))
def test_values(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    assert table(df.columns, [tuple(r) for r in df.collect()]) == want


CHUNKED = ["a24_trade_buffer", "b10_book_trade_flow", "f01_ofi_time_windows", "f01_f04_flow_counts", "f07_tape_speed", "j01_asof_backward", "j13_recent_book_rows",
           "k04_equity_curve", "k11_w14_streaks", "k14_position_roll_up", "k19_rolling_trades", "p22_quantile_flags", "q11_synthetic_signs", "q12_constant_runs",
           "st03_late_rule_batches", "w01_w05_rolling_stats", "w07_time_range_sums", "w09_w11_cumulative", "w13_streaks", "w19_ema_ticks"]


@pytest.mark.parametrize("name", CHUNKED)
def test_values_across_chunk_edges(spark, sf, con, name):
    """The small tables hold a few hundred ticks per symbol; chunks of 64 rows make every frame cross edges."""
    spark.conf.set("tickloom.chunk.rows", "64")
    try:
        test_values(spark, sf, con, name)
    finally:
        spark.conf.unset("tickloom.chunk.rows")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_time_bounds_reach_the_scan(spark, sf):
    text = plan(entry.queries()["s02_pushed_time_bounds"](spark, sf))
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,value:double>" in text


def test_bars_are_one_exchange_with_partials(spark, sf):
    text = plan(entry.queries()["a03_resample_bars"](spark, sf))
    assert "partial_min" in text and "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["j01_asof_backward", "j13_recent_book_rows", "f01_ofi_time_windows", "k13_excursions", "h02_momentum_rank"])
def test_no_pairwise_joins(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
