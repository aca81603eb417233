"""Registered queries against their SQL twins, and the shape of the plans."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from stationflow.operators import dedup, moves, panel
from stationflow.workload.registry import REGISTRY
from stationflow.workload.views import tables_for

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert len(got) > 0
    else:
        want = duck.execute(oracle).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert [tuple(map(str, r)) for r in rows(got)] == [tuple(map(str, r)) for r in rows(want.astype(got.dtypes.to_dict()))]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_single_task_steps(spark):
    t = tables_for(spark, SF, "coarse")
    plans = {"moves": plan(moves.moves(t.trips, **t.move_rules)), "panel": plan(panel.station_hourly(t.trips, t.moves)),
             "dedup": plan(dedup.dedup_trips(t.clean.select("bike_id", "rent_dt", "rent_st", "ret_dt", "ret_st", "dur_min", "dist_km", "f_ctrl_rent",
                                                            "f_ctrl_ret", "f_cancel", "f_time_bad", "src_month")))}
    for text in plans.values():
        assert "SinglePartition" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert plans["panel"].count("Exchange hashpartitioning") == 1
    assert "WindowGroupLimit" in plans["dedup"] and "Partial" in plans["dedup"]


def test_period_filter_reaches_the_scan(spark):
    from stationflow.operators import robustness
    t = tables_for(spark, SF, "coarse")
    text = plan(robustness.in_period(t.panel, "2024-01-05", "2024-01-09"))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
