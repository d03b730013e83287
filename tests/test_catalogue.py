import datetime
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are needed")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _norm(v):
    return round(v, 6) if isinstance(v, float) else v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_equals_oracle(spark, duck, name):
    got = catalogue.queries()[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    if name not in catalogue.oracle_sql():
        assert data
        return
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, data) == rows(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_approx_distinct_keeps_a_sketch_a_group(spark, tmp_path):
    """No aggregate by pair holds a sketch, and the counts are those of all rows, with nulls and repeated rows."""
    made = [(flag, None if key % 7 == 0 else key % (11 if flag is None else 400)) for flag in ("A", "R", None) for key in range(3000)] + [("N", None)] * 3
    spark.createDataFrame(made, "l_returnflag string, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.queries()["agg_approx_distinct"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct" in plan
    assert not re.search(r"keys=\[[^\]]*l_partkey[^\]]*\], functions=\[[^\]]*approx_count_distinct", plan)
    want = spark.sql("SELECT l_returnflag, ABS(approx_count_distinct(l_partkey) - COUNT(DISTINCT l_partkey)) <= 0.15 * COUNT(DISTINCT l_partkey) AS close FROM {t} GROUP BY l_returnflag", t=catalogue.read(spark, str(tmp_path), "lineitem"))
    assert got.schema == want.schema
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


@pytest.mark.parametrize("name, moves", [("explode_join", 5), ("array_size", 2), ("array_contains_filter", 2)])
def test_documents_are_dealt_by_size(spark, duck, monkeypatch, name, moves):
    """On tables too large to broadcast, what is gathered and joined goes once, to tasks in number as the lines' files."""
    monkeypatch.setattr(catalogue, "DEALT_BYTES", 10_000, raising=False)
    n_tasks = -(-os.path.getsize(f"{SF}/lineitem.parquet") // 10_000)
    assert n_tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = catalogue.queries()[name](spark, SF)
        plan = got._jdf.queryExecution().executedPlan().toString()
        data = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.findall(r"hashpartitioning\(\S*(?:order|part)key#\w+, (\d+)\)", plan) == [str(n_tasks)] * moves
    assert rows(got.columns, data) == rows(got.columns, duck.sql(f"SELECT {', '.join(got.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall())
