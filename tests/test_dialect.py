"""Queries of the other dialect run on Spark and give what an embedded engine of that dialect gives."""

import duckdb
import pyarrow as pa
import pytest

from tessera.plans.dialect import texts
from tessera.plans.engine import QueryEngine

ROWS = [{"id": i, "grp": "ab"[i % 2], "score": None if i % 4 == 0 else i * 1.5, "tags": ["x", "y", "z"][: i % 4], "items": [{"sku": f"s{j}", "qty": i + j} for j in range(i % 3)], "end": {"name": f"n{i}"}} for i in range(12)]

QUERIES = [
    "SELECT item.sku AS sku, SUM(item.qty) AS q FROM (SELECT unnest(items) AS item FROM t) GROUP BY item.sku",
    "SELECT id, unnest(tags) AS tag FROM t",
    "SELECT t.id, u.tag FROM t, unnest(t.tags) AS u(tag)",
    "SELECT id, tags[1] AS a, tags[-1] AS b, items[1].sku AS c FROM t",
    "SELECT id FROM t WHERE list_contains(tags, 'y')",
    "SELECT id, len(tags) AS n FROM t",
    "SELECT id, len(grp) AS n FROM t",
    "SELECT id, grp FROM t QUALIFY ROW_NUMBER() OVER (PARTITION BY grp ORDER BY score DESC, id) = 1",
    "SELECT id, RANK() OVER (ORDER BY score) AS r FROM t QUALIFY r <= 3 ORDER BY id LIMIT 5",
    "WITH w AS (SELECT id, grp FROM t QUALIFY ROW_NUMBER() OVER (PARTITION BY grp ORDER BY id DESC) <= 2) SELECT grp, COUNT(*) AS n FROM w GROUP BY grp ORDER BY grp",
    "SELECT id, score FROM t ORDER BY score, id LIMIT 10",
    "SELECT id, score FROM t ORDER BY score DESC, id LIMIT 10",
    "SELECT id, LAG(id) OVER (PARTITION BY grp ORDER BY score, id) AS before FROM t",
    'SELECT "end".name AS name FROM t',
    "SELECT * EXCLUDE (tags, items, \"end\") FROM t",
    "SELECT CAST(id AS VARCHAR) AS s, id::VARCHAR AS s2, id // 5 AS d FROM t",
    "SELECT list_contains([1, 2, 3], id) AS has FROM t",
    "SELECT 'unnest(x) [1] QUALIFY' AS s, id FROM t -- unnest(",
    "SELECT {'a': id, 'b': grp}.b AS b FROM t",
    "SELECT grp, len(list(id)) AS n FROM t GROUP BY grp",
]


@pytest.fixture(scope="module")
def both(spark):
    con = duckdb.connect()
    table = pa.Table.from_pylist(ROWS)
    con.register("t", table)
    with QueryEngine(spark=spark, dialect="compat") as engine:
        engine.register("t", ROWS)
        yield engine, con


@pytest.mark.parametrize("sql", QUERIES)
def test_same_rows(both, sql):
    engine, con = both
    want = con.sql(sql)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    got = engine.query(sql)
    if "ORDER BY id" not in sql and "LIMIT" not in sql:
        rows, got = (sorted(x, key=lambda r: repr(sorted(r.items()))) for x in (rows, got))
    assert got == rows, texts(sql)


def test_guard_holds(both):
    from tessera.plans.guard import ReadOnlyViolationError

    for sql in ("DROP TABLE t", "SELECT 1; SELECT unnest(tags) FROM t", "SELECT unnest(x) FROM read_csv('y')", "ATTACH 'x'"):
        with pytest.raises(ReadOnlyViolationError):
            both[0].query(sql)


def test_unknown_dialect(spark):
    with pytest.raises(ValueError):
        QueryEngine(spark=spark, dialect="x")
