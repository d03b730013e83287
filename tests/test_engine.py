import re

import pytest

import tessera
from tessera.plans.engine import QueryEngine
from tessera.plans.guard import ReadOnlyViolationError, ResultTooLargeError, SecurityConfig
from tessera.plans.table_text import FORMATS, table_text

ORDERS = [
    {"order_id": i, "product_id": i % 3, "customer": {"customer_id": f"c{i % 2}", "name": "Ann"}, "items": [{"product_id": j, "qty": j + i} for j in range(i % 4)], "tags": ["x", "y"][: i % 3], "end": {"station": "S"}, "first-name": "A", "day": "2024-01-0%d" % (i % 9 + 1), "status": "ab"[i % 2], "score": None if i % 5 else i / 2}
    for i in range(12)
]


@pytest.fixture(scope="module")
def engine(spark):
    with QueryEngine(spark=spark) as own:
        own.register("orders", ORDERS, description="what was bought")
        own.register_many({"products": [{"id": i, "name": f"p{i}"} for i in range(3)], "customers": ({"all": {"rows": [{"customer_id": "c0"}, {"customer_id": "c1"}]}}, "$.all.rows")})
        yield own


def test_nested_explode_and_join(engine):
    got = engine.query("SELECT p.name, SUM(i.item.qty) AS q FROM (SELECT explode(items) AS item FROM orders) i JOIN products p ON i.item.product_id = p.id GROUP BY p.name ORDER BY p.name")
    want = {}
    for o in ORDERS:
        for i in o["items"]:
            want[f"p{i['product_id']}"] = want.get(f"p{i['product_id']}", 0) + i["qty"]
    assert {r["name"]: r["q"] for r in got} == want


def test_names_in_double_quotes_and_backticks(engine):
    assert engine.query('SELECT "end".station AS s, `first-name` AS f FROM orders LIMIT 1') == [{"s": "S", "f": "A"}]


def test_nested_values_come_as_dicts_and_lists(engine):
    row = engine.query("SELECT * FROM orders WHERE order_id = 3")[0]
    assert row["customer"] == {"customer_id": "c1", "name": "Ann"} and row["items"][0] == {"product_id": 0, "qty": 3}


BAD = [
    "DROP VIEW orders", "CREATE TEMP VIEW v AS SELECT 1", "CREATE TABLE t (a INT)", "INSERT INTO orders VALUES (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "DELETE FROM orders", "UPDATE orders SET order_id = 1",
    "SET spark.sql.ansi.enabled=false", "RESET", "CACHE TABLE orders", "SHOW TABLES", "DESCRIBE orders", "USE default", "ADD JAR 'x.jar'", "ATTACH 'x'", "COPY orders TO 'x'", "INSTALL httpfs", "LOAD httpfs", "PRAGMA version", "EXPORT DATABASE 'x'",
    "SELECT 1; DROP VIEW orders", "SELECT 1; SELECT 2", "/* c */ DROP VIEW orders -- x", "EXPLAIN DROP VIEW orders", "EXPLAIN ANALYZE SELECT 1; DROP VIEW orders", "BEGIN SELECT 1; END",
    "SELECT * FROM text.`/etc/hostname`", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM csv.`/etc/passwd`", "SELECT * FROM global_temp.x", "SELECT * FROM nobody", "SELECT * FROM spark_catalog.default.orders",
    "SELECT java_method('java.lang.System', 'getenv', 'HOME')", "SELECT reflect('java.lang.System', 'getenv', 'HOME')", "SELECT (SELECT reflect('a', 'b', 'c'))", "SELECT 1 WHERE 1 IN (SELECT try_reflect('a', 'b', 'c'))", "SELECT input_file_name() FROM orders",
    "SELECT order_id FROM orders WHERE EXISTS (SELECT 1 FROM text.`/etc/hostname`)", "SELECT * FROM read_state_metadata('x')", "FROM orders |> WHERE reflect('a','b') = 'x'",
]


@pytest.mark.parametrize("sql", BAD)
def test_refused(engine, sql):
    with pytest.raises(ReadOnlyViolationError):
        engine.query(sql)
    assert engine.execute_query(sql).success is False


GOOD = [
    ("SELECT 1 AS x", 1), ("SELECT i FROM range(100) t(i)", 100), ("SELECT ';' AS x;", 1), ("WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b", 1), ("VALUES (1), (2)", 2),
    ("SELECT customer.name FROM orders UNION ALL SELECT name FROM products", 15), ("SELECT order_id FROM orders EXCEPT SELECT id FROM products", 9), ("SELECT status, COUNT(*) FROM orders GROUP BY ROLLUP (status)", 3),
    ("SELECT o.order_id, x.item.qty FROM orders o, LATERAL (SELECT explode(o.items) AS item) x", 18), ("SELECT order_id, RANK() OVER (PARTITION BY status ORDER BY order_id) FROM orders", 12), ("SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.id = o.product_id)", 0),
    ("SELECT inline(items) FROM orders", 18), ("SELECT * FROM orders LATERAL VIEW explode(tags) t AS tag", 12), ("SELECT get(items, 0).qty AS q, size(tags) AS n FROM orders WHERE array_contains(tags, 'x')", 8), ("-- note\nSELECT 1 AS a", 1),
]


@pytest.mark.parametrize(("sql", "n"), GOOD)
def test_allowed(engine, sql, n):
    result = engine.execute_query(sql)
    assert result.success and result.row_count == n, result.error


def test_syntax_errors_are_errors(engine):
    with pytest.raises(Exception, match="PARSE|syntax"):
        engine.query("SELEC 1")


def test_row_cap_allows_exactly_the_cap(spark):
    with QueryEngine(spark=spark, max_result_rows=10) as own:
        assert len(own.query("SELECT * FROM range(10)")) == 10
        with pytest.raises(ResultTooLargeError):
            own.query("SELECT * FROM range(11)")
        assert len(list(own.query_iter("SELECT * FROM range(50)", 7))) == 50


@pytest.mark.parametrize("sql", ["SELECT repeat('x', 50000000) AS v", "SELECT array(repeat('x', 50000000)) AS v", "SELECT repeat('x', 1000) AS v FROM range(5000)"])
def test_byte_cap(spark, sql):
    with QueryEngine(SecurityConfig(max_result_bytes=1_000_000), spark=spark) as own, pytest.raises(ResultTooLargeError):
        own.query(sql)


BIG = ["SELECT space(50000000) AS v FROM t", "SELECT format_string('%050000000d', 1) AS v FROM t", "SELECT replace(space(100000), ' ', 'ab') || space(900000) AS v FROM t", "SELECT map('k', space(2000000)) AS v", "SELECT named_struct('a', array(named_struct('b', space(2000000)))) AS v", "SELECT t.s AS a, u.s AS b FROM t JOIN t u ON TRUE JOIN range(30) ON TRUE", "SELECT explode(array_repeat(s, 40)) AS v FROM t", "SELECT * FROM t, LATERAL (SELECT explode(sequence(1, 40)))"]


@pytest.mark.parametrize("sql", BIG)
def test_byte_cap_asks_for_no_words(spark, sql):
    """Whatever makes the bytes, they are counted where they are made."""
    with QueryEngine(SecurityConfig(max_result_bytes=1_000_000), spark=spark) as own:
        own.register("t", [{"s": "x" * 20_000}, {"s": "y" * 20_000}])
        with pytest.raises(ResultTooLargeError):
            own.query(sql)
        assert len(own.query("SELECT s FROM t")) == 2 and own.query("SELECT space(30) AS v") == [{"v": " " * 30}]


def test_size_of_cells(spark):
    from tessera.plans.result_size import passes_on, result_bytes

    df = spark.sql("SELECT 'abc' AS a, array('d', NULL, 'éé') AS b, named_struct('x', 1, 'y', 'zz') AS c, map('k', 'vv') AS d, CAST(NULL AS STRING) AS e, 5 AS f, array(1, 2, 3) AS g, X'0102' AS h")
    assert result_bytes(df) == 3 + (1 + 0 + 4 + 3 * 8) + (8 + 2) + (1 + 8 + 2 + 8) + 0 + 24 + 2
    table = spark.createDataFrame([("x", 1, ["y"])], "s string, n int, a array<string>")
    assert all(passes_on(x) for x in (table, table.where("n > 0").orderBy("s").limit(3), table.groupBy("s").count(), table.selectExpr("s AS t", "n + 1 AS m")))
    assert not any(passes_on(x) for x in (table.selectExpr("upper(s) AS t"), table.selectExpr("explode(a)"), table.crossJoin(table), table.selectExpr("array(n) AS b"), table.groupBy("n").agg({"s": "collect_list"})))


def test_time_limit_ends_a_wait_that_is_no_job(spark):
    import time

    from tessera.plans.guard import in_time

    began = time.monotonic()
    with pytest.raises(TimeoutError):
        in_time(spark, 0.5, lambda: time.sleep(20))
    assert time.monotonic() - began < 5 and in_time(spark, 5, lambda: 7) == 7
    with pytest.raises(KeyError):
        in_time(spark, 5, lambda: {}["x"])


def test_names_of_with_count_in_their_scope_only(spark):
    """A table of the catalog that isn't registered stays out of reach, whatever a statement names its parts."""
    spark.sql("CREATE TABLE IF NOT EXISTS secrets USING parquet AS SELECT 42 AS pw")
    try:
        with QueryEngine(spark=spark) as own:
            own.register("t", [{"a": 1}])
            for sql in (
                "SELECT * FROM secrets", "SELECT * FROM secrets, (WITH secrets AS (SELECT 1 AS a) SELECT * FROM secrets) x", "WITH x AS (SELECT * FROM secrets), secrets AS (SELECT 1 AS a) SELECT * FROM x",
                "WITH secrets AS (SELECT * FROM secrets) SELECT * FROM secrets", "SELECT (WITH secrets AS (SELECT 1 AS a) SELECT a FROM secrets) AS b, pw FROM secrets", "SELECT * FROM t WHERE a IN (SELECT pw FROM secrets)",
                "WITH a AS (WITH secrets AS (SELECT 1 AS x) SELECT * FROM secrets) SELECT * FROM a, secrets", "SELECT * FROM IDENTIFIER('secrets')", "TABLE secrets", "SELECT * FROM t UNION ALL SELECT * FROM secrets",
            ):
                with pytest.raises(ReadOnlyViolationError):
                    own.query(sql)
            for sql in (
                "WITH secrets AS (SELECT 1 AS a) SELECT * FROM secrets", "WITH a AS (SELECT 1 AS x), b AS (SELECT * FROM a) SELECT * FROM b", "SELECT * FROM (WITH a AS (SELECT 1 AS x) SELECT * FROM a)",
                "WITH a AS (SELECT 1 AS x) SELECT * FROM t WHERE a IN (SELECT x FROM a)", "WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 1) SELECT * FROM r", "WITH A AS (SELECT 1 AS x) SELECT * FROM a",
            ):
                assert len(own.query(sql)) == 1, sql
    finally:
        spark.sql("DROP TABLE secrets")


def test_reserved_words_need_quotes(engine):
    with pytest.raises(Exception, match="PARSE|syntax"):
        engine.query("SELECT end FROM orders")
    assert len(engine.query('SELECT "end".station FROM orders')) == 12


def test_files_by_functions_after_opt_in(spark, tmp_path, engine):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n2,y\n")
    (tmp_path / "b.json").write_text('[{"k": 1}, {"k": 2}]')
    (tmp_path / "c.txt").write_text("some text")
    with QueryEngine(spark=spark, allow_external_access=True) as own:
        assert own.query(f"SELECT v FROM read_csv('{tmp_path}/a.csv') WHERE k = 2") == [{"v": "y"}]
        assert own.query(f"SELECT a.v FROM read_csv_auto('{tmp_path}/a.csv') a JOIN read_json('{tmp_path}/b.json') b ON a.k = b.k ORDER BY v") == [{"v": "x"}, {"v": "y"}]
        assert own.query(f"SELECT content FROM read_text('{tmp_path}/c.txt')") == [{"content": "some text"}]
        assert own.query("SELECT 'read_csv(''x'')' AS v") == [{"v": "read_csv('x')"}]
    for name in ("read_csv", "read_json", "read_text", "read_parquet"):
        with pytest.raises(ReadOnlyViolationError):
            engine.query(f"SELECT * FROM {name}('{tmp_path}/a.csv')")


def test_settings_tell_what_holds(spark):
    with QueryEngine(spark=spark, query_timeout=5, max_result_rows=7) as own:
        got = own.settings()
        assert got["query_timeout"] == 5 and got["max_result_rows"] == 7 and got["read_only"] and not got["allow_external_access"] and got["locked"]


def test_timeout_leaves_the_engine_usable(spark):
    with QueryEngine(spark=spark, query_timeout=1.5) as own:
        with pytest.raises(TimeoutError):
            own.query("SELECT COUNT(*) FROM range(200000000000) WHERE hash(id) % 1000003 = 3")
        assert own.query("SELECT 1 AS x") == [{"x": 1}]


def test_views_only_without_read_only(spark):
    with QueryEngine(spark=spark, read_only=False) as own:
        own.execute("CREATE TEMP VIEW v AS SELECT 1 AS x")
        assert own.query("SELECT * FROM v") == [{"x": 1}]
        for sql in ("SET spark.sql.ansi.enabled=false", "CREATE TABLE t AS SELECT 1", "SELECT * FROM text.`/etc/hostname`", "CREATE TEMP VIEW w AS SELECT reflect('a','b')"):
            with pytest.raises(ReadOnlyViolationError):
                own.execute(sql)


def test_engines_do_not_see_each_other(spark, engine):
    with QueryEngine(spark=spark) as other, pytest.raises(ReadOnlyViolationError):
        other.query("SELECT * FROM orders")


@pytest.mark.parametrize("name", ["a b", "1a", "a;", "a\n", "", "a-b", None])
def test_table_names(engine, name):
    with pytest.raises(ValueError):
        engine.register(name, [])


def test_sources_that_cannot_be_read(engine):
    with pytest.raises(TypeError):
        engine.register("t", 5)
    with pytest.raises(ValueError):
        engine.register("t", {"a": 5}, "$.a")
    with pytest.raises(ValueError):
        engine.register("t", '[{"a": NaN}]')


def test_prompt_examples_run(engine):
    prompt = engine.generate_prompt()
    examples = re.findall(r"```sql\n(.*?)\n```", prompt, re.S)
    assert len(examples) >= 6
    for sql in examples:
        result = engine.execute_query(sql)
        assert result.success, (sql, result.error)
    for part in ("orders", "what was bought", "`first-name`", "`end`", "one of [\"a\", \"b\"]", "(ISO date)", "float?", "orders.product_id = products.id", "orders.customer.customer_id = customers.customer_id"):
        assert part in prompt, part


def test_prompt_of_one_table_has_no_joins(spark):
    with QueryEngine(spark=spark) as own:
        assert "## Joins" not in own.register("t", [{"a": 1, "b": "x"}]).generate_prompt()


def test_value_tables_are_described_by_columns(spark):
    with QueryEngine(spark=spark) as own:
        assert "| value | bigint |" in own.register("t", [1, 2]).describe_tables()


def test_other_ways_to_a_result(engine, capsys):
    assert engine.query_arrow("SELECT 1 AS x").to_pylist() == [{"x": 1}]
    assert "Physical Plan" in engine.explain("SELECT * FROM orders")
    assert engine.execute("SELECT 1 AS x").columns == ["x"]
    result = engine.execute_query("SELECT order_id FROM orders ORDER BY order_id", split=2)
    assert result.row_count == 12 and result.preview.count("\n") == 3
    assert engine.format_query("SELECT nope FROM orders").startswith("ERROR: ")
    with pytest.raises(ValueError):
        engine.format_query("SELECT 1", format="xml")
    engine.query_print("SELECT order_id FROM orders", max_rows=2, title="T")
    assert "showing 2 of 12" in capsys.readouterr().out
    assert "rows: 12" in engine.tables_info() and "order_id: bigint" in engine.schema("orders")


@pytest.mark.parametrize("format", FORMATS)
def test_formats(format):
    text = table_text(["a", "b"], [(1, "x" * 60), (None, {"k": "é|"})], format, 20)
    assert ("…" in text) == (format not in ("csv", "json")) and "é" in text


def test_parquet_and_frames(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "p"))
    with QueryEngine(spark=spark) as own:
        own.register_parquet("p", str(tmp_path / "p")).register_df("d", spark.range(3))
        assert own.query("SELECT COUNT(*) AS n FROM p JOIN d USING (id)") == [{"n": 3}]


def test_frames_are_described_like_json(spark, tmp_path):
    """Tables of frames and Parquet give a prompt their schema, values and keys."""
    spark.sql("SELECT id AS order_id, id % 3 AS customer_id, CAST('2024-05-01' AS DATE) AS day, named_struct('city', 'Ulm', 'zip', CAST(NULL AS STRING)) AS place, array(named_struct('sku', 's1', 'qty', 2)) AS items, IF(id % 2 = 0, 'new', 'paid') AS status FROM range(50)").write.parquet(f"{tmp_path}/orders")
    with QueryEngine(spark=spark) as own:
        own.register_parquet("orders", f"{tmp_path}/orders", "web shop").register_df("customers", spark.sql("SELECT id AS customer_id, 'Ann' AS name, map('k', 1) AS m FROM range(3)"))
        text = own.generate_prompt()
        for part in ("orders.customer_id = customers.customer_id", "sku: str samples=[\"s1\"]", 'status: str e.g. one of ["new", "paid"]', "day: str (ISO date)", "place: {city: str", "(50 rows)", "web shop"):
            assert part in text, (part, text)
        for sql in re.findall(r"```sql\n(.*?)\n```", text, re.S):
            assert own.execute_query(sql).success, sql


def test_json_files_of_a_shared_store(spark, tmp_path):
    """Files are read by Spark where open() doesn't reach them: small, large, with a path, and as lines."""
    import json

    data = {"all": {"rows": [{"k": i, "s": "é" * 30} for i in range(3000)]}}
    (tmp_path / "d.json").write_text(json.dumps(data["all"]["rows"]))
    (tmp_path / "p.json").write_text("\ufeff" + json.dumps(data))
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, data["all"]["rows"])))
    for least in (1, 1 << 30):
        with QueryEngine(spark=spark, stream_min_bytes=least) as own:
            own.register("d", f"file://{tmp_path}/d.json").register("p", f"file://{tmp_path}/p.json", "$.all.rows").register("l", f"file://{tmp_path}/l.jsonl").register("o", f"file://{tmp_path}/p.json", "$.all")
            assert own.query("SELECT SUM(d.k) AS a, SUM(p.k) AS b, SUM(l.k) AS c FROM d JOIN p USING (s, k) JOIN l USING (s, k)") == [{"a": 4498500, "b": 4498500, "c": 4498500}]
            assert own.query("SELECT size(rows) AS n FROM o") == [{"n": 3000}]
            with pytest.raises(Exception, match="not found"):
                own.register("x", f"file://{tmp_path}/p.json", "$.all.none").query("SELECT * FROM x")
    with QueryEngine(spark=spark) as own, pytest.raises(FileNotFoundError):
        own.register("x", f"file://{tmp_path}/nothing.json")


def test_facade(spark, tmp_path):
    assert tessera.validate(spark) == []
    with tessera.Profiler(spark=spark) as p:
        with pytest.raises(ValueError):
            p.tree()
        p.analyze([{"a": 1}, {"a": 2}])
        assert p.query("SELECT SUM(a) AS s FROM data") == [{"s": 3}] and p.stats_result() is p.stats_result()
        assert set(p.timing()) == {"parse_time", "analyze_time", "sample_time", "total_time"} and "list" in repr(p)
        assert "<value>" in p.tree() and p.tree("schema").startswith("[{") and "a" in p.query_table("SELECT a FROM data")
        assert p.analyze(['{"a": 1}', '{"b": 2}']).query("SELECT COUNT(a) AS n FROM data") == [{"n": 1}]
        assert p.analyze("42").tree("schema") == "int samples=[42]"
        with pytest.raises(ValueError):
            p.analyze("no such thing")
        with pytest.raises(TypeError):
            p.analyze(3.5)
        with pytest.raises(ValueError):
            p.analyze([1]).tree("xml")
