import json
import random

import pytest

from tessera.operators.facts import collect_facts
from tessera.operators.infer import build_table
from tessera.sources import json_text as J
from tessera.sources.records import from_file, from_text, from_value


def table(spark, value, **options):
    built = build_table(from_value(spark.newSession(), value), **options)
    return dict(built.df.dtypes), [r.asDict(recursive=True) for r in built.df.collect()], built.wrapped


# Inputs and the types and texts that they have to get.
@pytest.mark.parametrize(
    ("value", "types", "rows"),
    [
        ([{"v": 1}, {"v": 2.5}], {"v": "double"}, [1.0, 2.5]),
        ([{"v": 1}, {"v": "a"}], {"v": "string"}, ["1", "a"]),
        ([{"v": True}, {"v": 1}], {"v": "string"}, ["true", "1"]),
        ([{"v": {"a": 1}}, {"v": 5}], {"v": "string"}, ['{"a":1}', "5"]),
        ([{"v": {"a": 1}}, {"v": [1, 2]}], {"v": "string"}, ['{"a":1}', "[1,2]"]),
        ([{"v": [1, "two", 3.0]}], {"v": "array<string>"}, [["1", "two", "3.0"]]),
        ([{"v": 123456789012345678901234567890}], {"v": "string"}, ["123456789012345678901234567890"]),
        ([{"v": 2**63 - 1}, {"v": -(2**63)}], {"v": "bigint"}, [2**63 - 1, -(2**63)]),
        ([{"v": 2**63}], {"v": "string"}, [str(2**63)]),
        ([{"v": {}}], {"v": "string"}, ["{}"]),
        ([{"v": []}], {"v": "array<string>"}, [[]]),
        ([{"v": None}, {}], {"v": "string"}, [None, None]),
        ([{"v": [[1], [2.5]]}], {"v": "array<array<double>>"}, [[[1.0], [2.5]]]),
    ],
)
def test_types_of_a_field(spark, value, types, rows):
    got_types, got_rows, wrapped = table(spark, value)
    assert got_types == types and [r["v"] for r in got_rows] == rows and not wrapped


# Inputs of our own: kinds that meet at several depths, numbers at the edges, texts that look like other kinds.
@pytest.mark.parametrize(
    ("value", "types", "rows"),
    [
        ([{"v": "null"}, {"v": None}, {"v": "true"}], {"v": "string"}, ["null", None, "true"]),
        ([{"v": 0.0}, {"v": -0.0}, {"v": 1e300}], {"v": "double"}, [0.0, -0.0, 1e300]),
        ([{"v": [{"a": 1}, {"b": "x"}]}, {"v": []}], {"v": "array<struct<a:bigint,b:string>>"}, [[{"a": 1, "b": None}, {"a": None, "b": "x"}], []]),
        ([{"v": {"x": {"y": [1, 2]}}}, {"v": {"x": None}}], {"v": "struct<x:struct<y:array<bigint>>>"}, [{"x": {"y": [1, 2]}}, {"x": None}]),
        ([{"v": [[], [None]]}, {"v": [["t"]]}], {"v": "array<array<string>>"}, [[[], [None]], [["t"]]]),
        ([{"v": {"k": [1, {"z": 2}]}}], {"v": "struct<k:array<string>>"}, [{"k": ["1", '{"z":2}']}]),
        ([{"v": -1}, {"v": -(2**63) - 1}], {"v": "string"}, ["-1", str(-(2**63) - 1)]),
        ([{"v": "é\u2028\"\\"}], {"v": "string"}, ["é\u2028\"\\"]),
    ],
)
def test_types_where_kinds_meet(spark, value, types, rows):
    got_types, got_rows, wrapped = table(spark, value)
    assert got_types == types and [r["v"] for r in got_rows] == rows and not wrapped


# Fixed values, as above.
@pytest.mark.parametrize(
    ("value", "types", "rows"),
    [
        ([1, 2, 3], "bigint", [1, 2, 3]),
        (["a"], "string", ["a"]),
        ([[1, 2]], "array<bigint>", [[1, 2]]),
        ([1, "two", 3.0], "string", ["1", "two", "3.0"]),
        ({}, "string", ["{}"]),
        ([], "string", []),
        ([{}, {}], "string", ["{}", "{}"]),
        ([{"a": 1}, 2], "string", ['{"a":1}', "2"]),
        ([None, None], "string", [None, None]),
    ],
)
def test_roots_that_are_no_objects_give_one_column(spark, value, types, rows):
    got_types, got_rows, wrapped = table(spark, value)
    assert got_types == {"value": types} and [r["value"] for r in got_rows] == rows and wrapped


def test_null_records_missing_and_late_keys(spark):
    rows = [None] + [{"a": 1}] * 300 + [{"b": {"z": 1, "y": "x"}}]
    types, got, _ = table(spark, rows)
    assert types == {"a": "bigint", "b": "struct<y:string,z:bigint>"}
    assert got[0] == {"a": None, "b": None} and got[-1] == {"a": None, "b": {"y": "x", "z": 1}}


def test_keys_that_differ_in_case_alone(spark):
    types, got, _ = table(spark, [{"A": 1, "a": "x"}])
    assert types == {"A": "bigint", "a": "string"} and got == [{"A": 1, "a": "x"}]


def test_depth_limit_keeps_text(spark):
    _, got, _ = table(spark, [{"a": {"b": {"c": {"d": 1}}}, "e": {}}], max_depth=2)
    assert json.loads(got[0]["a"]["b"]) == {"c": {"d": 1}}


def test_a_field_named_value_is_no_wrapper(spark):
    assert table(spark, [{"value": 1}])[2] is False


def test_scalar_root_is_refused(spark):
    with pytest.raises(ValueError):
        build_table(from_text(spark, "42"))


def test_own_inference_agrees_with_sparks_where_that_is_used(spark):
    rng = random.Random(3)

    def value(depth):
        kind = rng.choice(["int", "float", "str", "bool", "null", "obj", "arr"] if depth else ["int", "str", "null"])
        if kind == "obj":
            return {k: value(depth - 1) for k in rng.sample("abcd", rng.randint(1, 3))}
        if kind == "arr":
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return {"int": rng.randint(-99, 99), "float": rng.choice([0.5, 2.25]), "str": rng.choice(["x", "", "é\n\"q\""]), "bool": rng.random() < 0.5, "null": None}[kind]

    for _ in range(12):
        data = [{"r": value(3), "s": value(2)} for _ in range(8)]
        own = from_value(spark.newSession(), data)
        facts = collect_facts(own.raw)
        a, b = build_table(own), build_table(own, facts=facts)
        assert a.df.dtypes == b.df.dtypes
        assert [r.asDict(True) for r in a.df.collect()] == [r.asDict(True) for r in b.df.collect()]


def test_large_array_file_is_split(spark, tmp_path):
    data = [{"id": i, "v": i + 0.5 if i == 4000 else i} for i in range(4001)]
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(data))
    built = build_table(from_file(spark, str(path), stream_min_bytes=0))
    assert dict(built.df.dtypes) == {"id": "bigint", "v": "double"}
    assert built.df.selectExpr("count(*)", "sum(id)", "max(v)").first() == (4001, sum(range(4001)), 4000.5)


def test_json_lines(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"a":1}\n\n{"a":2}\n')
    assert sorted(r.a for r in build_table(from_file(spark, str(path))).df.collect()) == [1, 2]


@pytest.mark.parametrize("text", ["[1,2", "[1 2]", "[1,]", "[NaN]", "[1] 2", "{}", "[1,Infinity]", "[", "[,1]", ""])
def test_element_texts_is_strict(text):
    with pytest.raises(J.InvalidJson):
        list(J.element_texts(text))


@pytest.mark.parametrize("text", ["[]", " [ 1 , \"a,]\" , {\"x\":[1,{}]} ] ", "[[[]],null,true,1e5]", b"\xef\xbb\xbf[1]"])
def test_elements_equal_the_decoded_array(text):
    assert list(J.iter_elements(text)) == json.loads(text if isinstance(text, str) else text.decode("utf-8-sig"))


def test_paths():
    data = {"a": {"b": [{"c": 1}, {"c": None}]}}
    assert J.walk_path(data, "$.a.b.0.c") == 1 and J.walk_path(data, "a.b[]") == data["a"]["b"] and J.walk_path(data, "$") is data
    for bad in ("$.a.x", "$.a.b.7", "$.a.b.0.c.d", "$.a.b.1.c"):
        with pytest.raises(ValueError):
            J.walk_path(data, bad)
