import pytest

from tessera.operators.facts import collect_facts
from tessera.operators.stats import compact_report, report, size_text, stats_of
from tessera.operators.structure import Samples, print_schema, root_shape
from tessera.plans.profiler import Profiler
from tessera.sources.records import from_value


def facts_of(spark, value, **options):
    return collect_facts(from_value(spark, value).raw, **options)


def schema(spark, value, k=0, **options):
    facts = facts_of(spark, value)
    root = "array" if isinstance(value, list) else "object"
    return print_schema(root_shape(facts, root, len(value)), Samples(facts, k, **options))


def test_notation(spark):
    assert schema(spark, [{"a": 1, "b": None}, {"a": 2, "b": "x"}]) == "[{a: int, b: str?}]"
    assert schema(spark, [{"a": 1}, {"a": "x"}]) == "[{a: str | int}]"
    assert schema(spark, [1, "a", None]) == "[str | int | null]"
    assert schema(spark, {"e": {}, "l": [], "n": None}) == "{\n  e: {}\n  l: []\n  n: null\n}"
    assert schema(spark, [{"select": 1, "a-b": 2}]) == "[{`a-b`: int, `select`: int}]"
    assert schema(spark, [{"x": [[1], [2.5]]}]) == "[{x: [[int | float]]}]"


def test_key_of_the_last_record_is_shown(spark):
    assert "late" in schema(spark, [{"a": 1}] * 500 + [{"late": 1}])


def test_enumerations_dates_and_samples(spark):
    rows = [{"s": "ab"[i % 2], "d": "2024-05-01T10:00:00Z", "u": f"text {i}"} for i in range(10)]
    text = schema(spark, rows, k=3, enum_max=12)
    assert 's: str one of ["a", "b"]' in text and 'd: str (ISO date) samples=["2024-05-01T10:00:00Z"]' in text and "u: str samples=[" in text


def test_few_values_are_all_shown_in_order(spark):
    assert facts_of(spark, [{"v": 3}, {"v": 1}, {"v": 2}]).values((".v",)) == [3, 1, 2]


def test_samples_are_the_same_again(spark):
    data = [{"v": i} for i in range(400)]
    assert facts_of(spark, data).values((".v",)) == facts_of(spark, data).values((".v",))


def test_array_counts(spark):
    shape = root_shape(facts_of(spark, [{"x": [1, "a"]}, {"x": []}, {"x": [1, 2]}]), "array", 3)
    x = shape.item.fields["x"]
    assert x.lengths == (0, 2) and x.items == {"str": (0, 1), "int": (0, 2)}


def test_max_keys_and_depth(spark):
    facts = facts_of(spark, {"a": {"b": {"c": 1}}, "d": 1, "e": 2})
    assert list(root_shape(facts, "object", 1, max_keys=2).fields) == ["a", "d"]
    assert root_shape(facts, "object", 1, depth=1).fields["a"].cut


def brute(value, path="$", out=None):
    out = {} if out is None else out
    out.setdefault(path, []).append(value)
    if isinstance(value, dict):
        for k, v in value.items():
            brute(v, f"{path}.{k}", out)
    elif isinstance(value, list):
        for v in value:
            brute(v, path + "[]", out)
    return out


def test_statistics_equal_brute_force(spark):
    data = [{"n": i if i % 3 else None, "s": "x" * (i % 4), "a": list(range(i % 3)), "o": {"f": i / 2, "t": i % 2 == 0}} for i in range(40)]
    result = stats_of(facts_of(spark, data), "array", len(data))
    want = brute(data)
    assert set(result.field_stats) == set(want)
    for path, values in want.items():
        f = result.field_stats[path]
        assert f.total_seen == len(values) and f.null_count == sum(v is None for v in values)
        numbers = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
        if numbers:
            assert (f.numbers.low, f.numbers.high, f.numbers.total) == (min(numbers), max(numbers), sum(numbers))
        texts = [v for v in values if isinstance(v, str)]
        if texts:
            assert (f.strings.low, f.strings.high, f.strings.total, f.strings.empty) == (min(map(len, texts)), max(map(len, texts)), sum(map(len, texts)), texts.count(""))
        assert f.bool_true_count == sum(v is True for v in values)
    assert result.total_values == sum(map(len, want.values())) and result.max_depth == 3
    assert result.field_stats["$[].o"].key_counts == {"f": 40, "t": 40}
    import json

    assert result.total_size_bytes == pytest.approx(len(json.dumps(data, separators=(",", ":"))), rel=0.02)


def test_reports(spark):
    result = stats_of(facts_of(spark, [{"a": 1, "b": True, "c": None, "d": "x", "e": [], "f": {}}]), "array", 1)
    text = report(result)
    assert text.startswith("JSON STATISTICS") and "Total values: 8 = 2 objects + 2 arrays + 4 primitives" in text and str(result).startswith("JSON STATISTICS")
    assert "true: 1 of 1" in text and "numbers: 1 to 1" in text and 'values: 1 different: "x"' in text and "elements: 0 to 0, mean 0, none in 1" in text
    assert "6 more paths are smaller" in report(result, top_n=2) and "bool: 1 in 1 paths, 1 true" in compact_report(result)
    sparse = stats_of(facts_of(spark, [{"a": 1}, {"a": 2, "b": 3}]), "array", 2)
    assert "not in all: b (1)" in report(sparse)


def test_progress_follows_the_partitions(spark):
    told = []
    with Profiler(spark=spark) as profiler:
        profiler.analyze([{"v": i, "w": ["x"] * 50} for i in range(3000)], progress=lambda done, n: told.append((done, n)))
        assert profiler.timing()["sample_time"] > 0
    assert told[0] == (0, 3000) and told[-1] == (3000, 3000) and told == sorted(told)


def test_unique_limit(spark):
    result = stats_of(facts_of(spark, [{"v": i} for i in range(300)], max_unique=20), "array", 300)
    assert len(result.field_stats["$[].v"].unique_values) == 20


@pytest.mark.parametrize(("n", "text"), [(5, "5 B"), (2048, "2.00 KB"), (5 << 20, "5.00 MB"), (3 << 30, "3.00 GB")])
def test_size_text(n, text):
    assert size_text(n) == text
