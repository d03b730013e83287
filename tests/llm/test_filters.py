"""URL rules, benchmark passages, line dedup, licences: against plain Python."""

import hashlib
import math
import os
import random
import re

import duckdb
import numpy as np
import pytest

from tessera.llm import decontaminate, licenses, line_dedup, url_filter

# ---- URL rules


def slow_url(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    None, "", "x", "://", "http://", "http://com/", "http://com", "http://a.com/x?y#z", "https://Example.COM/en/1", "https://www.example.com/en/", "https://www.example.com/EN/", "http://notexample.com/en/", "http://xcom/", "http://a.net/es/1", "http://a.net/fr/", "http://net/es/", "http://a.net/de/", "http://a.org/en/",
    "http://a.com?/en/", "http://a.com#/x", "http://u:p@a.com:80/x", "a://b://c.com/x", "http://é.com/ü/", "http://ÄB.com/", "http://" + "a." * 20_000 + "com/" + "x/" * 20_000, "http://a.net/es/\n?q", "http://.com/", "http://..net/fr/x", "http://example.com/en", "http://sub.www.example.com/en/q",
]


@pytest.mark.parametrize("rules", [url_filter.RULES, [], [("block", "a.com", ""), ("allow", "com", "/x"), ("block", "it's.com", "/'")], [("block", f"h{i}.com", f"/p{i % 7}") for i in range(300)] + [("allow", "com", "/")]])
def test_urls(spark, rules):
    urls = URLS + [f"http://w.h{i}.com/p{i % 9}/x" for i in range(0, 400, 3)]
    pages = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, key string")
    got = {r.page_id: (r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {i: slow_url(u, rules) for i, u in enumerate(urls)}


def test_cascade_is_exact_on_its_universe(spark):
    listed = spark.range(0, 400).selectExpr("concat('k', id) as key")
    universe = spark.range(0, 30_000).selectExpr("concat('k', id) as key")
    cascade = url_filter.Cascade(listed, universe, "t")
    assert len(cascade.levels) >= 2
    from pyspark.sql import functions as F

    assert {r.key for r in universe.where(cascade.contains(F.col("key"))).collect()} == {f"k{i}" for i in range(400)}


def test_a_long_list_makes_no_long_plan(spark):
    rng = random.Random(4)
    rules = list({(rng.choice(["block", "allow"]), f"{'x' * rng.randint(1, 30)}{i}.com", "/" + "p" * rng.randint(0, 9)) for i in range(3000)})
    urls = [f"http://{'www.' * (i % 2)}{rules[i % 3000][1]}{rules[i % 3000][2]}{'q' * (i % 3)}" for i in range(0, 4000, 7)] + ["http://none.of.these/"]
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id long, url string, __rule string, __host int")
    found = url_filter.filter_urls(pages, rules)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 200_000
    assert {r.page_id: (r["__host"], r["__path"], r["__rule"], r["__verdict"]) for r in found.collect()} == {i: slow_url(u, rules) for i, u in enumerate(urls)}


def test_no_pages(spark):
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    plan = url_filter.filter_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Join|Cartesian", plan)


# ---- line dedup


def slow_lines(rows):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(first.get(key(line), i), i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if first.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def line_rows():
    rng = random.Random(1)
    pool = ["a shared line of text", " A SHARED line of text\t", "short", "123456789", "1234567890", "ééééééééé", "éééééééééé", "ÉÉÉÉÉÉÉÉÉÉ", "", "  ", "\u00a0padded by other space\u00a0", "padded by other space"] + [f"line number {i} here" for i in range(25)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 9)))) for i in range(0, 90, 2)]
    return rows + [(1, None), (3, ""), (5, "only here once, only here\nonly here once, only here"), (7, "line number 1 here\r\nline number 1 here\n"), (9, "x" * 300_000 + "\n" + "x" * 300_000)]


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_lines(spark, batches):
    rows = line_rows()
    docs = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n_lines int, key string").repartition(3)
    want = slow_lines(rows)
    got = {r.id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.dedup_lines(docs, batches=batches, digest_only=True).collect()}
    assert got == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in want}
    full = line_dedup.dedup_lines(docs, batches=batches)
    assert full.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.key) for r in full.collect()} == {i: (t, n, d, "k") for i, n, d, t in want}


def test_lines_edges(spark):
    schema = "doc_id long, text string"
    assert line_dedup.dedup_lines(spark.createDataFrame([], schema)).count() == 0
    line = "the very same line"
    rows = [(None, line), (4, line), (2, line), (2, line + "\nother line of two")]
    got = sorted((str(r.doc_id), r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted([("None", line), ("4", ""), ("2", line), ("2", line + "\nother line of two")])


def test_runs_are_compacted_and_incremental(spark):
    runs = line_dedup.LineRuns(spark)
    for b in range(7):
        keys = spark.createDataFrame([(b * 10 + i, bytes([i % (3 + b)])) for i in range(9)], "id long, key binary")
        repeats = runs.add(keys).count()
        assert repeats == 9 - (3 if b == 0 else 1)
    assert all(len(level) < line_dedup.FANOUT for level in runs.levels) and len(runs.runs()) < 7
    assert sum(run.count() for run in runs.runs()) == 9
    runs.close()
    assert not runs.runs()


def test_runs_are_read_as_they_lie(spark):
    """No exchange and no sort stands above a run when a batch meets it."""
    runs = line_dedup.LineRuns(spark)
    for b in range(2):
        runs.add(spark.createDataFrame([(i, bytes([i])) for i in range(b * 30, b * 30 + 50)], "id long, key binary"))
    keys = line_dedup.materialize(spark.createDataFrame([(i, bytes([i])) for i in range(60, 100)], "id long, key binary"), "keys")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    with line_dedup._sorted_scans(spark):
        marked = runs.marked(keys)
        marked.collect()
        plan = marked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    scans = [i for i, x in enumerate(lines) if "Scan parquet" in x and "tessera_run" in x]
    assert len(scans) == 2 and plan.count("SortMergeJoin") == 2
    depth = lambda x: len(x) - len(x.lstrip(" :+-*0123456789()|"))
    for i in scans:
        at, below = i, depth(lines[i])
        while "SortMergeJoin" not in lines[at]:  # upwards along the run's own branch
            at -= 1
            if depth(lines[at]) < below:
                below = depth(lines[at])
                assert "Exchange" not in lines[at] and "Sort [" not in lines[at], plan
    assert {r.first for r in marked.where("known").collect()} == set(range(60, 80))
    runs.close()


def test_lines_sql(spark):
    docs = [(i, t) for i, t in line_rows()]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = {r[0]: r[1:] for r in con.sql("SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM (" + line_dedup.OP5_SQL + ")").fetchall()}
    assert want == {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in slow_lines(docs)}


# ---- benchmark passages


def slow_passages(docs, items):
    found = set()
    for d, text in docs:
        own = decontaminate.words(text)
        for k, item in items:
            it = decontaminate.words(item)
            need = min(decontaminate.WINDOW, len(it))
            if len(it) < decontaminate.LEAST_WORDS:
                continue
            share = 1.0 if len(it) < decontaminate.WINDOW else decontaminate.SIMILARITY
            for start in range(-len(it) + 1, len(own)):
                a, b = max(0, start), min(len(own), start + len(it))
                same = [own[p] == it[p - start] for p in range(a, b)]
                if any(sum(same[i : i + need]) >= share * need - 1e-9 for i in range(len(same) - need + 1)):
                    found.add((d, k))
                    break
    return found


def test_passages_equal_brute_force(spark):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(60)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(4, 40)))) for k in range(12)] + [(50, None), (51, ""), (52, "a b"), (None, "x y z u v w q r")]
    docs = []
    for d in range(80):
        words = rng.choices(vocabulary + ["other"] * 20, k=rng.randint(0, 80))
        if d % 2:
            part = (items[d % 12][1]).split()
            for _ in range(len(part) // 8 * (d % 3)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = part[: rng.choice([len(part), 14])]
        docs.append((d, (" ".join(words)).title() + "!"))
    docs += [(100, None), (101, ""), (102, "z " * 50_000 + items[3][1])]
    own = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(own, bench).collect()
    want = slow_passages(docs, [i for i in items if i[0] is not None and i[1]])
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert all(0 <= r.start_word < r.end_word and r.similarity >= 0.75 for r in got)
    kept = {r.doc_id for r in decontaminate.remove_contaminated(own, bench).collect()}
    assert kept == {d for d, _ in docs} - {r.doc_id for r in got}


def test_substitutions_at_every_place(spark):
    item = [f"t{i}" for i in range(25)]
    docs = []
    for step in (5, 6, 7):
        for shift in range(step):
            docs.append((len(docs), " ".join("changed" if i % step == shift else w for i, w in enumerate(item))))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {d for d, _ in docs}


def test_every_window_holds_a_seed():
    """All ways in which a window can differ in as many words as it may."""
    from itertools import combinations

    may = decontaminate.WINDOW - int(np.ceil(decontaminate.SIMILARITY * decontaminate.WINDOW))
    item = [f"t{i}" for i in range(decontaminate.WINDOW)]
    index = decontaminate.SeedIndex([(1, " ".join(item))])
    for gone in combinations(range(decontaminate.WINDOW), may):
        ids = np.array([0 if i in gone else index.vocabulary[f"t{i}".encode()] for i in range(decontaminate.WINDOW)])
        hits = index.hits(ids, np.array([0]))
        assert hits.shape[1] and index.verify(ids, 0, len(ids), 0, 0)


@pytest.mark.parametrize("parts", [1, 7, 81])
def test_passages_do_not_depend_on_partitions(spark, parts):
    rng = random.Random(12)
    item = " ".join(f"i{k}" for k in range(200))
    docs = [(k, " ".join(rng.choices(["some", "short", "other"], k=rng.randint(0, 9)))) for k in range(80)] + [(99, " ".join(item.split()[80:110])), (98, " ".join(item.split()[:13]))]
    rng.shuffle(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = decontaminate.contaminated(table, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word, r.n_same) for r in got) == [(98, 0, 13, 13), (99, 0, 30, 30)]


def test_passages_edges(spark):
    docs = spark.createDataFrame([(None, "one two three four five six seven"), (1, "nothing of it")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "one two three four five six seven")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()] == [(None, 9)]
    assert [r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()] == [1]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_excerpts_from_the_middle_of_an_item_between_other_documents(spark):
    item = [f"t{i}" for i in range(40)]
    texts, want = [], {}
    for a in range(0, 28):
        for n in (13, 20, 40):
            part = item[a : a + n]
            if len(part) >= 13:
                texts += [" ".join(f"other{j}" for j in range(60)), " ".join(part)]
                want[len(texts) - 1] = (0, len(part), len(part))
    texts.append("the last one")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontaminate.contaminated(docs, bench).collect()
    assert {r.doc_id: (r.start_word, r.end_word, r.n_same) for r in got} == want and len(got) == len(want)
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, bench).collect()} == set(range(len(texts))) - set(want)


def test_many_items_take_several_scans(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(14))) for k in range(4)]
    docs = spark.createDataFrame([(k, f"before {t} after") for k, t in items], "doc_id long, text string")
    got = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(4)]


# ---- licences

FILES = [
    (1, "a/LICENSE", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "MIT", "own"),
    (2, "a/x.txt", "plain words here", "MIT", "inherited"),
    (3, "a/b/c/y.txt", None, "MIT", "inherited"),
    (4, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3.", "GPL-3.0", "own"),
    (5, "a/b/z.txt", "", "GPL-3.0", "inherited"),
    (6, "a/b/own.py", "# Licensed under the Apache License, Version 2.0.\nimport os", "Apache-2.0", "own"),
    (7, "other/q.txt", "the license of this is not told anywhere", None, None),
    (8, None, "Released under the MIT License.", "MIT", "own"),
    (9, None, "text", None, None),
    (10, "ab/LICENSE.md", "Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", "own"),
    (11, "abc/x", "word " * 30_000 + "\nReleased under the MIT License.\n" + "word " * 30_000, "MIT", "own"),
    (12, "ab", "text", None, None),
]


def test_licenses(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame([(i, p, t, "clash") for i, p, t, _, _ in FILES], "doc_id long, path string, text string, license string").repartition(4)
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan_licenses(files, F.col("path")).collect()}
    expected = {i: (x, o) for i, _, _, x, o in FILES}
    expected[3] = ("GPL-3.0", "inherited")  # the nearest directory, a/b, has a licence file too
    assert got == expected


def test_license_edges(spark):
    from pyspark.sql import functions as F

    files = spark.createDataFrame([], "doc_id long, path string, text string")
    assert licenses.scan_licenses(files, F.col("path")).count() == 0
    root = spark.createDataFrame([(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c", "x"), (None, "a/d", "x"), (2, "a/b/c", "x")], "doc_id long, path string, text string")
    assert sorted(str((r.doc_id, r.license)) for r in licenses.scan_licenses(root, F.col("path")).collect()) == sorted(["(1, 'MIT')", "(2, 'MIT')", "(2, 'MIT')", "(None, None)"])


MIT_HEADER = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD_HEADER = """Copyright (c) 2020, Some Body. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Neither the name of the author nor the names of its contributors may be used."""
GPL_HEADER = """Some program, which does this and that for everyone who needs it.
This work is licensed under the GNU General
Public License, version 3. It comes with documentation, examples and a test
suite of many parts."""


@pytest.mark.parametrize("header, name", [(MIT_HEADER, "MIT"), (BSD_HEADER, "BSD-3-Clause"), (GPL_HEADER, "GPL-3.0")])
@pytest.mark.parametrize("mark", ["", "// ", " * ", "# ", "-- "])
def test_wrapped_headers(header, name, mark):
    common = {b"the": 45_000, b"of": 44_000, b"and": 44_000, b"to": 44_000, b"in": 43_000, b"this": 30_000, b"is": 40_000, b"a": 45_000}
    text = "\n".join((mark + line).rstrip() for line in header.split("\n")) + "\n\nint main() { return 0; }\n"
    got = licenses.Matcher(50_000, common).scan("/*\n" + text + " */" if mark == " * " else text)
    assert got and got[1] == name


def test_signal_filter_is_exact():
    matcher = licenses.Matcher(1000, {b"the": 900, b"of": 800, b"under": 300})
    full = licenses.Matcher(1000, {b"the": 900, b"of": 800, b"under": 300})
    full.signal = set(licenses._VOCABULARY)
    rng = random.Random(2)
    vocabulary = [w for w in licenses._VOCABULARY]
    for _ in range(3000):
        own = rng.choices(vocabulary, k=rng.randint(1, 12)) if rng.random() < 0.5 else decontaminate.words(rng.choice(licenses.TEMPLATES)[1])[: rng.randint(1, 30)]
        assert matcher.best(own) == full.best(own)


def slow_license(text, n, frequencies):
    """Cosines by the textbook, of every part and every run as long as a template, without any filter or bound."""
    known = {w for _, t in licenses.TEMPLATES for w in decontaminate.words(t)}
    weight = lambda w: 1 + math.log((n + 1) / ((frequencies.get(w, 0) if w in known else 0) + 1))

    def vector(own):
        out = {}
        for w in own:
            out[w] = out.get(w, 0.0) + weight(w)
        return out

    def cosine(a, b):
        dot = sum(x * b.get(w, 0.0) for w, x in a.items())
        return dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a and b else 0.0

    lines = text.split("\n")
    joined = " ".join(" ".join(re.sub(r"^\s*(//|#|--|;)?\s*", "", x) for x in lines).split())
    parts = [*lines, joined, *re.split(r"\n\s*\n", text)]
    for x in (*lines, joined):
        parts += re.split(r"(?<=[.;])\s+", x)
    own = decontaminate.words(joined)
    found = [(cosine(vector(decontaminate.words(x)), vector(decontaminate.words(t))), name) for x in parts for name, t in licenses.TEMPLATES]
    for name, t in licenses.TEMPLATES:
        size = min(len(own), len(decontaminate.words(t)))
        found += [(cosine(vector(own[i : i + size]), vector(decontaminate.words(t))), name) for i in range(len(own) - size + 1)]
    return max(found, key=lambda x: x[0])


def test_licenses_equal_textbook_cosines():
    rng = random.Random(14)
    frequencies = {b"the": 800, b"of": 790, b"this": 500, b"is": 600, b"a": 900, b"to": 800, b"license": 60, b"licensed": 30, b"work": 90}
    matcher = licenses.Matcher(1000, frequencies)
    filler = ["the", "of", "a", "license", "work", "data", "free", "source", "water", "house", "under", "use"]
    found = 0
    for k in range(120):
        words = rng.choices(filler, k=rng.randint(0, 25))
        if k % 3:
            part = [w if rng.random() > 0.12 * (k % 4) else "changed" for w in rng.choice(licenses.TEMPLATES)[1].split()]
            at = rng.randint(0, len(words))
            words[at:at] = part
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randint(0, len(words)), rng.choice(["\n", "\n\n", "\n# "]))
        text = " ".join(words).replace(" \n ", "\n")
        cosine, name = slow_license(text, 1000, frequencies)
        got = matcher.scan(text)
        if abs(cosine - licenses.LEAST_COSINE) > 1e-9:
            assert (got is not None) == (cosine >= licenses.LEAST_COSINE), text
        if got:
            assert got[0] == pytest.approx(cosine)
            found += 1
    assert 40 < found < 110


def test_inheritance_equals_a_walk(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    folders = ["", "a", "a/b", "a/b/c", "a/d", "e", "e/f/g/h"]
    stated = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", None: "nothing of the kind"}
    rows = []
    for i in range(150):
        name = rng.choice(["LICENSE", "COPYING.txt", "x.py", "y.md", "my-license"]) if i < 12 else f"f{i}"
        rows.append((i, "/".join(x for x in (rng.choice(folders), name) if x), stated[rng.choice([*stated, None, None])]))
    own = {i: next((k for k, v in stated.items() if v == t), None) for i, _, t in rows}
    given = {}
    for i, path, _ in rows:
        folder, _, name = path.rpartition("/")
        if name in ("LICENSE", "COPYING.txt") and own[i]:
            given.setdefault(folder, []).append(own[i])
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(5), F.col("path")).collect()}
    for i, path, _ in rows:
        if own[i]:
            assert got[i] == (own[i], "own")
            continue
        folder = path.rpartition("/")[0]
        while folder not in given and folder:
            folder = folder.rpartition("/")[0]
        assert got[i][1] == ("inherited" if folder in given else None) and (got[i][0] in given.get(folder, [None]))
    assert {o for _, o in got.values()} == {"own", "inherited", None} or len(given) > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are needed")
def test_license_query_inherits(spark):
    got = {r.origin: r.n for r in licenses.op10_licenses(spark, "/root/testdata/sf0.01").groupBy("origin").count().withColumnRenamed("count", "n").collect()}
    assert got["own"] and got["inherited"] and got[None] > got["inherited"], got
