"""Near-duplicates of embeddings and texts, against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import hnsw, simhash
from tessera.llm.shared import connected_components, local_forest


def components(ids, links):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(5, 4), (4, 3), (3, 2), (2, 1)], [(1, 2), (3, 4), (2, 3), (7, 7), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges or [(None, 1)], "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])


def test_local_forest():
    rng = np.random.default_rng(1)
    u, v = rng.integers(0, 300, 250), rng.integers(0, 300, 250)
    node, low = local_forest(u, v)
    want = components(set(u) | set(v), zip(u, v, strict=True))
    assert {**{i: i for i in want}, **dict(zip(node, low, strict=True))} == want and len(node) < len(want)


# ---- SimHash


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for w in "\t\n\x0b\x0c\r":
        words = words.replace(w, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One TWO", "a b c d e a b c", "ÄÖ ß É words here", "x " * 20_000, "non\u00a0breaking\u2003space stays one", "\x1c\x1d a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def near(fps, budget=3):
    return {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= budget}


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_finds_all_pairs(seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(60)]
    fps = set(base) | {0, 1, (1 << 64) - 1}
    for f in base[:30]:
        for _ in range(rng.randint(1, 8)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                f ^= 1 << b
            fps.add(f)
    a = np.array(sorted(fps), np.uint64)
    got = [(int(x), int(y)) for xs, ys in simhash.trie_join(a, None, 0, 0) for x, y in zip(xs, ys, strict=True)]
    assert len(got) == len(set(got)) and set(got) == near([int(x) for x in a])
    left, right = a[a < 1 << 63], a[a >= 1 << 63]
    got = {(int(left[x]), int(right[y])) for xs, ys in simhash.trie_join(left, right, 1, 1) for x, y in zip(xs, ys, strict=True)}
    assert got == {(int(x), int(y)) for x in left for y in right if bin(int(x) ^ int(y)).count("1") <= 3}


@pytest.mark.parametrize("largest", [3, 10_000])
def test_hot_cells_are_dealt_out(spark, largest):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 60:
        fps.add(center ^ sum(1 << b for b in rng.sample(range(48), rng.randint(1, 4))))
    fps |= {rng.getrandbits(64) for _ in range(60)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    got = [(r.u, r.v) for r in simhash.near_edges(df, 4, largest).collect()]
    assert components(range(len(fps)), got) == components(range(len(fps)), near(fps))


def texts_fixture():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 300))) for _ in range(60)]
    for i in range(20):
        words = texts[i].split()
        words[rng.randrange(len(words))] = "changed"
        texts += [" ".join(words), texts[i], texts[i].upper()]
    return texts + ["", " ", None, "x", "X"]


def test_simhash_query_equals_brute_force(spark):
    texts = texts_fixture()
    rows = [(i * 3 + 1, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.simhash_components(docs).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    want = components([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in near(fps)])
    assert got == {r[0]: (f, want[r[0]]) for r, f in zip(rows, fps, strict=True)}
    kept = {r.doc_id for r in simhash.simhash_dedup(docs).collect()}
    assert kept == {i for i, c in want.items() if i == c} and simhash.simhash_dedup(docs).columns == docs.columns


def test_simhash_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "other words are here now"), (2, "other words are here now"), (7, None), (7, None)], "doc_id long, text string")
    got = sorted(((r.id, r.component) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == sorted([(None, None), (5, 2), (5, 2), (2, 2), (7, 7), (7, 7)], key=str)
    empty = simhash.simhash_components(docs.limit(0))
    assert empty.columns == ["id", "fp", "component"] and empty.count() == 0
    assert simhash.simhash_dedup(docs).where("doc_id is null").count() == 1


# ---- embeddings


def brute_vectors(rows):
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = {k: 0 for k in range(len(rows))}
    links = []
    for a in range(len(fine)):
        for b in range(len(fine)):
            x, y = fine[a][1], fine[b][1]
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.9:
                links.append((a, b))
    return fine, links


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(250, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(300 + i, (base[i % 40] + rng.normal(size=16) * 0.25).tolist()) for i in range(120)]
    rows += [(500 + i, base[0].tolist()) for i in range(60)] + [(600, (base[1] * 7).tolist()), (601, None), (602, []), (603, [0.0] * 16), (604, [float("nan")] * 16), (605, [None] + [1.0] * 15), (606, [float("inf")] + [1.0] * 15), (607, [1.0, 2.0]), (608, [2.0, 4.0]), (609, [-0.0, 1.0]), (610, [0.0, 1.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, node string").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    fine, links = brute_vectors(rows)
    count = {i: 0 for i, _ in fine}
    for a, _ in links:
        count[fine[a][0]] += 1
    want = components([i for i, _ in rows], [(fine[a][0], fine[b][0]) for a, b in links])
    got = {r.id: (r.n_links, r.component) for r in hnsw.near_vectors(table).collect()}
    assert got == {i: (count.get(i, 0), want[i]) for i, _ in rows}


def test_vectors_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert hnsw.near_vectors(spark.createDataFrame([], schema)).count() == 0
    only = hnsw.near_vectors(spark.createDataFrame([(1, None), (None, [1.0, 0.0])], schema)).collect()
    assert sorted(map(str, only)) == sorted(["Row(id=1, n_links=0, component=1)", "Row(id=None, n_links=0, component=None)"])
    twice = hnsw.near_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])], schema)).collect()
    assert sorted((r.id, r.n_links, r.component) for r in twice) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_graph_search_has_recall_and_widens():
    rng = np.random.default_rng(2)
    x = hnsw.unit(rng.normal(size=(3000, 24)))
    q = hnsw.unit(x[:400] + rng.normal(size=(400, 24)) * 0.05)
    graph = hnsw.Hnsw(x.astype(np.float32))
    beam = hnsw.audited_beam(graph, x, 0.9, beam=8)
    r, c = hnsw.linked(graph, x, q, 0.9, beam)
    want = np.argwhere(q @ x.T >= 0.9)
    assert len(graph.layers) >= 2 and beam and beam >= 8
    assert len(set(zip(r, c, strict=True))) >= 0.99 * len(want)
    assert set(zip(r, c, strict=True)) <= {tuple(p) for p in want}
    r, c = hnsw.linked(graph, x, q, 0.9, None)  # the scan that follows a failed audit
    assert set(zip(r, c, strict=True)) == {tuple(p) for p in want}


def test_small_shards_use_their_graph(monkeypatch):
    rng = np.random.default_rng(8)
    for n in (1, 2, 5, 40, 125, 500):
        x = hnsw.unit(rng.normal(size=(n, 64)))
        graph = hnsw.Hnsw(x.astype(np.float32))
        assert hnsw.audited_beam(graph, x, 0.9) is not None
        q = hnsw.unit(x + rng.normal(size=x.shape) * 0.02)
        want = {tuple(p) for p in np.argwhere(q @ x.T >= 0.9)}
        assert len(want & set(zip(*hnsw.linked(graph, x, q, 0.9, hnsw.FIRST_BEAM), strict=True))) >= 0.99 * len(want)
    monkeypatch.setattr(hnsw, "AUDIT_RECALL", 1.1)
    assert hnsw.audited_beam(graph, x, 0.9) is None


def test_query_over_shards_of_thousands(spark, tmp_path, monkeypatch):
    """The whole query where graphs, several blocks and several tasks a shard are at work."""
    monkeypatch.setattr(hnsw, "BLOCK_BYTES", 1 << 17)
    monkeypatch.setattr(hnsw, "TASK_BLOCKS", 4)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(5500, 24))
    near = base[rng.integers(0, 1500, 2500)] + rng.normal(size=(2500, 24)) * 0.3
    x = np.concatenate([base, near]).astype(np.float32)
    spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in hnsw.op1_embedding_dedup(spark, str(tmp_path)).collect()}
    unit = hnsw.unit(x.astype(float))
    links = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1))
    count = np.bincount(links.ravel(), minlength=len(x))
    want = components(range(len(x)), links.tolist())
    assert sum(r.n_links for r in got.values()) >= 0.99 * count.sum() and all(r.n_links <= count[i] for i, r in got.items())
    same = sum(got[i].component_id == c for i, c in want.items())
    assert same >= 0.99 * len(x) and all(r.kept == (i == r.component_id) for i, r in got.items())
