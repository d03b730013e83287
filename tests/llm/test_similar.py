"""Near-duplicates by similarity: the wide sketches and their tries, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import similar_texts as similar
from tests.llm.test_pairs import components


def shingles(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for w in "\t\n\x0b\x0c\r":
        words = words.replace(w, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x or y else 1.0


def corpus(n=300, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(3000)] + ["é", "x" * 100, "x" * 101]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(60, 400))) for _ in range(n)]
    for i in range(n // 2):
        words = texts[i].split()
        for _ in range(max(1, int(len(words) * rng.choice([0.005, 0.01, 0.02])))):
            words[rng.randrange(len(words))] = f"new{rng.random()}"
        texts += [" ".join(words), texts[i].lower().replace(" ", "\n")]
    return texts


def distances(fps):
    words = fps.view(np.uint64)
    return np.bitwise_count(words[:, None] ^ words[None]).sum(axis=2)


def test_sketches_follow_the_shingles():
    texts = corpus(40) + [None, "", " \n", "one", "one two", "ONE two", "a b c d e", "a b c d e " * 5000, "\x1c a"]
    fps = similar.sketches(pa.array(texts))
    same = distances(fps) == 0
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            if shingles(a) == shingles(b):
                assert same[i, j]
            elif not {a, b} & {texts[-1]}:
                assert not same[i, j] or jaccard(a, b) > 0.9
    assert (similar.sketches(pa.array(texts, pa.large_string()).slice(3, 9)) == fps[3:12]).all() and similar.sketches(pa.array([], pa.string())).shape == (0, 32)
    assert not fps[texts.index("")].any() and similar.sketches(pa.array(["a b", "b a"]), 1)[0].tobytes() == similar.sketches(pa.array(["a b", "b a"]), 1)[1].tobytes()


@pytest.mark.parametrize("group", [0, 400])
def test_cell_forest_equals_all_pairs(monkeypatch, group):
    """Without the early errors' limit the walk is exact, whatever the pivots have linked before."""
    monkeypatch.setattr(similar, "EARLY_ERRORS", 64)
    rng = np.random.default_rng(group)
    fps = rng.integers(0, 256, (300, 32)).astype(np.uint8)
    bits = np.unpackbits(fps, axis=1)
    near = bits[rng.integers(0, 40, 200)] ^ (rng.random((200, 256)) < 0.15)
    dense = np.tile(bits[:1], (group, 1)) ^ (rng.random((group, 256)) < 0.12)
    fps = np.unique(np.packbits(np.concatenate([bits, near, dense]).astype(np.uint8), axis=1), axis=0)
    keys = similar.trie_keys(fps, 3)
    order = np.argsort(keys)
    fps, keys = fps[order], keys[order]
    budget = similar.bit_budget(0.8)
    want = components(range(len(fps)), np.argwhere(np.triu(distances(fps) <= budget, 1)).tolist())
    words = fps.view(np.uint64)
    u, v = similar.cell_forest(words, None, keys, None, budget, 0)
    assert components(range(len(fps)), zip(u.tolist(), v.tolist(), strict=True)) == want
    side = np.arange(len(fps)) % 2 == 0
    a, b = np.flatnonzero(side), np.flatnonzero(~side)
    place = np.concatenate([a, b])
    links = []
    for one, other in ((a, None), (b, None), (a, b)):
        u, v = similar.cell_forest(words[one], None if other is None else words[other], keys[one], None if other is None else keys[other], budget, 0)
        where = one if other is None else place
        links += zip(where[u].tolist(), where[v].tolist(), strict=True)
    assert components(range(len(fps)), links) == want


@pytest.mark.parametrize("largest", [20, 4096])
def test_components_equal_brute_force(spark, monkeypatch, largest):
    monkeypatch.setattr(similar, "LARGEST", largest)
    monkeypatch.setattr(similar.similar_edges, "__defaults__", (similar.SIMILARITY, largest))
    texts = corpus()
    docs = spark.createDataFrame([(i * 3 + 1, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, component int").repartition(5)
    got = {r.id: r.component for r in similar.similar_components(docs).collect()}
    near = np.argwhere(np.triu(distances(similar.sketches(pa.array(texts))) <= similar.bit_budget(0.8), 1))
    assert got == components(got, [(a * 3 + 1, b * 3 + 1) for a, b in near.tolist()])
    pairs = [(a, b) for a in range(len(texts)) for b in ((a * 2 + 300, a * 2 + 301) if a < 150 else ())]
    alike = [(a, b) for a, b in pairs if jaccard(texts[a], texts[b]) >= 0.8]
    assert len(alike) > 150 and sum(got[a * 3 + 1] == got[b * 3 + 1] for a, b in alike) >= 0.97 * len(alike)
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, c in got.items() if i == c}
    assert all(got[i * 3 + 1] == i * 3 + 1 for i in range(300))  # texts of their own


def test_edges(spark):
    long = "many words " * 60_000
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "other words are here now then"), (2, "other words are here now then"), (7, None), (9, ""), (8, " \n"), (3, long), (4, long + "."), (6, "q"), (6, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.id, r.component) for r in similar.similar_components(docs).collect()), key=str)
    want = [(None, None), (5, 2), (5, 2), (2, 2), (7, 7), (9, 7), (8, 7), (3, 3), (6, 6), (6, 6)]
    assert [x for x in got if x[0] != 4] == sorted(want, key=str)
    assert similar.similar_components(docs.limit(0)).count() == 0 and similar.drop_similar(docs.limit(0)).columns == docs.columns
    assert similar.drop_similar(docs).where("doc_id is null").count() == 1
