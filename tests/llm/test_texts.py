"""Quality, packing, main text, token counts and the pipeline."""

import html
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tessera.llm import html_text, packing, quality, token_counts
from tessera.llm.word_bpe import WordEncoder

STRANGE = ["", "a", " x\ty  z\n\n", "İstanbul ΣΑΣ ß ſ", "naïve cafe\u0301", "漢字 かな 한국", "<|endoftext|> hi<|startoftext|>x", "aaaaaaaaaa AAAA aaa", "it's we'll don't 'S o'clock", "①²³ 1234 $$$!!! a,b", "\x00\x01 \u200b \u2028", "x" * 3000, "the " * 2000, None]


def corpus(n=40, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéü", k=rng.randint(1, 9))) for _ in range(500)]
    return [" ".join(rng.choices(words, k=rng.randint(0, 900))) for _ in range(n)]


# ---- token ids and packing


@pytest.fixture(scope="module")
def path():
    return packing.tokenizer_path()


def test_ids_equal_the_library(path, monkeypatch):
    import tessera.llm.word_bpe as module

    texts = STRANGE + corpus()
    library = Tokenizer.from_file(path)
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in WordEncoder(path).encode(texts)] == want
    monkeypatch.setattr(module, "WORD_BITS", 6)
    monkeypatch.setattr(module, "BLOCK", 500)
    assert [x.tolist() for x in WordEncoder(path).encode(texts)] == want


def check_pieces(rows, want):
    """rows: pieces; want: ids by document. Every id once, sequences without gaps, little padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id]) and r.length > 0
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(want)
    for d, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(want[d])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW and at & (at - 1) == 0  # full, or a power of two


def test_packing(spark, path):
    texts = STRANGE + corpus(60) + ["long words here " * 6000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(3)
    library = Tokenizer.from_file(path)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in enumerate(texts)}
    check_pieces(packing.pack(docs).collect(), want)
    assert packing.pack(docs.limit(0)).count() == 0
    twice = packing.pack(spark.createDataFrame([(None, "a b"), (1, "a"), (1, "a")], "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in twice for _ in range(r.start == 0)) == ["1", "1", "None"]


def test_neighbours_fill_the_seeds_window():
    rng = np.random.default_rng(0)
    common = rng.integers(100, 110, 30)
    docs = [np.concatenate([common, np.full(20, 1000 + k % 4), np.arange(5000 + 10 * k, 5010 + 10 * k)]).astype(np.uint32) for k in range(80)]
    packer = packing.Packer(0, window=600)
    packer.shard(list(range(80)), docs)
    by_sequence = {}
    for doc, *_, sequence, _ in packer.out:
        by_sequence.setdefault(sequence, set()).add(doc % 4)
    assert sum(len(topics) <= 2 for topics in by_sequence.values()) >= len(by_sequence) - 2


def test_bm25_equals_the_formula():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint32) for _ in range(40)]
    shard, q = packing.Bm25Shard(docs), np.unique(docs[7])
    mean = np.mean([len(d) for d in docs])
    for k, d in enumerate(docs):
        want = 0.0
        for t in q:
            df = sum((x == t).any() for x in docs)
            tf = (d == t).sum()
            want += max(0.0, np.log((len(docs) - df + 0.5) / (df + 0.5))) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        assert shard.scores(q)[k] == pytest.approx(want)


def test_like_documents_of_all_partitions_share_windows(spark, path, monkeypatch):
    rng = random.Random(5)
    topics = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(40)] for _ in range(64)]
    rows = [(i, " ".join(rng.choices(topics[i % 64], k=60))) for i in range(640)]  # a run of 64 rows has one of each topic
    monkeypatch.setattr(packing, "SHARD_DOCS", 64)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4)
    by_sequence = {}
    for r in packing.pack(docs, window=1024).collect():
        by_sequence.setdefault(r.sequence_id, []).append(r.doc_id % 64)
    pure = [max(map(t.count, t)) / len(t) for t in by_sequence.values()]
    assert sum(pure) >= 0.5 * len(pure), sum(pure) / len(pure)  # storage order gives 0.27


def test_statistics_are_those_of_all_rows(spark, path):
    texts = corpus(50)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    whole = packing._statistics(packing._encoded(docs, path))
    library = Tokenizer.from_file(path)
    ids = [[*library.encode(t, add_special_tokens=False).ids, packing.END_ID] for t in texts]
    assert whole.n == 50 and whole.mean == sum(map(len, ids)) / 50
    assert {t: n for t, n in enumerate(whole.df.tolist()) if n} == {t: sum(t in d for d in ids) for d in ids for t in d}


# ---- main text

PAGES = [
    ("<html><head><title>t</title><script>var a='</p>';</script><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy this.</div><article><h1>Head &amp; more</h1><p>One <b>bold</b>\n text.<br>Next.</p><p>Of.</p></article><footer>&copy; x</footer></body></html>", "Head & more One bold text. Next. Of."),
    ("<article><p>A sentence stands here.<p>Another &lt;one&gt; follows&nbsp;it.</article><section class='comments'><p>I liked it a lot, and I am going to tell all of my friends about this.</p></section>", "A sentence stands here. Another <one> follows it."),
    ("<main><p>Text is here.</p><aside>See also other things</aside><form><label>Name</label><input></form><p>More text.</p></main>", "Text is here. More text."),
    ("<article><p>Open and never closed", "Open and never closed"),
    ("<body><nav>Menu</nav></body>", ""),
    ("<article><header>By me</header><p>Words <span class=\"share\">Share this</span> go on.</p></article>", "Words go on."),
    (None, ""), ("", ""), ("   ", ""), ("<", ""), ("<script>only", ""), ("<!-- x", ""),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def splits(tree):
    return [] if tree.left is None else [html_text.FEATURES[tree.feature], *splits(tree.left), *splits(tree.right)]


def test_tree_fits_its_table_and_splits_by_density_and_neighbours():
    tree = html_text.trained_tree()
    for seed in (4, 5):  # the table, and the same parts in other company
        rows, labels = html_text.labelled_rows(seed)
        assert (tree.predict(rows) == labels).mean() >= 0.99
    used = splits(tree)
    assert "link_density" in used and set(used) & {"previous_words", "next_words", "previous_link_density", "next_link_density"} and set(used) & {"before", "after"}
    for name in ("standing", "in_boiler"):  # what the elements say is not enough
        rows, labels = html_text.labelled_rows()
        rows = rows[:, [html_text.FEATURES.index(n) for n in ("standing", "in_boiler")]]
        assert (html_text.grow(rows, labels).predict(rows) == labels).mean() < 0.95


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(n)) + "."


#: Pages that the tree did not see, as lists of (html, is main text).
UNSEEN = [
    [("<div class=page><ul><li>Home</li><li>About us</li></ul>", False), (f"<p>{prose(24, 1)}</p>", True), (f"<p>{prose(14, 2)}</p></div>", True)],
    [("<article><p>", None), (prose(8, 3), True), ("</p><div class='related-work'><p>", None), (prose(15, 4), True), ("</p></div></article>", None)],
    [("<div id='site-header'><span>The Valley Post</span></div><div class='nav-menu'><a href=1>News</a> <a href=2>Sport</a></div>", False), (f"<div class='post-content'><h2>{prose(4, 5)}</h2><p>{prose(50, 6)}</p><p>{prose(3, 7)}</p></div>", True), (f"<div id='comments'><p>{prose(30, 8)}</p></div><div class='site-footer'>{prose(9, 9)}</div>", False)],
    [("<table><tr><td><a href=1>Index</a></td><td><a href=2>Archive</a></td></tr></table>", False), (f"<table><tr><td>{prose(60, 10)}</td></tr></table>", True), ("<p><a href=3>Back to the index</a></p>", False)],
    [(f"<div role=alert>{prose(16, 11)}</div><form><label>{prose(3, 12)}</label><input></form>", False), (f"<p>{prose(33, 13)}</p><p>{prose(28, 14)} <a href=x>{prose(2, 15)}</a></p>", True), (f"<div class='cookieConsent'>{prose(25, 16)}</div>", False)],
    [("<header><h1>My pages</h1></header>", False), (f"<main><h1>{prose(5, 17)}</h1><p>{prose(6, 18)}</p><blockquote>{prose(12, 19)}</blockquote><pre>{prose(7, 20)}</pre></main>", True), (f"<aside><p>{prose(20, 21)}</p></aside><footer>{prose(6, 22)}</footer>", False)],
    [(f"<article><p>{prose(20, 23)}", True), ("<div style='display:none'>secret words in here</div>", False), (f"<p>{prose(18, 24)}</article>", True), (f"<ul class='comment-list'><li>{prose(22, 25)}</li><li>{prose(14, 26)}</li></ul>", False)],
    [("<div class='widget'>", None), (f"<article><p>{prose(40, 27)}</p><p>{prose(26, 28)}</p></article>", True), ("</div>", None)],
]


@pytest.mark.parametrize("page", UNSEEN)
def test_pages_that_the_tree_did_not_see(page):
    want = " ".join(" ".join(html_text.SPACE.sub(" ", re.sub(r"<[^>]+>", " ", part)).split()) for part, main in page if main)
    got = html_text.main_text("<html><body>" + "".join(part for part, _ in page) + "</body></html>")
    assert got.split() == want.split()


def test_nothing_of_the_article_is_dropped():
    page = "<article><p>The area is <math><mi>pi</mi> <mi>r</mi> <mtext>squared</mtext></math> as known.</p><p>See <object>a fallback</object> and <noscript>plain words</noscript>, <svg><title>icon</title><text>of a drawing</text></svg>.</p></article>"
    assert html_text.main_text(page) == "The area is pi r squared as known. See a fallback and plain words , of a drawing."


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are needed")
def test_articles_of_the_pages():
    """The driver's pages mark their article; a plain reading of that element has to give the same words."""
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    for row in rows:
        inside = re.search(r"<article>(.*?)</article>", row["html"], re.S)
        assert html_text.main_text(row["html"]).split() == html.unescape(re.sub(r"<[^>]+>", " ", inside[1])).split()


def test_broken_and_long_pages_end():
    for page in ("<a " * 20_000, "<div>" * 20_000 + "x", "<p>x" * 20_000, "<" * 50_000, "&amp;" * 20_000, "<a href='" + "x" * 200_000, "<!--" * 20_000, "<b>" * 5000 + "</i>" * 5000, "<div>" * 30_000 + "</p>" * 30_000, "<div class=ad>" * 20_000 + "</div>" * 20_000):
        html_text.main_text(page)


def test_extract(spark):
    pages = spark.createDataFrame([(i, f"u{i}", p, 9) for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    assert got == {i: (f"u{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html_text.extract(pages.limit(0)).columns == ["page_id", "url", "text", "n_chars"]


# ---- token counts


def test_edits_equal_a_full_count():
    counter = token_counts.counter(*token_counts.tokenizer())
    rng = random.Random(5)
    marks = " \n\t'abcTs12!?é漢  's"
    for k in range(400):
        text = "".join(rng.choices(marks, k=rng.choice([0, 1, 40, 900])))
        tree = token_counts.TokenTree(text, counter)
        for _ in range(6):
            a = rng.randint(0, len(text))
            b = min(len(text), a + rng.choice([0, 1, 3, 50]))
            new = "".join(rng.choices(marks, k=rng.choice([0, 1, 2, 8, 30, 3000 if k % 50 == 0 else 3])))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(counter.encoding.encode_ordinary(text))


def test_only_the_edited_part_is_encoded():
    tree = token_counts.TokenTree("some words stand here. " * 5000, token_counts.counter(*token_counts.tokenizer()))
    tree.edit(50_000, 50_003, "other")
    assert tree.reencoded < 60


def test_saved_trees_are_the_same():
    counter = token_counts.counter(*token_counts.tokenizer())
    for text in ("", "one", "words stand here. " * 400, "x" * 300 + " é漢 " + "\n" * 999):
        tree = token_counts.TokenTree(text, counter)
        again = token_counts.TokenTree.restored(text, tree.saved(), counter)
        assert again.leaves == tree.leaves and (again.n_tokens, again.text()) == (tree.n_tokens, text)


def test_trees_are_kept_between_edits(spark, tmp_path, monkeypatch):
    """A second run reads trees from a table and encodes the edits only."""
    from pyspark.sql import functions as F

    rows = [(1, "hello big world", [(5, 9, " small"), (0, 0, "Oh ")]), (2, None, [(0, 5, "new text")]), (3, "", None), (4, "abc", [None, (None, None, None), (99, 120, "!")]), (None, "x y", []), (1, "hello big world", None), (6, "many words " * 20_000, [(100_000, 100_004, "other")])]
    docs = spark.createDataFrame([(i, t, 7) for i, t, _ in rows], "doc_id long, text string, leaves int").coalesce(1)
    token_counts.token_trees(docs).write.parquet(f"{tmp_path}/trees")
    todo = spark.createDataFrame([(i, (t or "")[:20], e) for i, t, e in rows], "i long, head string, e array<struct<start:long,stop:long,text:string>>")
    trees = spark.read.parquet(f"{tmp_path}/trees")
    paired = trees.join(todo, F.expr("i <=> doc_id and head = left(coalesce(text, ''), 20) and (e is not null or doc_id <> 1)"), "left")
    first = token_counts.edit_trees(paired, F.col("e"))
    n = lambda t: len(counter.encoding.encode_ordinary(t))
    counter = token_counts.counter(*token_counts.tokenizer())
    long = rows[-1][1]
    want = {1: "Oh hello small world", 2: "new text", 3: "", 4: "abc!", None: "x y", 6: long[:100_000] + "other" + long[100_004:]}
    got = first.collect()
    assert len(got) == len(rows) and all((r.text or "") == want[r.doc_id] and r.n_tokens == n(want[r.doc_id]) for r in got)
    assert next(r for r in got if r.doc_id == 6).n_chars_encoded < 60
    first.select(*[x.split()[0] for x in token_counts.TREE.split(", ")]).write.parquet(f"{tmp_path}/edited")
    second = token_counts.edit_trees(spark.read.parquet(f"{tmp_path}/edited"), F.expr("array(named_struct('start', 0L, 'stop', 1L, 'text', 'Z'))"), counts_only=True).collect()
    assert all(r.n_tokens == n(want[r.doc_id]) and r.n_tokens_edited == n("Z" + want[r.doc_id][1:]) for r in second)
    assert token_counts.token_trees(docs.limit(0)).count() == 0 and token_counts.edit_trees(trees.limit(0), F.lit(None)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are needed")
def test_token_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    counter = token_counts.counter(*token_counts.tokenizer())
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("e", token_counts.revision()).collect()
    want = {}
    for r in docs:
        text = r.text or ""
        for e in r.e:
            a = min(e.start, len(text))
            text = text[:a] + e.text + text[max(a, min(e.stop, len(text))) :]
        want[r.doc_id] = (len(counter.encoding.encode_ordinary(r.text or "")), 3, len(counter.encoding.encode_ordinary(text)))
    assert {r.doc_id: (r.n_tokens, r.n_edits, r.n_tokens_edited) for r in token_counts.op9_token_counts(spark, sf).collect()} == want


# ---- quality


def quality_fixture(spark, n=600):
    rng = random.Random(8)
    texts = corpus(n, 11)
    rows, labels = [], []
    for i, t in enumerate(texts):
        good = rng.random() < 0.7
        if not good:
            t = " ".join(w + rng.choice(["$$$", "%%%"]) for w in t.split()) if i % 2 else " ".join(w for w in t.split()[:40] for _ in range(12))
        rows.append((i, t, "en", "lang"))
        labels.append((i, int(good), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in labels)


def test_held_out_accuracy(spark):
    docs, labels, truth = quality_fixture(spark)
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == len(truth) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == quality.crc_held_out(r.id) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.id] for r in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {r.id for r in got if r.predicted == 1}


def test_held_out_labels_teach_nothing(spark):
    docs, labels, truth = quality_fixture(spark, 200)
    flipped = spark.createDataFrame([(i, 1 - q if quality.crc_held_out(i) else q, 0) for i, q in truth.items()], "doc_id long, quality int, toxic int")
    a = {r.id: r.score for r in quality.score_documents(docs, labels).collect()}
    b = {r.id: r.score for r in quality.score_documents(docs, flipped).collect()}
    assert a == pytest.approx(b)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "some text"), (4, "w " * 100_000), (4, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    got = quality.score_documents(docs, labels).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    assert quality.score_documents(docs.limit(0), labels).count() == 0
    one = quality.score_documents(docs, spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 1)], "doc_id long, quality int")).collect()
    assert all(0 <= r.score <= 1 for r in one) and len({r.score for r in one if r.id in (1, 2)}) == 1


def test_isotonic():
    got = quality.pool_adjacent(np.array([0.1, 0.5, 0.3, 0.9, 0.2]), np.array([1.0, 1, 1, 1, 2]))
    assert (np.diff(got) >= 0).all() and got == pytest.approx([0.1, 0.4, 0.4, 1.3 / 3, 1.3 / 3])


def test_model_equals_direct_ridge(spark):
    """Partition-summed normal equations and pooled cells, against least squares over all rows in one piece."""
    docs, labels, _ = quality_fixture(spark, 400)
    stats = quality.document_statistics(docs)
    rows = quality._taught(stats, labels)
    model = quality.fit(rows.repartition(7))
    data = rows.collect()
    x, y = np.array([r.stats for r in data]), np.array([r.label for r in data], float)
    assert model.mean == pytest.approx(x.mean(axis=0)) and model.scale == pytest.approx(np.where(x.std(axis=0) > 1e-9, x.std(axis=0), 1.0))
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(size=(x.shape[1], quality.N_FEATURES)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, quality.N_FEATURES)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    z = np.hstack([np.sqrt(2 / quality.N_FEATURES) * np.cos(z @ w + b), 0.1 * z, np.ones((len(z), 1))])
    free = np.append(np.ones(z.shape[1] - 1), 1e-9 / quality.RIDGE)  # the constant is hardly held back
    stacked = np.vstack([z, np.diag(np.sqrt(quality.RIDGE * len(y) * free))])
    weights = np.linalg.lstsq(stacked, np.append(y, np.zeros(z.shape[1])), rcond=None)[0]
    assert model.raw(x) == pytest.approx(z @ weights, abs=1e-6)
    cell = np.clip(((z @ weights + 0.5) / 2 * quality.CELLS).astype(int), 0, quality.CELLS - 1)
    full = np.unique(cell)
    means = [y[cell == c].mean() for c in full]
    best = list(means)  # the isotonic fit by its min-max formula
    n = [int((cell == c).sum()) for c in full]
    block = lambda i, j: sum(m * k for m, k in zip(means[i : j + 1], n[i : j + 1], strict=True)) / sum(n[i : j + 1])
    for i in range(len(full)):
        best[i] = max(min(block(a, c) for c in range(i, len(full))) for a in range(i + 1))
    assert model.steps == pytest.approx(np.clip(best, 0, 1))


def test_gaussian_kernel_is_approximated():
    rng = np.random.default_rng(3)
    d = len(quality.STATISTICS)
    x = rng.normal(size=(60, d)) * 0.7
    w, b = rng.normal(size=(d, 20_000)) / quality.WIDTH, rng.uniform(0, 2 * np.pi, 20_000)
    z = quality.fourier(x, np.zeros(d), np.ones(d), w, b)[:, :20_000]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * quality.WIDTH**2))
    assert np.abs(z @ z.T - kernel).max() < 0.05


# ---- pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are needed")
def test_pipeline_equals_plain_python(spark):
    import corpus_pipeline
    from tessera.llm.decontaminate import words
    from tests.llm.test_filters import slow_lines, slow_passages
    from tessera.llm import similar_texts
    from tests.llm.test_pairs import components
    from tests.llm.test_similar import distances, jaccard

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.id: r.predicted for r in quality.score_documents(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id])
    rows = [(i, t) for i, _, _, t in slow_lines(rows)]
    far = distances(similar_texts.sketches(pa.array([t for _, t in rows])))
    label = components([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in np.argwhere(np.triu(far <= similar_texts.bit_budget(0.8), 1)).tolist()])
    alike = [(a, b) for a in range(len(rows)) for b in range(a) if far[a, b] < 100 and jaccard(rows[a][1], rows[b][1]) >= 0.8]
    assert alike and all(label[rows[a][0]] == label[rows[b][0]] for a, b in alike)
    rows = [(i, t) for i, t in rows if label[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {tuple(words(t)[j : j + 3]) for _, t in items for j in range(len(words(t)) - 2)}
    maybe = [(i, t) for i, t in rows if any(tuple(words(t)[j : j + 3]) in grams for j in range(len(words(t)) - 2))]
    leaks = {d for d, _ in slow_passages(maybe, items)}
    rows = [(i, t) for i, t in rows if i not in leaks]
    library = Tokenizer.from_file(packing.tokenizer_path())
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID] for i, t in rows}
    check_pieces(corpus_pipeline.run(spark, sf).collect(), want)
    assert 0 < len(leaks) and len(rows) > 50


def test_stages_keep_columns(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "packing"] and corpus_pipeline.ORACLE_SQL is None
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated ids and rows, clashing names, and empty tables."""
    import corpus_pipeline

    item = " ".join(f"item{i}" for i in range(40))
    spark.createDataFrame([(1, item), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "some good words of a text that stays", "en", "a", 1, 1), (1, "some good words of a text that stays", "en", "a", 1, 1), (2, None, None, None, None, None), (None, "a line that is here twice", "en", "a", 5, 2), (3, "", "de", "b", 0, 3), (4, f"before {item} after", "en", "b", 9, 4), (5, "long " * 40_000, "en", "b", 200_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, stats int").repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, docs.limit(0), str(tmp_path))
        got = stage(spark, docs, str(tmp_path))
        assert nothing.count() == 0
        if name == "packing":
            assert {r.doc_id for r in got.collect()} == {1, 2, 3, 4, 5, None}
            continue
        assert got.columns == docs.columns == nothing.columns
        left = sorted((r.doc_id for r in got.collect()), key=str)
        if name == "line_dedup":
            assert left == sorted((r[0] for r in rows), key=str)
        elif name == "near_dedup":
            assert left == sorted([1, 1, 2, None, 4, 5], key=str)
        elif name == "decontaminate":
            assert left == sorted([1, 1, 2, None, 3, 5], key=str)
