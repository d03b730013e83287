"""Sequence packing by lexical retrieval: BM25 neighbours of a seed document fill its window.

Documents of all partitions are first brought into one order in which lexically like ones stand together; shards of
the index are runs of that order, and document frequencies and the mean length are those of all rows.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import materialize
from tessera.llm.word_bpe import encoder

WINDOW = 4096
END_ID = 2
#: A shard of the index: consecutive documents in lexical order, up to so many rows or characters.
SHARD_DOCS, SHARD_CHARS = 2048, 8_000_000
#: Rows that are encoded at once.
ENCODE_ROWS = 1024
K1, B = 1.2, 0.75
#: A term that one in so many documents of a shard holds has its weights in a dense row.
DENSE_SHARE = 32
#: Random directions of the sketch by which documents are ordered; sampled documents a leaf, and at most in all.
SKETCH, LEAF_SAMPLE, MAX_SAMPLE = 64, 16, 1 << 18
#: Tokens that a partition of the ordered documents should hold.
PARTITION_TOKENS = 1 << 23
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and how often each occurs."""
    ids = np.sort(ids if ids.dtype == np.uint16 or not len(ids) or ids.max() > 65535 else ids.astype(np.uint16))
    new = np.ones(len(ids) + 1, bool)
    np.not_equal(ids[1:], ids[:-1], out=new[1:-1])
    first = np.flatnonzero(new)
    return ids[first[:-1]], first[1:] - first[:-1]


@lru_cache(1)
def _axes(n_terms: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((n_terms, SKETCH), np.float32)


class Statistics:
    """Of all documents: how many, their mean length in tokens, and for each term how many hold it."""

    def __init__(self, n: int, tokens: int, df: np.ndarray):
        self.n, self.mean, self.df = n, max(1.0, tokens / max(1, n)), df

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, np.log((self.n - df + 0.5) / (df + 0.5)))  # none for terms that most documents hold

    def sketch(self, docs: list[np.ndarray]) -> np.ndarray:
        """Unit vectors whose products are close to the cosines of the documents' BM25 vectors."""
        axes = _axes(len(self.df))
        out, idf = np.zeros((len(docs), SKETCH), np.float32), self.idf(self.df)
        for i, doc in enumerate(docs):
            terms, tf = distinct(doc)
            weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(doc) / self.mean))
            out[i] = weight.astype(np.float32) @ axes[terms]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class LexicalOrder:
    """A binary tree over sketches; each node halves its sample along the direction in which that varies most."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros((2 << depth, SKETCH), np.float32), np.zeros(2 << depth, np.float32)
        nodes = {1: sample}
        for node in range(1, 2 << depth):
            own = nodes.pop(node)
            if not len(own):
                own = np.zeros((1, SKETCH), np.float32)
            centred = own - own.mean(axis=0)
            self.axis[node] = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            along = own @ self.axis[node]
            self.cut[node] = np.median(along)
            nodes[2 * node], nodes[2 * node + 1] = own[along <= self.cut[node]], own[along > self.cut[node]]

    def keys(self, sketches: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Leaf and the place along its own direction; copies are told apart by id, so that they needn't share a partition."""
        node = np.ones(len(sketches), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", sketches, self.axis[node]) > self.cut[node])
        along = np.clip(np.einsum("ij,ij->i", sketches, self.axis[node]), -1, 1).astype(np.float64)
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.float64) / (1 << 24)
        return node - (1 << self.depth) + 0.4995 * (along + 1) + 1e-6 * spread


class Bm25Shard:
    """Inverted index of one shard: for each term the documents that hold it and their BM25 weights.

    Terms of many documents have a weight for each document instead, zero where it lacks them: a row is added faster
    than a list of documents is followed.
    """

    def __init__(self, docs: list[np.ndarray], whole: Statistics | None = None):
        self.n = len(docs)
        self.distinct, counts = zip(*map(distinct, docs), strict=True)
        sizes = np.array([len(t) for t in self.distinct])
        owner = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        term, tf = np.concatenate(self.distinct), np.concatenate(counts)
        length = np.array([len(d) for d in docs], np.float64)
        of_all = whole or Statistics(self.n, length.sum(), np.bincount(term))
        norm = K1 * (1 - B + B * length / of_all.mean)
        weight = of_all.idf(of_all.df[term]) * tf * (K1 + 1) / (tf + np.repeat(norm, sizes))
        use = weight > 0
        term, owner, weight = term[use], owner[use], weight[use].astype(np.float32)
        df = np.bincount(term, minlength=1)
        self.df, self.place = df, np.full(len(df), -1, np.int32)  # place: the row of a term in dense
        common = np.flatnonzero(df * DENSE_SHARE >= self.n)
        self.place[common] = np.arange(len(common))
        row = self.place[term]
        self.dense = np.zeros((len(common), self.n), np.float32)
        self.dense[row[row >= 0], owner[row >= 0]] = weight[row >= 0]
        rare = np.flatnonzero(row < 0)
        rare = rare[np.argsort(term[rare], kind="stable")]
        self.owner, self.weight = owner[rare], weight[rare]
        self.size = np.where(self.place < 0, df, 0)
        self.first = np.concatenate(([0], np.cumsum(self.size)[:-1]))

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """BM25 scores of all documents of the shard for distinct terms."""
        terms = terms[terms < len(self.df)]
        terms = terms[self.df[terms] > 0]
        rows = self.place[terms]
        out = self.dense[rows[rows >= 0]].sum(axis=0, dtype=np.float32).astype(np.float64)
        terms = terms[rows < 0]
        size = self.size[terms]
        ends = np.cumsum(size)
        if len(ends):
            at = np.repeat(self.first[terms] - ends + size, size) + np.arange(ends[-1])
            out += np.bincount(self.owner[at], self.weight[at], self.n)
        return out


class Packer:
    """Fills windows one after the other; a document that doesn't fit is cut and its rest seeds the next window."""

    def __init__(self, first_sequence: int, window: int = WINDOW, whole: Statistics | None = None):
        self.window, self.sequence, self.fill, self.whole = window, first_sequence, 0, whole
        self.open: list[tuple] = []  # pieces of the window that isn't full
        self.seed: np.ndarray | None = None
        self.out: list[tuple] = []

    def put(self, doc_id: int | None, ids: np.ndarray) -> None:
        start, total = 0, len(ids)
        while start < total:
            take = min(total - start, self.window - self.fill)
            self.open.append((doc_id, ids, start, take, self.fill))
            if not self.fill:
                self.seed = ids
            self.fill += take
            start += take
            if self.fill == self.window:
                self._close(self.open)

    def _close(self, pieces: list[tuple]) -> None:
        for doc_id, ids, start, take, offset in pieces:
            self.out.append((doc_id, start, take, zlib.crc32(ids[start : start + take].astype("<u4").tobytes()), len(ids), self.sequence, offset))
        self.sequence += 1
        self.open, self.fill, self.seed = [], 0, None

    def shard(self, doc_ids: list, docs: list[np.ndarray]) -> None:
        index, unused, at = Bm25Shard(docs, self.whole), np.ones(len(docs), bool), 0
        while True:
            if self.fill:
                ranks = np.argsort(-np.where(unused, index.scores(distinct(self.seed)[0]), -1.0), kind="stable")
                for i in ranks[: unused.sum()].tolist():
                    sequence = self.sequence
                    unused[i] = False
                    self.put(doc_ids[i], docs[i])
                    if self.sequence != sequence:
                        break
                if not unused.any():
                    return
            else:
                while at < len(docs) and not unused[at]:
                    at += 1
                if at == len(docs):
                    return
                unused[at] = False
                self.put(doc_ids[at], docs[at])

    def finish(self) -> None:
        """The window that is left becomes sequences of powers of two, which aren't padded."""
        rest, left = self.open, self.fill
        while left:
            size = 1 << (left.bit_length() - 1)
            now, fill, later = [], 0, []
            for doc_id, ids, start, take, _ in rest:
                here = min(take, size - fill)
                if here:
                    now.append((doc_id, ids, start, here, fill))
                    fill += here
                if take > here:
                    later.append((doc_id, ids, start + here, take - here, 0))
            self._close(now)
            rest, left = later, left - size

    def drain(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        columns = list(zip(*self.out, strict=True)) or [()] * len(names)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _encoded(docs: DataFrame, path: str) -> DataFrame:
    """(id, chars, n, ids): each text's token ids, two bytes each where that is enough for the row."""

    def run(batches):
        words, end = encoder(path), np.array([END_ID], np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, ENCODE_ROWS):
                part = batch.slice(at, ENCODE_ROWS)
                chars = pc.utf8_length(part.column(1)).fill_null(0).cast(pa.int64())
                ids = [np.concatenate([x, end]) for x in words.encode(part.column(1))]
                packed = [x.astype("<u2" if x.max() < 65536 else "<u4").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), chars, pa.array(map(len, ids), pa.int64()), pa.array(packed, pa.binary())], names=["id", "chars", "n", "ids"])

    return docs.mapInArrow(run, "id long, chars long, n long, ids binary")


def _unpacked(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def _documents(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [_unpacked(x, n) for x, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True)]


def _statistics(encoded: DataFrame) -> Statistics:
    """Counts of all rows; partitions add up first, and the driver gets a row for each term of the vocabulary."""

    def partial(batches):
        n, tokens, df = 0, 0, np.zeros(1 << 16, np.int64)
        for batch in batches:
            for doc in _documents(batch):
                terms = distinct(doc)[0]
                if int(terms[-1]) >= len(df):
                    df = np.append(df, np.zeros(int(terms[-1]) + 1, np.int64))
                df[terms] += 1
                n, tokens = n + 1, tokens + len(doc)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-2, -1], held))), pa.array(np.concatenate(([n, tokens], df[held])))], names=["term", "n"])

    rows = encoded.mapInArrow(partial, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    found = dict(zip(rows["term"].tolist(), rows["n"].tolist(), strict=True))
    n, tokens = found.pop(-2, 0), found.pop(-1, 0)
    df = np.zeros(max(found, default=-1) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Statistics(n, tokens, df)


def _placed(encoded: DataFrame, whole: Statistics) -> DataFrame:
    """The rows in lexical order: (id, chars, n, ids) sorted within partitions that are ranges of one order."""
    parts = max(1, int(np.ceil(whole.mean * whole.n / PARTITION_TOKENS)))
    depth = max(0, int(np.ceil(np.log2(max(1, whole.n) / SHARD_DOCS))))
    size = min(MAX_SAMPLE, LEAF_SAMPLE << depth)

    def sketch(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in whole.sketch(_documents(batch))], pa.binary())], names=["id", "sketch"])

    share = int(np.ceil((1 << 20) * min(1.0, size / max(1, whole.n))))
    taken = encoded.where(F.pmod(F.xxhash64("id", "ids"), F.lit(1 << 20)) < share).mapInArrow(sketch, "id long, sketch binary").limit(2 * size).collect()
    sample = np.frombuffer(b"".join(bytes(r["sketch"]) for r in taken), np.float32).reshape(-1, SKETCH)
    order = LexicalOrder(sample, depth)
    known = np.sort(order.keys(sample, np.array([r["id"] or 0 for r in taken], np.int64)))
    bounds = known[np.arange(1, parts) * len(known) // parts] if len(known) else np.empty(0)

    def place(batches):
        for batch in batches:
            ids = np.array([i or 0 for i in batch.column("id").to_pylist()], np.int64)
            keys = order.keys(whole.sketch(_documents(batch)), ids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys), pa.array(np.searchsorted(bounds, keys, "right").astype(np.int32))], names=[*batch.schema.names, "key", "part"])

    placed = encoded.mapInArrow(place, "id long, chars long, n long, ids binary, key double, part int")
    return placed.repartitionById(parts, "part").sortWithinPartitions("key", "id", "ids")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pieces of sequences of at most window tokens, one row each.

    Token ids are written once. A tree over sketches of all documents' BM25 vectors then brings like documents of all
    partitions together; a shard of the index is a run of that order, with the document frequencies and mean length
    of all rows. A seed's candidates are the unused documents of its run, whatever partition they came from; a
    neighbour that the tree puts elsewhere isn't one (README: how many). Copies may lie in several partitions, so no
    key is hot. Every document ends with END_ID; a null or empty text is that id alone. A window is filled with the
    best unused neighbours of the document that began it, and rows with no common term come last, in their order. Only
    the last window of a partition isn't full; it is cut into powers of two. Rows with a null or repeated id are packed
    like any other, each for itself; ties in score go by the order of the run. Very long texts are encoded whole and fill
    as many windows as they need. Only id_col and text_col are read, so other columns can have any names. No rows: none out.
    """
    encoded = materialize(_encoded(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), path or tokenizer_path()), "tokens")
    whole = _statistics(encoded)

    def run(batches):
        packer = Packer(TaskContext.get().partitionId() << 40, window, whole)
        ids, docs, chars = [], [], 0
        for batch in batches:
            for i, size, doc in zip(batch.column("id").to_pylist(), batch.column("chars").to_pylist(), _documents(batch), strict=True):
                if ids and (len(ids) >= SHARD_DOCS or chars + size > SHARD_CHARS):
                    packer.shard(ids, docs)
                    yield packer.drain()
                    ids, docs, chars = [], [], 0
                ids.append(i)
                docs.append(doc)
                chars += size
        if ids:
            packer.shard(ids, docs)
            yield packer.drain()
        packer.finish()
        yield packer.drain()

    return _placed(encoded, whole).select("id", "chars", "n", "ids").mapInArrow(run, SCHEMA)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
