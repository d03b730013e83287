"""Near-duplicates by SimHash: fingerprints of word shingles, joined by a dual walk of binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import connected_components, local_forest, materialize

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Fingerprints that a trie should hold at most; decides how many leading bits part the tries, never what is compared.
TRIE_SIZE = 65_536
MIN_CELL_BITS, MAX_CELL_BITS = 4, 16
#: Fingerprints of a trie at most; a hot cell is dealt into several by hash, and all pairs of those are walked.
LARGEST_TRIE = 4 * TRIE_SIZE
#: Node pairs that are expanded at once; bounds memory only.
FRONTIER = 1 << 18


def fingerprint(text: str | None) -> int:
    """64 bits; a bit is 1 if it is set in over half the shingle hashes, repeats included. No words or null: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return 0
    n = len(words) - SHINGLE_WORDS + 1
    if n < 1:
        grams: Iterator[bytes] = iter((b" ".join(words),))
        n = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8160):
        bits = np.unpackbits(hashes[i : i + 8160].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for j in range(0, len(bits), 255):
            ones += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed 64-bit long."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


class Trie:
    """A binary trie over sorted distinct fingerprints; a node is a range of them and a depth.

    zeros[d][i]: how many of the first i fingerprints have bit d (from the top) unset, so that a node's
    children are found by two look-ups.
    """

    def __init__(self, fps: np.ndarray, depth: int):
        self.fps = fps
        self.zeros = np.zeros((64, len(fps) + 1), np.int32)
        for d in range(depth, 64):
            np.cumsum((fps >> np.uint64(63 - d)) & np.uint64(1) ^ np.uint64(1), out=self.zeros[d, 1:])

    def split(self, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
        row = self.zeros[depth]
        return low + row[high] - row[low]


def trie_join(a: np.ndarray, b: np.ndarray | None, depth: int, error: int, budget: int = MAX_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of a, of b) that differ in at most budget bits; b None: a with itself, each pair once.

    a, b: sorted distinct uint64 that agree on their first depth bits within each; error: the bits in which
    those prefixes differ. Pairs of nodes are walked together; a pair is dropped once its error is over budget.
    """
    left = Trie(a, depth)
    right = left if b is None else Trie(b, depth)
    own = b is None
    start = np.array([[0], [len(a)], [0], [len(right.fps)], [error]], np.int64)
    stack = [(depth, start)] if len(a) and len(right.fps) and error <= budget else []
    while stack:
        depth, part = stack.pop()
        if part.shape[1] > FRONTIER:
            half = part.shape[1] // 2
            stack += [(depth, part[:, half:]), (depth, part[:, :half])]
            continue
        al, ah, bl, bh, err = part
        small = (ah - al) * (bh - bl) <= 4 if depth < 64 else np.ones(len(al), bool)
        if small.any():
            sal, sah, sbl, sbh = al[small], ah[small], bl[small], bh[small]
            if depth < 64:
                offsets = [(i, j) for i in range(4) for j in range(4) if (i + 1) * (j + 1) <= 4]
            else:
                offsets = [(0, 0)]
            for i, j in offsets:
                ok = (sal + i < sah) & (sbl + j < sbh)
                x, y = sal[ok] + i, sbl[ok] + j
                near = np.bitwise_count(left.fps[x] ^ right.fps[y]) <= budget
                if own:
                    near &= x < y
                if near.any():
                    yield x[near], y[near]
            big = ~small
            al, ah, bl, bh, err = al[big], ah[big], bl[big], bh[big], err[big]
        if not len(al):
            continue
        am, bm = left.split(al, ah, depth), right.split(bl, bh, depth)
        sides = []
        for x_low, x_high, x_one in ((al, am, 0), (am, ah, 1)):
            for y_low, y_high, y_one in ((bl, bm, 0), (bm, bh, 1)):
                e = err + (x_one != y_one)
                ok = (x_high > x_low) & (y_high > y_low) & (e <= budget)
                if own:  # of a node with itself, the two mixed children are one pair
                    ok &= x_low <= y_low
                sides.append(np.stack([x_low[ok], x_high[ok], y_low[ok], y_high[ok], e[ok]]))
        stack.append((depth + 1, np.concatenate(sides, axis=1)))


def near_edges(fps: DataFrame, cell_bits: int | None = None, largest: int = LARGEST_TRIE) -> DataFrame:
    """Edges (u, v) with the components of "differ in at most MAX_BITS bits" over fps(fp, node), fp distinct.

    Two fingerprints that differ in at most MAX_BITS bits agree in one of MAX_BITS + 1 equal parts of them. So each is
    turned in as many ways, a part of it in front each time, and its cell_bits leading bits say which trie it goes to:
    MAX_BITS + 1 copies, however many tries there are. Each trie is joined with itself by a step of its own, which
    returns a spanning forest and not the pairs.
    """
    spark = fps.sparkSession
    if cell_bits is None:
        n = fps.count()
        cell_bits = min(MAX_CELL_BITS, max(MIN_CELL_BITS, int(np.ceil(np.log2(max(1, n / TRIE_SIZE))))))
    part = 64 // (MAX_BITS + 1)
    turned = [F.col("fp"), *(F.shiftleft("fp", part * t).bitwiseOR(F.shiftrightunsigned("fp", 64 - part * t)) for t in range(1, MAX_BITS + 1))]
    rows = fps.select("node", F.posexplode(F.array(*turned)).alias("turn", "key"))
    placed = rows.select("node", "key", (F.col("turn") * (1 << cell_bits) + F.shiftrightunsigned("key", 64 - cell_bits)).cast("int").alias("cell"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(frame["key"].to_numpy().view(np.uint64))
        return pd.DataFrame({"cell": [int(frame["cell"].iloc[0])], "chunk": [int(frame["chunk"].iloc[0])], "keys": [frame["key"].to_numpy()[order].tobytes()], "nodes": [frame["node"].to_numpy()[order].tobytes()]})

    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / largest).cast("int").alias("chunks"))
    placed = placed.join(sizes.where("chunks > 1"), "cell", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("key"), "chunks"), F.lit(0)).cast("int"))
    tries = materialize(placed.groupBy("cell", "chunk").applyInPandas(pack, "cell int, chunk int, keys binary, nodes binary"), "tries")
    other = tries.select("cell", F.col("chunk").alias("chunk2"), F.col("keys").alias("keys2"), F.col("nodes").alias("nodes2"))
    across = tries.join(other, "cell").where("chunk < chunk2").select("cell", "keys", "nodes", "keys2", "nodes2")  # of hot cells only
    none = F.lit(None).cast("binary")
    n_tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = tries.select("cell", "keys", "nodes", none.alias("keys2"), none.alias("nodes2")).repartition(n_tasks, "cell", F.xxhash64("keys")).unionByName(across)

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                k1, n1, k2, n2 = (batch.column(i)[row].as_py() for i in range(4))
                a, na = np.frombuffer(k1, np.uint64), np.frombuffer(n1, np.int64)
                b, nb = (None, na) if k2 is None else (np.frombuffer(k2, np.uint64), np.frombuffer(n2, np.int64))
                u, v, held = [], [], 0
                for x, y in trie_join(a, b, cell_bits, 0):
                    u.append(na[x])
                    v.append(nb[y])
                    held += len(x)
                    if held > 1 << 20:  # bounds memory where a group is dense
                        p, q = local_forest(np.concatenate(u), np.concatenate(v))
                        u, v, held = [p], [q], len(p)
                if u:
                    p, q = local_forest(np.concatenate(u), np.concatenate(v))
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["u", "v"])

    return pairs.select("keys", "nodes", "keys2", "nodes2").mapInArrow(run, "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp, component) for each row of docs.

    component: smallest id reachable over links of at most MAX_BITS differing bits, itself included. Equal
    fingerprints are one class, whose smallest id stands for it in the trie join; so exact copies cost nothing.
    Null, empty and white texts have fingerprint 0 and link like any other. A null id gets its fingerprint and
    a null component, and links with nothing. Repeated ids are one document with several texts. Whole texts count,
    however long. Only id_col and text_col are read, so other columns can have any names. No rows: none out.
    """
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = materialize(marked.where("id is not null").groupBy("fp").agg(F.min("id").alias("node"), F.max("id").alias("last")), "classes")
    # An id with several texts links its classes.
    repeated = marked.where("id is not null").groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("id")
    bridges = marked.join(repeated, "id").join(classes, "fp").select(F.col("id").alias("u"), F.col("node").alias("v"))
    components = connected_components(near_edges(classes.select("fp", "node")).unionByName(bridges))
    named = classes.join(components, classes["node"] == components["node"], "left").select("fp", F.coalesce("component", classes["node"]).alias("component"))
    return marked.join(named, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller id; rows with a null id stay."""
    groups = simhash_components(docs, id_col, text_col).where("id is not null and component < id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(groups, docs[id_col] == groups["__gone"], "left_anti")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = simhash_components(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
