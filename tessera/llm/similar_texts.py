"""Near-duplicates by similarity: wide SimHash sketches of word shingles, joined by walks of binary tries.

A pair with a Jaccard similarity of 0.8 differs in some 15 % of its SimHash bits, too many for one trie. So a sketch has
BITS bits, and several tries are made, each over other bits of it. A pair of nodes is dropped once it differs in more
than EARLY_ERRORS of the bits that a trie looks at first; the pairs that are left are compared in all bits.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import LONGEST, WordHashes, column_bytes, connected_components, local_forest, materialize, mixed, split_words
from tessera.llm.simhash import Trie

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BITS = 256
#: Bits after a cell's own of which a pair may miss so many.
EARLY_BITS, EARLY_ERRORS = 11, 1
#: Share of the pairs of just the wanted similarity that some trie has to bring together; decides how many tries there are.
RECALL = 0.99
#: Standard deviations by which a pair's differing bits may exceed the expected ones.
SPARE = 1.5
#: Sketches of a cell of one trie, on average; a cell with more than LARGEST is dealt into several, all pairs of which are joined.
CELL, LARGEST = 2048, 4096
#: Pairs that are compared at once.
FRONTIER = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LANES = np.random.default_rng(21).integers(1, 1 << 63, BITS // 64, dtype=np.uint64)


@lru_cache(1)
def _hashes() -> WordHashes:
    return WordHashes(13)


def sketches(column: pa.Array, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """A row of BITS / 8 bytes for each text: a bit is 1 if it is set in over half of the hashes of its distinct shingles.

    Words are as in op2: parted by ASCII white space, A-Z lower-cased. Fewer words than a shingle has are one; none: zeros.
    """
    raw, bounds = column_bytes(column)
    raw = _LOWER[raw]
    starts, sizes = split_words(_SPACE[raw], bounds)
    words = _hashes().hashes(raw, starts, np.minimum(sizes, LONGEST))
    for k in np.flatnonzero(sizes > LONGEST).tolist():
        words[k] = xxhash.xxh64_intdigest(raw[starts[k] : starts[k] + sizes[k]].tobytes(), 13) | 1
    factors = mixed(np.arange(1, shingle + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)
    edges = np.searchsorted(starts, bounds).tolist()
    out = np.zeros((len(bounds) - 1, BITS // 8), np.uint8)
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a == b:
            continue
        wide = min(shingle, b - a)
        n = b - a - wide + 1
        grams = np.unique(sum(words[a + j : a + j + n] * factors[j] for j in range(wide)))
        ones = np.zeros(BITS, np.int64)
        for k in range(0, len(grams), 255):
            lanes = mixed(mixed(grams[k : k + 255, None] + _LANES))
            ones += np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), -1), axis=1).sum(axis=0, dtype=np.uint8)
        out[i] = np.packbits(ones * 2 > len(grams))
    return out


def differing_share(similarity: float) -> float:
    """The expected share of differing bits of two equally large sets with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bit_budget(similarity: float) -> int:
    share = differing_share(similarity)
    return int(BITS * share + SPARE * math.sqrt(BITS * share * (1 - share)))


def plan_tries(n: int, similarity: float) -> tuple[int, int]:
    """(bits that part a trie into cells, how many tries) for n sketches."""
    share = differing_share(similarity)
    cell_bits = max(2, math.ceil(math.log2(max(1, n / CELL))))
    early = sum(math.comb(EARLY_BITS, k) * share**k * (1 - share) ** (EARLY_BITS - k) for k in range(EARLY_ERRORS + 1))
    hit = (1 - share) ** cell_bits * early
    return cell_bits, math.ceil(math.log(1 - RECALL) / math.log(1 - hit))


def trie_keys(fps: np.ndarray, trie: int) -> np.ndarray:
    """The 64 bits of each sketch, in the order in which this trie looks at them."""
    order = np.random.default_rng(1000 + trie).permutation(BITS)[:64]
    bits = np.unpackbits(fps, axis=1).take(order, axis=1)
    return np.ascontiguousarray(np.packbits(bits, axis=1)).view(">u8").ravel().astype(np.uint64)


class _Labels:
    """Links found so far between the sketches of a cell, and for each trie node whether its members are linked already."""

    def __init__(self, n: int):
        self.u, self.v, self.held = [], [], 0
        self.label = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        self.u.append(u)
        self.v.append(v)
        self.held += len(u)

    def settle(self) -> None:
        if self.held:
            node, low = local_forest(np.concatenate(self.u), np.concatenate(self.v))
            self.u, self.v, self.held = [node], [low], 0
            self.label[node] = low

    def changes(self, low: int, high: int) -> np.ndarray:
        own = self.label[low:high]
        return np.concatenate(([0], np.cumsum(own[1:] != own[:-1])))


def cell_forest(a: np.ndarray, b: np.ndarray | None, a_keys: np.ndarray, b_keys: np.ndarray | None, budget: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges over a's and (after them) b's places with the components of the pairs that a walk of their tries links.

    a, b: sketches as rows of 64-bit words, in the order of their keys; b None: a with itself. depth: the bits in
    which all keys of a cell agree. Pairs of nodes within EARLY_ERRORS of the next EARLY_BITS bits are followed to
    their members, which are linked if they differ in at most budget bits. A pair of nodes whose members are all in one
    component already can't link anything, so that a large group costs its rounds of pivots and not all its pairs.
    """
    own = b is None
    every = a if own else np.concatenate([a, b])
    shift = 0 if own else len(a)
    links = _Labels(len(every))
    rng = np.random.default_rng(len(every))
    for _ in range(min(12, len(every) // 64)):
        pivot = int(rng.integers(len(every)))
        near = np.flatnonzero(np.bitwise_count(every ^ every[pivot]).sum(axis=1, dtype=np.int64) <= budget)
        links.add(np.full(len(near), pivot), near)
    links.settle()
    left = Trie(a_keys, depth)
    right = left if own else Trie(b_keys, depth)
    stack = [(depth, np.array([[0], [len(a)], [0], [len(right.fps)], [0]], np.int64))] if len(a) and len(right.fps) else []
    left_runs, right_runs = links.changes(0, len(a)), links.changes(shift, shift + len(right.fps))
    while stack:
        depth_now, part = stack.pop()
        if part.shape[1] > FRONTIER:
            half = part.shape[1] // 2
            stack += [(depth_now, part[:, half:]), (depth_now, part[:, :half])]
            continue
        al, ah, bl, bh, err = part
        done = (left_runs[ah - 1] == left_runs[al]) & (right_runs[bh - 1] == right_runs[bl]) & (links.label[al] == links.label[shift + bl])
        if done.any():
            al, ah, bl, bh, err = part = part[:, ~done]
        size = (ah - al) * (bh - bl)
        last = (size <= 16) if depth_now < 64 else np.ones(len(al), bool)
        for i in _pieces(size[last]):
            low_a, low_b, wide = al[last][i], bl[last][i], (bh - bl)[last][i]
            n = size[last][i]
            ends = np.cumsum(n)
            place = np.arange(ends[-1]) - np.repeat(ends - n, n)
            x, y = np.repeat(low_a, n) + place // np.repeat(wide, n), np.repeat(low_b, n) + place % np.repeat(wide, n)
            new = links.label[x] != links.label[shift + y]
            x, y = x[new], shift + y[new]
            near = np.bitwise_count(every[x] ^ every[y]).sum(axis=1, dtype=np.int64) <= budget
            links.add(x[near], y[near])
            if links.held > 1 << 16:
                links.settle()
        al, ah, bl, bh, err = part[:, ~last]
        if not len(al):
            continue
        if links.held > len(every) // 4:
            links.settle()
            left_runs, right_runs = links.changes(0, len(a)), links.changes(shift, shift + len(right.fps))
        am, bm = left.split(al, ah, depth_now), right.split(bl, bh, depth_now)
        most = EARLY_ERRORS if depth_now < depth + EARLY_BITS else 64
        sides = []
        for x_low, x_high, x_one in ((al, am, 0), (am, ah, 1)):
            for y_low, y_high, y_one in ((bl, bm, 0), (bm, bh, 1)):
                e = err + (x_one != y_one)
                ok = (x_high > x_low) & (y_high > y_low) & (e <= most)
                if own:
                    ok &= x_low <= y_low
                sides.append(np.stack([x_low[ok], x_high[ok], y_low[ok], y_high[ok], e[ok]]))
        stack.append((depth_now + 1, np.concatenate(sides, axis=1)))
    links.settle()
    return (np.concatenate(links.u), np.concatenate(links.v)) if links.u else (np.empty(0, np.int64), np.empty(0, np.int64))


def _pieces(sizes: np.ndarray) -> list[slice]:
    """Slices of about FRONTIER pairs."""
    if not len(sizes):
        return []
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // FRONTIER)) + 1
    edges = [0, *cut.tolist(), len(sizes)]
    return [slice(i, j) for i, j in zip(edges[:-1], edges[1:], strict=True)]


def similar_edges(classes: DataFrame, similarity: float = SIMILARITY, largest: int = LARGEST) -> DataFrame:
    """Edges (u, v) between the nodes of classes(fp, node) that the tries link, fp distinct; a forest for each cell."""
    n = classes.count()
    cell_bits, tries = plan_tries(n, similarity)
    budget, largest = bit_budget(similarity), max(largest, n // 4096)

    def cells(batch: pa.RecordBatch, t: int) -> tuple[np.ndarray, np.ndarray]:
        keys = trie_keys(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, BITS // 8), t)
        return keys, (keys >> np.uint64(64 - cell_bits)).astype(np.int64) + (t << 40)

    def count(batches):
        for batch in batches:
            for t in range(tries):
                cell, held = np.unique(cells(batch, t)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(held)], names=["cell", "n"])

    # At most 4096 cells a trie can be so large.
    sizes = classes.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") > largest)
    hot = {r["cell"]: -(-r["n"] // largest) for r in sizes.collect()}

    def deal(batches):
        names = ["cell", "pair", "side", "key", "fp", "node"]
        for batch in batches:
            node = batch.column(1).to_numpy()
            for t in range(tries):
                keys, cell = cells(batch, t)
                row, pair, side = [np.arange(len(keys))], [np.zeros(len(keys), np.int32)], [np.zeros(len(keys), np.int8)]
                for held in set(np.unique(cell).tolist()) & hot.keys() if hot else ():  # its rows go to each pair of parts that theirs is in
                    parts = hot[held]
                    mine = np.flatnonzero(cell == held)
                    part = (mixed(node[mine].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                    other = np.tile(np.arange(parts), (len(mine), 1))
                    low, high = np.minimum(part[:, None], other), np.maximum(part[:, None], other)
                    pair[0][mine] = -1
                    row.append(np.repeat(mine, parts))
                    pair.append((low * parts + high).ravel().astype(np.int32))
                    side.append((part[:, None] > other).ravel().astype(np.int8))
                row, pair, side = np.concatenate(row), np.concatenate(pair), np.concatenate(side)
                ok = pair >= 0
                row, pair, side = row[ok], pair[ok], side[ok]
                yield pa.RecordBatch.from_arrays([pa.array(cell[row]), pa.array(pair), pa.array(side), pa.array(keys[row].view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(node[row])], names=names)

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, side, node = table["key"].to_numpy().view(np.uint64), table["side"].to_numpy(), table["node"].to_numpy()
        fps = np.frombuffer(b"".join(table["fp"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        order = np.lexsort((node, key, side))
        cut = int((side == 0).sum())
        first, second = order[:cut], order[cut:]
        u, v = cell_forest(fps[first], fps[second] if len(second) else None, key[first], key[second] if len(second) else None, budget, cell_bits)
        return pa.table({"u": node[order][u], "v": node[order][v]})

    return classes.select("fp", "node").mapInArrow(deal, "cell long, pair int, side byte, key long, fp binary, node long").groupBy("cell", "pair").applyInArrow(join, "u long, v long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row (id, component) for each row of docs; component: the smallest id reachable by links, itself included.

    Rows link if their sketches differ in at most bit_budget(similarity) bits and a trie brings them together; so
    nearly all pairs of the similarity or more do, some that are a little less alike too, unlike ones don't (README). Rows with the same distinct shingles are one class, so exact copies cost nothing and always link. Null,
    empty and white texts are copies of each other. Whole texts count, however long. A null id has a null component and
    links with nothing; repeated ids are one document with several texts. Only id_col and text_col are read, so other
    columns can have any names. No rows: none out.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                fps = sketches(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f.tobytes() for f in fps], pa.binary())], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = materialize(rows.mapInArrow(run, "id long, fp binary"), "sketches")
    classes = materialize(marked.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "classes")
    repeated = marked.where("id is not null").groupBy("id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("id")
    bridges = marked.join(repeated, "id").join(classes, "fp").select(F.col("id").alias("u"), F.col("node").alias("v"))
    components = connected_components(similar_edges(classes, similarity).unionByName(bridges))
    named = classes.join(components, classes["node"] == components["node"], "left").select("fp", F.coalesce("component", classes["node"]).alias("component"))
    return marked.join(named, "fp", "left").select("id", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs without the rows whose component has a smaller id; rows with a null id stay, as do all columns."""
    gone = similar_components(docs, id_col, text_col, shingle, similarity).where("id is not null and component < id").select(F.col("id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
