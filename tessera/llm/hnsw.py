"""Embedding near-duplicates: a hierarchical navigable small-world graph per shard, audited, with exact checks."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import connected_components, local_forest, materialize

THRESHOLD = 0.9
#: Links of a node in an upper layer; twice as many in the lowest.
M = 12
#: Beam while building, and the beam a search begins with.
BUILD_BEAM, FIRST_BEAM = 48, 32
#: Bytes of vectors and links that a shard should hold, and shards at least; each query goes to every shard.
SHARD_BYTES, LEAST_SHARDS = 48 << 20, 4
#: Bytes of a block of queries, and blocks that a task takes to one copy of a shard: only blocks travel to every shard.
BLOCK_BYTES, TASK_BLOCKS = 1 << 20, 16
#: Queries of an audit of a shard, and the share of planted neighbours they have to find.
AUDIT_QUERIES, AUDIT_RECALL = 512, 0.995
#: Bytes of a table of visited nodes; decides how many queries walk side by side.
VISITED_BYTES = 32 << 20


class Hnsw:
    """The graph of unit vectors x (float32). Layers are built from the top, each from the nodes of the one above.

    Inserting goes in batches: a batch searches the graph as it is, its members are compared with one another,
    and links are chosen so that they point in different directions.
    """

    def __init__(self, x: np.ndarray, seed: int = 1):
        self.x = x
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(len(x))) / np.log(M)).astype(int)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # nodes by rank, links (by node) of width 2M or M; from the top
        order = np.lexsort((rng.random(len(x)), -level))
        top = max(0, int(level.max(initial=0)))
        while top and (level >= top).sum() < 2:
            top -= 1
        for at in range(top, -1, -1):
            nodes = order[: int((level >= at).sum())]
            self._build(nodes, 2 * M if at == 0 else M)

    def _build(self, nodes: np.ndarray, width: int) -> None:
        links = np.full((len(self.x), width), -1, np.int32)
        self.layers.append((nodes, links))
        done = min(len(nodes), 64)
        first = nodes[:done]
        near = self.x[first] @ self.x[first].T
        np.fill_diagonal(near, -2)
        self._connect(first, np.tile(first, (done, 1)), near, links)
        while done < len(nodes):
            batch = nodes[done : done + min(512, max(64, done // 2))]
            ids, sims = self._beam(len(self.layers) - 1, self.x[batch], self._enter(self.x[batch], len(self.layers) - 1, nodes[:1]), BUILD_BEAM)
            own = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(own, -2)
            k = min(len(batch), width)
            top = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids = np.concatenate([ids, batch[top]], axis=1)
            sims = np.concatenate([sims, np.take_along_axis(own, top, 1)], axis=1)
            self._connect(batch, ids, sims, links)
            done += len(batch)

    def _choose(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of each row's candidates up to width: first those nearer to the row than to any chosen one, then the nearest."""
        k = min(ids.shape[1], 2 * width)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        valid = (ids >= 0) & (sims > -1.5)
        v = self.x[np.maximum(ids, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        chosen = np.zeros(ids.shape, bool)
        closest = np.full(ids.shape, -2, np.float32)  # to a chosen one
        for j in range(k):
            take = valid[:, j] & (sims[:, j] > closest[:, j]) & (chosen.sum(1) < width)
            chosen[:, j] = take
            closest = np.where(take[:, None], np.maximum(closest, between[:, j]), closest)
        rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :width]
        out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        if out.shape[1] < width:
            out = np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1)
        return out.astype(np.int32)

    def _connect(self, rows: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: np.ndarray) -> None:
        width = links.shape[1]
        links[rows] = self._choose(ids, sims, width)
        # Back links: the new ones that a node gets, nearest first, compete with those it has.
        to, source = links[rows].ravel(), np.repeat(rows, width)
        ok = to >= 0
        to, source = to[ok], source[ok]
        if not len(to):
            return
        near = np.einsum("ij,ij->i", self.x[to], self.x[source])
        order = np.lexsort((-near, to))
        to, source = to[order], source[order]
        target, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        row = np.repeat(np.arange(len(target)), count)
        few = width // 3
        for group in (count <= few, count > few):  # most get few, so that they compare few
            if not group.any():
                continue
            number = np.cumsum(group) - 1
            wide = min(2 * width, int(count[group].max()))
            mine = group[row] & (place < wide)
            fresh = np.full((int(group.sum()), wide), -1, np.int64)
            fresh[number[row[mine]], place[mine]] = source[mine]
            old = links[target[group]].astype(np.int64)
            fresh[(fresh[:, :, None] == old[:, None, :]).any(2)] = -1
            both = np.concatenate([old, fresh], axis=1)
            room = (both >= 0).sum(1) <= width  # all fit
            all_in = both[room]
            links[target[group][room]] = np.take_along_axis(all_in, np.argsort(all_in < 0, axis=1, kind="stable"), 1)[:, :width]
            both, full = both[~room], target[group][~room]
            sims = np.where(both >= 0, np.einsum("ijk,ik->ij", self.x[np.maximum(both, 0)], self.x[full]), -2)
            links[full] = self._choose(both, sims, width)

    def _enter(self, q: np.ndarray, below: int, default: np.ndarray) -> np.ndarray:
        entry = np.tile(default[:1], (len(q), 1))
        if self.layers:
            entry = np.tile(self.layers[0][0][:1], (len(q), 1))
        for at in range(below):
            entry = self._beam(at, q, entry, 4)[0][:, :4]
        return entry

    def _beam(self, at: int, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        step = max(1, min(len(q), VISITED_BYTES // max(1, len(self.x))))
        parts = [self._walk(self.layers[at][1], q[i : i + step], entry[i : i + step], beam) for i in range(0, len(q), step)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _walk(self, links: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all rows of q side by side; each step opens the best unopened nodes of every beam."""
        n, size, wide = len(q), len(self.x), 1 if beam <= 8 else min(4, beam)
        ids, sims = np.full((n, beam), -1, np.int64), np.full((n, beam), -3, np.float32)
        todo = np.full((n, beam), -4, np.float32)  # similarity of the nodes that aren't opened
        visited = np.zeros(n * size, bool)
        entry = entry[:, :beam]
        ok = entry >= 0
        k = entry.shape[1]
        ids[:, :k] = entry
        sims[:, :k] = todo[:, :k] = np.where(ok, np.einsum("ijk,ik->ij", self.x[np.maximum(entry, 0)], q), -3)
        visited[(np.arange(n)[:, None] * size + entry)[ok]] = True
        live = np.arange(n)
        while len(live):
            open_sims = todo.take(live, axis=0)
            pick = open_sims.argmax(1)[:, None] if wide == 1 else np.argpartition(-open_sims, wide - 1, axis=1)[:, :wide]
            cell = pick + np.arange(len(live))[:, None] * beam
            good = open_sims.ravel().take(cell) > -3
            some = good.any(1)
            if not some.all():
                live, pick, good = live[some], pick[some], good[some]
                if not len(live):
                    break
            cell = pick + live[:, None] * beam
            todo.ravel()[cell] = -4
            row, slot = np.nonzero(good)
            near = links.take(ids.ravel().take(cell[row, slot]), axis=0)
            flat = near + (live[row] * size)[:, None]
            flat = flat[near >= 0]
            flat = flat[~visited.take(flat)]
            if not len(flat):
                continue
            visited[flat] = True
            flat.sort()
            flat = flat[np.concatenate(([True], flat[1:] != flat[:-1]))]
            r, c = np.divmod(flat, size)  # of all queries, ascending
            s = np.einsum("ij,ij->i", self.x.take(c, axis=0), q.take(r, axis=0))
            better = s > sims.min(1).take(r)
            r, c, s = r[better], c[better], s[better]
            if not len(r):
                continue
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            own, count = r[first], np.diff(np.append(first, len(r)))
            width = int(count.max())
            place = np.arange(len(r)) - np.repeat(first, count) + np.repeat(np.arange(len(own)) * (beam + width) + beam, count)
            all_ids, all_sims, all_todo = np.full((len(own), beam + width), -1, np.int64), np.full((len(own), beam + width), -3, np.float32), np.full((len(own), beam + width), -4, np.float32)
            all_ids[:, :beam], all_sims[:, :beam], all_todo[:, :beam] = ids.take(own, axis=0), sims.take(own, axis=0), todo.take(own, axis=0)
            all_ids.ravel()[place] = c
            all_sims.ravel()[place] = all_todo.ravel()[place] = s
            keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam] + (np.arange(len(own)) * (beam + width))[:, None]
            ids[own], sims[own], todo[own] = all_ids.ravel().take(keep), all_sims.ravel().take(keep), all_todo.ravel().take(keep)
        return ids, sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        last = len(self.layers) - 1
        ids, sims = self._beam(last, q, self._enter(q, last, self.layers[0][0]), beam)
        return np.where(sims > -2.5, ids, -1), sims


def unit(raw: np.ndarray) -> np.ndarray:
    big = np.abs(raw).max(axis=1, keepdims=True)
    scaled = raw / big
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def audited_beam(graph: Hnsw, exact: np.ndarray, threshold: float, beam: int = FIRST_BEAM, audit: int = AUDIT_QUERIES) -> int | None:
    """The beam with which the graph passes its audit; None: none that is worth more than a full scan does.

    The audit moves vectors of the shard to just above the threshold and searches for them; while too few are found
    the beam doubles. The graph is tried at every size; only after a failed audit a beam as wide as a sixteenth of
    the shard gives way to the scan.
    """
    n = len(exact)
    rng = np.random.default_rng(3)
    pick = np.unique(np.linspace(0, n - 1, min(n, audit)).astype(int))
    noise = rng.normal(size=(len(pick), exact.shape[1]))
    base = exact[pick]
    noise -= (noise * base).sum(1, keepdims=True) * base
    length = np.sqrt((noise * noise).sum(1, keepdims=True))
    cos = min(1.0, threshold + 0.01)
    moved = np.where(length > 1e-12, cos * base + np.sqrt(1 - cos * cos) * noise / np.maximum(length, 1e-12), base)
    moved = moved.astype(np.float32)
    while True:
        ids, sims = graph.search(moved, beam)
        found = (ids == pick[:, None]).any(1) | ((sims >= threshold - 1e-4).sum(1) > beam // 2)  # a crowded beam leads to a scan
        if found.mean() >= AUDIT_RECALL:
            return beam
        beam *= 2
        if beam >= n / 16:
            return None


def linked(graph: Hnsw, exact: np.ndarray, q: np.ndarray, threshold: float, beam: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(rows of q, nodes): all pairs with cosine >= threshold in double precision that the search finds.

    exact: the shard's unit vectors in double; q: the queries'. A query whose beam is half full of links may have
    more, so it scans the shard; without a beam all do.
    """
    n = len(exact)
    q32 = q.astype(np.float32)
    rows, nodes, scan = [], [], np.arange(len(q))
    if beam is not None:
        ids, sims = graph.search(q32, beam)
        near = (sims >= threshold - 1e-4) & (ids >= 0)
        crowded = near.sum(1) > beam // 2
        near &= ~crowded[:, None]
        r, c = np.nonzero(near)
        rows.append(r)
        nodes.append(ids[r, c])
        scan = np.flatnonzero(crowded)
    step = max(1, (8 << 20) // max(1, n))
    for i in range(0, len(scan), step):
        part = scan[i : i + step]
        r, c = np.nonzero(q32[part] @ graph.x.T >= threshold - 1e-4)
        rows.append(part[r])
        nodes.append(c)
    r, c = np.concatenate([np.empty(0, np.int64), *rows]), np.concatenate([np.empty(0, np.int64), *nodes])
    ok = np.zeros(len(r), bool)
    for i in range(0, len(r), 1 << 16):
        ok[i : i + (1 << 16)] = np.einsum("ij,ij->i", q[r[i : i + (1 << 16)]], exact[c[i : i + (1 << 16)]]) >= threshold
    return r[ok], c[ok]


def _pack(raw: np.ndarray, **arrays: np.ndarray) -> bytes:
    """The vectors, in single precision where that loses nothing, and other arrays."""
    with np.errstate(over="ignore"):
        short = raw.astype(np.float32)
    out = io.BytesIO()
    np.savez(out, raw=short if np.array_equal(short, raw) else raw, **arrays)
    return out.getvalue()


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component): for each row the number of other rows with cosine >= threshold, and its component.

    component: smallest id reachable by links, itself included. Vectors that are null, empty or zero, or hold null
    or non-finite components, link with nothing; so do vectors of different lengths with each other, and rows with
    a null id, whose component is null. Equal vectors are one node with a count, so copies cost nothing. Repeated
    ids are rows of their own that share a component. Only id_col and vector_col are read.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = materialize(rows.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("key", F.when(F.col("fine"), F.sha2(F.to_json(F.struct(F.transform("v", lambda c: c + 0.0).alias("v"))), 256))), "vectors")
    nodes = materialize(rows.where("fine").groupBy("key").agg(F.min("id").alias("node"), F.max("id").alias("last"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("dim", F.size("v")), "nodes")
    size = nodes.agg(F.sum(F.col("dim").cast("long")).alias("cells"), F.count("*").alias("n")).first()
    n_bytes = 8 * (size["cells"] or 0)
    n_shards = max(LEAST_SHARDS, -(-(n_bytes + 9 * M * size["n"]) // SHARD_BYTES))
    n_blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    n_tasks = -(-n_blocks // TASK_BLOCKS)

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", kind="stable")
        raw = np.array(frame["v"].tolist(), float)
        graph = Hnsw(unit(raw).astype(np.float32))
        arrays = {f"n{i}": a for i, (a, _) in enumerate(graph.layers)} | {f"l{i}": b for i, (_, b) in enumerate(graph.layers)}
        return pd.DataFrame({"dim": frame["dim"].iloc[:1].astype("int32"), "shard": frame["shard"].iloc[:1].astype("int32"), "data": [_pack(raw, node=frame["node"].to_numpy(), copies=frame["copies"].to_numpy(), layers=np.array([len(graph.layers)]), **arrays)]})

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": frame["dim"].iloc[:1].astype("int32"), "block": frame["block"].iloc[:1].astype("int32"), "data": [_pack(np.array(frame["v"].tolist(), float), node=frame["node"].to_numpy())]})

    shards = materialize(nodes.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")).groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, data binary"), "graphs")
    blocks = materialize(nodes.withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.lit(n_blocks)).cast("int")).groupBy("dim", "block").applyInPandas(block, "dim int, block int, data binary"), "blocks")
    # A shard goes to n_tasks tasks, a block to one task of each shard; in a task the shard comes before its blocks.
    sent = shards.withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1)))).withColumn("block", F.lit(-1)).select("dim", "shard", "task", "block", "data")
    sent = sent.unionByName(blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).withColumn("task", F.pmod("block", F.lit(n_tasks))))
    sent = sent.repartitionById(n_shards * n_tasks, (F.col("shard") * n_tasks + F.col("task")).cast("int")).sortWithinPartitions("dim", "shard", "task", "block")

    def search(batches):
        held = None
        for batch in batches:
            for i in range(batch.num_rows):
                place, data = batch.column(0)[i].as_py(), np.load(io.BytesIO(batch.column(1)[i].as_py()))
                exact, mine = unit(data["raw"].astype(np.float64)), data["node"]
                if place["block"] < 0:
                    graph = Hnsw.__new__(Hnsw)
                    graph.x = exact.astype(np.float32)
                    graph.layers = [(data[f"n{k}"], data[f"l{k}"]) for k in range(int(data["layers"][0]))]
                    held = (place["dim"], place["shard"]), graph, exact, mine, data["copies"], audited_beam(graph, exact, threshold)
                    continue
                if held is None or held[0] != (place["dim"], place["shard"]):
                    continue  # no vector of this length is in the shard
                _, graph, shard, node, copies, beam = held
                r, c = linked(graph, shard, exact, threshold, beam)
                other = mine[r] != node[c]
                r, c = r[other], c[other]
                count = np.bincount(r, copies[c], len(mine)).astype(np.int64)
                some = np.flatnonzero(count)
                u, v = local_forest(mine[r], node[c])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([mine[some], u])), pa.array(np.concatenate([count[some], np.zeros(len(u), np.int64)])), pa.array([None] * len(some) + v.tolist(), pa.int64())], names=["node", "n", "other"])

    found = materialize(sent.select(F.struct("dim", "shard", "block").alias("place"), "data").mapInArrow(search, "node long, n long, other long"), "links")
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    repeated = rows.where("fine").groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("id")
    bridges = rows.where("fine").join(repeated, "id").join(nodes.select("key", "node"), "key").select(F.col("id").alias("u"), F.col("node").alias("v"))
    components = connected_components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")).unionByName(bridges)).withColumnRenamed("node", "member")
    named = nodes.select("key", "node", "copies").join(counts, "node", "left").join(components, F.col("node") == F.col("member"), "left")
    named = named.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    return rows.join(named, "key", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
