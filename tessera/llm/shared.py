"""What the operators share: scratch tables in the shared folder, union-find, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
#: Bytes of a word at most that WordHashes takes, and bytes that it sums at once.
LONGEST, SEGMENT = 64, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where that is unset (tests, one machine) a folder of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_dirs[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}-{tag}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM remove a path when it ends; by Hadoop's file systems, so any shared store will do.

    Tables on which a lazy result depends live until then; those of rounds that are over go at once, by discard().
    """
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def materialize(df: DataFrame, tag: str, codec: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path, compression=codec)
    delete_at_exit(df.sparkSession, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df, which nothing reads any more, so that a long-lived driver keeps no old rounds."""
    remove(df.sparkSession, df.scratch)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def local_forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node reachable) with the same components as the edges u-v; no more edges than nodes."""
    if not len(u):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _mark(df: DataFrame) -> tuple[int, int]:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges(u, v); component is the smallest node reachable.

    Alternates large-star and small-star steps, each a map-side combined minimum and a join that adaptive
    execution can split where one node holds many edges; a round's edges go to the shared folder.
    Edges with a null end are ignored. No edges: no rows.
    """
    big, small = F.greatest("u", "v"), F.least("u", "v")
    now = materialize(edges.where("u is not null and v is not null and u <> v").select(big.alias("u"), small.alias("v")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u")
        after = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, materialize(after, "edges")
        discard(before)
        fresh = _mark(now)
        if fresh == mark:
            break
        mark = fresh
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each begins; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(space: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes) of the runs without space that don't cross the bounds of a text; space: for each byte."""
    if not len(space):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = ~space
    breaks = np.zeros(len(space) + 1, bool)
    breaks[bounds] = True
    starts = np.flatnonzero(inside & (breaks[:-1] | np.concatenate(([True], space[:-1]))))
    return starts, np.flatnonzero(inside & (breaks[1:] | np.concatenate((space[1:], [True])))) + 1 - starts


def mixed(x: np.ndarray) -> np.ndarray:
    """Positive 64-bit numbers whose every bit depends on all bits of x."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
    return np.maximum(x ^ x >> np.uint64(29), np.uint64(1))


class WordHashes:
    """Hashes of words in one array of bytes: sums of a random number a byte times a power of its place in the word."""

    def __init__(self, seed: int):
        self.of_byte = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        base = 0x5851F42D4C957F2D
        powers = lambda x: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(SEGMENT + LONGEST, x, np.uint64))))
        self.power, self.inverse = powers(base), powers(pow(base, -1, 1 << 64))

    def hashes(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One for each word; sizes are at most LONGEST."""
        out = np.empty(len(starts), np.uint64)
        edges = np.searchsorted(starts, np.arange(0, len(raw) + SEGMENT, SEGMENT))
        for k, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if i < j:
                part = raw[k * SEGMENT : (k + 1) * SEGMENT + LONGEST]
                sums = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(self.of_byte[part] * self.power[: len(part)], out=sums[1:])
                at = starts[i:j] - k * SEGMENT
                out[i:j] = (sums[at + sizes[i:j]] - sums[at]) * self.inverse[at]
        return mixed(out + sizes.astype(np.uint64))
