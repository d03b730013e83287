"""Line deduplication against levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import delete_at_exit, discard, materialize, remove, scratch_path

WHITE = b" \t\n\x0b\x0c\r"
MIN_CODE_POINTS = 10
#: Runs of one level that are merged to one of the next.
FANOUT = 3
#: Slices of the ids that the query takes one after the other.
BATCHES = 4


def line_key(line: bytes) -> bytes | None:
    """128-bit hash of the stripped line with A-Z lower-cased; None if that has under MIN_CODE_POINTS code points."""
    key = line.strip(WHITE).lower()  # of bytes, so only A-Z
    if len(key) < MIN_CODE_POINTS or len(key) < 4 * MIN_CODE_POINTS and len(key.decode("utf-8", "surrogatepass")) < MIN_CODE_POINTS:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key): the distinct keys of each row's whole text."""

    def run(batches):
        for batch in batches:
            ids, keys = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {line_key(x) for x in (text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")}
                own.discard(None)
                ids += [i] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["id", "key"])

    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, key binary")


class LineRuns:
    """Line hashes seen so far: levels of sorted runs, each run a table bucketed and sorted by key, with its keys once.

    add() takes the next batch: its keys are merge-joined with the runs one after the other, which are read as they lie,
    without exchange or sort, and its new keys become a run of level 0. FANOUT runs of a level are compacted to one of
    the next, so that there are never more than FANOUT - 1 runs in a level and a key is rewritten once a level.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self._paths: dict[str, str] = {}

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(run) for level in self.levels for run in level]

    def _push(self, keys: DataFrame, level: int) -> None:
        name = f"tessera_run_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, "run")
        keys.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        delete_at_exit(self.spark, path)
        self._paths[name] = path
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            merged, full = None, self.levels[level]
            for one in map(self.spark.table, full):
                merged = one if merged is None else merged.unionByName(one)
            self.levels[level] = []
            self._push(merged, level + 1)
            self._forget(full)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove(self.spark, self._paths.pop(name))

    def close(self) -> None:
        """Drop all runs; what add() returned has to be written before."""
        self._forget([run for level in self.levels for run in level])
        self.levels = []

    def marked(self, keys: DataFrame) -> DataFrame:
        """(key, first, last, known) for each key of keys(id, key): its smallest and largest id, and whether a run has it."""
        out = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).withColumn("known", F.lit(False))
        for run in self.runs():
            out = out.join(run.withColumn("hit", F.lit(True)).hint("merge"), "key", "left").withColumn("known", F.col("known") | F.col("hit").isNotNull()).drop("hit")
        return out

    def add(self, keys: DataFrame) -> DataFrame:
        """(id, key) rows of keys(id, key) that are repeats: the key is in a run, or a smaller id of the batch has it."""
        with _sorted_scans(self.spark):
            firsts = materialize(self.marked(keys), "firsts")
        again = firsts.where("known or first < last").select("key", "first", "known")
        repeats = keys.join(again.hint("merge"), "key").where("known or id > first").select("id", "key")
        self._push(firsts.where("not known").select("key"), 0)
        return repeats


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Let Spark know that a bucket of one file is sorted, and read buckets as such, while a plan is made and run."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.enabled": "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _rest(text: str | None, gone: set[bytes]) -> tuple[int, int, str]:
    lines = (text or "").split("\n")
    if not gone:
        return len(lines), 0, text or ""
    kept = [x for x in lines if line_key(x.encode("utf-8", "surrogatepass")) not in gone]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, digest_only: bool = False) -> DataFrame:
    """docs with the lines dropped that a document with a smaller id holds, and n_lines, n_dropped beside.

    Keys of at least MIN_CODE_POINTS code points lose their lines everywhere except in the smallest id that
    holds them, where all of them stay. digest_only: instead (id, n_lines, n_dropped, kept_sha256). The batches
    are slices of the ids in ascending order, so "seen before" and "in a smaller id" are the same. A null or
    empty text is one empty line and becomes an empty text. Rows with a null id keep all lines. Repeated ids are
    one document: its lines stay in each of its rows. Very long texts and lines are hashed whole, a line by its 128-bit
    hash alone, and the row of a text travels with the keys that it loses. A clashing n_lines or n_dropped column is
    replaced; other columns can have any names. No rows: none out.
    """
    spark = docs.sparkSession
    slices = F.pmod(F.lit(0), F.lit(1))
    span = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [(i + 1) / batches for i in range(batches - 1)], 1000)).first()[0] or []
    for edge in sorted(set(span)):
        slices = slices + (F.col("id") > F.lit(edge)).cast("int")
    path_keys = materialize(line_keys(docs, id_col, text_col).withColumn("slice", slices), "keys")
    runs, gone = LineRuns(spark), None
    for b in range(len(set(span)) + 1):
        part = runs.add(path_keys.where(F.col("slice") == b).drop("slice"))
        gone = part if gone is None else gone.unionByName(part)
    lists = materialize(gone.groupBy("id").agg(F.collect_set("key").alias("__keys")).withColumnRenamed("id", "__id"), "gone")
    runs.close()
    discard(path_keys)
    kept_fields = [] if digest_only else [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    base = docs.select(F.col(id_col).cast("long").alias("__own"), F.col(text_col).cast("string").alias("__text"), *([] if digest_only else [F.struct(*[F.col(f"`{f.name}`") for f in kept_fields]).alias("__row")]))
    joined = base.join(lists, base["__own"] == lists["__id"], "left")

    if digest_only:
        schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept_sha256", T.StringType())])

        def digest(parts):
            for batch in parts:
                out = [], [], [], []
                for i, text, keys in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    n, dropped, rest = _rest(text.as_py(), set(keys.as_py() or ()))
                    for column, value in zip(out, (i, n, dropped, hashlib.sha256(rest.encode("utf-8", "surrogatepass")).hexdigest()), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], names=schema.names)

        return joined.select("__own", "__text", "__keys").mapInArrow(digest, schema)

    def rewrite(parts):
        for batch in parts:
            counts, drops, texts = [], [], []
            for text, keys in zip(batch.column(1), batch.column(3), strict=True):
                n, dropped, rest = _rest(text.as_py(), set(keys.as_py() or ()))
                counts.append(n)
                drops.append(dropped)
                texts.append(rest)
            row = batch.column(2)
            columns = [pa.array(texts, pa.string()) if f.name == text_col else row.field(k) for k, f in enumerate(kept_fields)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(drops, pa.int64())], names=[f.name for f in kept_fields] + ["n_lines", "n_dropped"])

    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in kept_fields]
    return joined.select("__own", "__text", "__row", "__keys").mapInArrow(rewrite, T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs, digest_only=True).withColumnRenamed("id", "doc_id")


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id > f.first, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
