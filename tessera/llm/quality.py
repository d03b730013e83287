"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import materialize

N_FEATURES = 192
#: Width of the Gaussian kernel, in standard deviations of all statistics together.
WIDTH = 4.0
RIDGE = 1e-3
SEED = 20_240_501
#: Equal-width cells of raw scores that calibration pools; the driver gets no more rows than these.
CELLS = 2048
#: Partial sums that the driver adds; all others are added on executors.
FAN_IN = 16

STATISTICS = (
    "log_chars", "log_words", "word_length", "letters", "upper", "digits", "spaces", "marks", "odd_marks", "pipes", "line_ends", "per_line",
    "distinct_words", "repeated_next", "one_letter", "long_words", "capital_words", "all_upper_words", "marked_words", "few_words", "distinct_lines",
)

_KIND = np.zeros(256, np.int64)  # 0 other bytes, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence mark, 6 odd mark, 7 pipe, 8 line end, 9 beyond ASCII
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[32, 9, 11, 12, 13]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 5
_KIND[[ord(c) for c in "!@#$%^&*+=~`<>[]{}/\\_"]] = 6
_KIND[ord("|")] = 7
_KIND[10] = 8
_KIND[128:] = 9
_MARKED = re.compile(r"[A-Za-z0-9À-ɏ][!@#$%^&*+=~|<>{}\\/_]{1,}")


def statistics(text: str | None) -> np.ndarray:
    """The numbers of STATISTICS for a whole text, null being empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    k = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=10) if raw else np.zeros(10)
    words = text.split()
    w = max(1, len(words))
    own = set(words)
    repeats = sum(map(str.__eq__, words, words[1:])) if len(words) > 1 else 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = text.split("\n")
    upper = sum(map(str.isupper, words))
    titles = sum(map(str.istitle, words))
    top = 1.0 - len(own) / w if len(own) < 3 else 0.0
    return np.array([
        np.log1p(len(raw)), np.log1p(len(words)), lengths.mean() if len(words) else 0.0, (k[1] + k[2] + k[9]) / n, k[2] / n, k[3] / n, k[4] / n, k[5] / n, k[6] / n, k[7] / n, k[8] / n, np.log1p(len(words) / len(lines)),
        len(own) / w, repeats / w, (lengths == 1).sum() / w, (lengths > 15).sum() / w, titles / w, upper / w, len(_MARKED.findall(text)) / w, top, len(set(lines)) / len(lines),
    ])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) of each row's whole text."""

    def run(batches):
        for batch in batches:
            rows = [statistics(t.as_py()).astype(np.float64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps_at: np.ndarray
    steps: np.ndarray

    def expand(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale, self.frequencies, self.phases)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.expand(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.steps_at, self.steps)


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray, frequencies: np.ndarray, phases: np.ndarray) -> np.ndarray:
    """Random Fourier features, whose inner products approximate a Gaussian kernel; the statistics and a constant beside."""
    z = np.clip((stats - mean) / scale, -8, 8)
    return np.concatenate([np.sqrt(2 / len(phases)) * np.cos(z @ frequencies + phases), 0.1 * z, np.ones((len(z), 1))], axis=1)


def _sums(rows: DataFrame, size: int, part) -> np.ndarray:
    """The sum of part(stats, labels) over partitions: each gives one row, FAN_IN groups add those, the driver the groups."""

    def partial(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                stats = np.array(batch.column(0).to_pylist(), float)
                own = part(stats, np.array(batch.column(1).to_pylist(), float))
                total = own if total is None else total + own
        if total is not None:
            from pyspark import TaskContext

            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % FAN_IN], pa.int32()), pa.array([total.astype(np.float64).tobytes()], pa.binary())], names=["g", "total"])

    def added(batches):
        total = np.zeros(size)
        seen = False
        for batch in batches:
            for x in batch.column(1):
                total, seen = total + np.frombuffer(x.as_py(), np.float64), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["g", "total"])

    groups = rows.select("stats", "label").mapInArrow(partial, "g int, total binary").repartition(FAN_IN, "g").mapInArrow(added, "g int, total binary")
    return sum((np.frombuffer(bytes(r["total"]), np.float64) for r in groups.collect()), np.zeros(size))


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit with least squared error."""
    out: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        out.append([v, w, 1])
        while len(out) > 1 and out[-2][0] >= out[-1][0]:
            v2, w2, n2 = out.pop()
            v1, w1, n1 = out.pop()
            out.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([x[0] for x in out], [int(x[2]) for x in out])


def fit(rows: DataFrame) -> Model | None:
    """A model from rows(stats, label); None without any. All sums are over partitions, so nothing but sums moves."""
    d = len(STATISTICS)
    rng = np.random.default_rng(SEED)
    frequencies, phases = rng.normal(size=(d, N_FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, N_FEATURES)
    moments = _sums(rows, 2 * d + 1, lambda x, y: np.concatenate([x.sum(0), (x**2).sum(0), [len(x)]]))
    n = moments[-1]
    if not n:
        return None
    mean = moments[:d] / n
    scale = np.sqrt(np.maximum(moments[d : 2 * d] / n - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    p = N_FEATURES + d + 1

    def normal(x, y):
        z = fourier(x, mean, scale, frequencies, phases)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _sums(rows, p * p + p, normal)
    gram, right = sums[: p * p].reshape(p, p), sums[p * p :]
    penalty = np.full(p, RIDGE * n)
    penalty[-1] = 1e-9 * n
    model = Model(mean, scale, frequencies, phases, np.linalg.solve(gram + np.diag(penalty), right), np.array([0.0]), np.array([0.5]))

    def cells(x, y):
        at = np.clip(((model.raw(x) + 0.5) / 2 * CELLS).astype(int), 0, CELLS - 1)
        return np.concatenate([np.bincount(at, minlength=CELLS), np.bincount(at, y, CELLS)])

    pooled = _sums(rows, 2 * CELLS, cells)
    count, ones = pooled[:CELLS], pooled[CELLS:]
    full = np.flatnonzero(count)
    model.steps_at = (full + 0.5) / CELLS * 2 - 0.5
    model.steps = np.clip(pool_adjacent(ones[full] / count[full], count[full]), 0.0, 1.0)
    return model


def is_held_out(id_col) -> object:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(3)) == 1


def _taught(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(stats, label) of the rows of stats(id, stats) that a label teaches."""
    taught = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label")).where("id is not null and label in (0, 1)").where(~is_held_out(F.col("id")))
    return stats.join(taught, "id").select("stats", "label")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", statistics_table: DataFrame | None = None) -> DataFrame:
    """(id, held_out, score, predicted) of each row of docs.

    Learns from labels(doc_id, quality) whose id isn't held out, and only from texts. Labels that are null or not 0
    or 1 teach nothing; several labels of an id teach one each; without any label the score is 0.5. Null and empty
    texts get the score of an empty text; very long ones are measured whole. Rows with a null id are scored, never
    held out and teach nothing. Repeated rows are scored each for itself. Equal raw scores get equal scores. Of docs
    only id_col and text_col are read, so other columns can have any names. No rows: none out.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "statistics") if statistics_table is None else statistics_table
    model = fit(materialize(_taught(stats, labels), "taught"))

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), float).reshape(batch.num_rows, len(STATISTICS))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32), pa.int32())], names=["id", "held_out", "score", "predicted"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return stats.select("id", F.coalesce(is_held_out(F.col("id")), F.lit(False)).alias("held_out"), "stats").mapInArrow(run, schema)


def crc_held_out(doc_id: int) -> bool:
    """The same fold in plain Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted 0; the columns and all other rows stay as they are.

    Statistics are written beside their row, so that a row is judged where it is and no text is shuffled. What
    score_documents() says of nulls, empty and very long texts, labels and repeated rows holds here; rows with a null
    id are judged as well. Other columns can have any names.
    """
    columns, place = docs.columns, docs.columns.index(text_col)
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def measure(batches):
        for batch in batches:
            rows = [statistics(t.as_py()).astype(np.float64) for t in batch.column(0).field(place).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["row", "stats"])

    rows = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).mapInArrow(measure, schema), "measured")
    model = fit(materialize(_taught(rows.select(F.col("row").getField(id_col).cast("long").alias("id"), "stats"), labels), "taught"))
    if model is None:
        return rows.select("row.*")

    def judge(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, len(STATISTICS))
            kept = batch.column(0).filter(pa.array(model.score(x) >= 0.5))
            yield pa.RecordBatch.from_arrays(kept.flatten(), names=columns)

    return rows.mapInArrow(judge, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, labels).withColumnRenamed("id", "doc_id")
