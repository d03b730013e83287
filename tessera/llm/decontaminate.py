"""Benchmark decontamination by spaced seeds: masks that skip positions find passages in spite of substitutions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of the window around a hit that must agree, and the share of them; items with fewer words need all of theirs.
WINDOW = 13
SIMILARITY = 0.8
#: 1: the word counts, 0: any word may stand there. However the two words lie in which a window may differ, one of these
#: fits beside them at some place (a test tries all), so that no window of a passage is missed.
MASKS = ("11101011", "110100111")
#: For items shorter than a window, whose words all have to agree.
SHORT_MASK = "111111"
#: Items with fewer words are no evidence and match nothing.
LEAST_WORDS = 6
#: Characters of the items that one scan of the documents takes along; more items are taken in more scans.
BLOCK_CHARS = 16_000_000
_SPACED = bytes(32 if b < 48 or 58 <= b < 97 or 123 <= b < 128 else b for b in range(256))
_PAD = max(map(len, (*MASKS, SHORT_MASK)))
FOUND = "doc_id long, item_id long, start_word long, end_word long, n_same long, similarity double"


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII marks part words and vanish."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


class SeedIndex:
    """The seeds of some items: sorted hashes, each with the places that have it."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            own = words(text)
            if len(own) >= LEAST_WORDS:
                self.items.append((item_id, np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own], np.int64)))
        self.masks = [m for m, used in ((m, any((len(ids) < WINDOW) == (m == SHORT_MASK) for _, ids in self.items)) for m in (*MASKS, SHORT_MASK)) if used]
        rng = np.random.default_rng(7)
        self.factors = [rng.integers(1, 1 << 63, len(m), dtype=np.uint64) | np.uint64(1) for m in self.masks]
        hashes, owners, places = [], [], []
        for k, (_, ids) in enumerate(self.items):
            for m, mask in enumerate(self.masks):
                if (len(ids) < WINDOW) != (mask == SHORT_MASK):
                    continue
                h = self.hashes(ids, m)
                hashes.append(h)
                owners.append(np.full(len(h), k))
                places.append(np.arange(len(h)))
        joined = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.owner = np.concatenate(owners)[order] if hashes else np.empty(0, np.int64)
        self.place = np.concatenate(places)[order] if hashes else np.empty(0, np.int64)
        self.seeds, self.first, self.count = np.unique(joined[order], return_index=True, return_counts=True)
        self.marked = np.zeros(1 << 20, bool)
        self.marked[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def hashes(self, ids: np.ndarray, mask: int) -> np.ndarray:
        """The hash at each place where the whole mask fits."""
        n = len(ids) - len(self.masks[mask]) + 1
        out = np.full(max(0, n), mask + 1, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if n > 0:
            u = ids.astype(np.uint64)
            for j, on in enumerate(self.masks[mask]):
                if on == "1":
                    out += (u[j : j + n] + np.uint64(0x632BE59BD9B4E019)) * self.factors[mask][j]
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
        return out

    def hits(self, ids: np.ndarray, lows: np.ndarray) -> np.ndarray:
        """Distinct columns (start of the item in ids, item, document that holds the seed); lows: where documents start."""
        starts, owners, holders = [], [], []
        for m, mask in enumerate(self.masks):
            n = len(ids) - len(mask) + 1
            if n <= 0:
                continue
            known = np.ones(n, bool)
            for j, on in enumerate(mask):
                if on == "1":
                    known &= ids[j : j + n] > 0
            if not known.any():
                continue
            h = self.hashes(ids, m)
            at = np.flatnonzero(known & self.marked[(h >> np.uint64(44)).astype(np.int64)])
            seed = np.minimum(np.searchsorted(self.seeds, h[at]), len(self.seeds) - 1)
            ok = self.seeds[seed] == h[at]
            at, seed = at[ok], seed[ok]
            size = self.count[seed]
            rows = np.repeat(self.first[seed] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum()) if len(seed) else np.empty(0, np.int64)
            starts.append(np.repeat(at, size) - self.place[rows])
            owners.append(self.owner[rows])
            holders.append(np.repeat(np.searchsorted(lows, at, "right") - 1, size))
        if not starts or not sum(map(len, starts)):
            return np.empty((3, 0), np.int64)
        return np.unique(np.stack([np.concatenate(starts), np.concatenate(owners), np.concatenate(holders)]), axis=1)

    def verify(self, ids: np.ndarray, low: int, high: int, start: int, owner: int) -> tuple[int, int, int] | None:
        """(start, end, same words) of the passage of the item in ids[low:high] on this diagonal, if a window of it agrees."""
        item = self.items[owner][1]
        a, b = max(low, start), min(high, start + len(item))
        need = min(WINDOW, len(item))
        if b - a < need:
            return None
        same = ids[a:b] == item[a - start : b - start]
        share = 1.0 if len(item) < WINDOW else SIMILARITY
        total = np.concatenate(([0], np.cumsum(same)))
        good = np.flatnonzero(total[need:] - total[:-need] >= share * need - 1e-9)
        if not len(good):
            return None
        first, last = int(good[0]), int(good[-1]) + need
        return a + first, a + last, int(total[last] - total[first])


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        if block and chars + len(row[1]) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((row[0], row[1]))
        chars += len(row[1])
    if block:
        yield block


class Scanner:
    """Finds the passages of some items in batches of texts; the index is built once in each worker process."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items, self.index = items, None

    def __getstate__(self):
        return {"items": self.items, "index": None}

    def find(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item id, start, end, same words) for each row and item with a passage."""
        if self.index is None:
            self.index = SeedIndex(self.items)
        seeds, at = self.index, 0
        get = seeds.vocabulary.get
        while at < len(texts):  # texts side by side, with a gap that no seed can cross
            parts, bounds, first, size = [], [], at, 0
            while at < len(texts) and size < 1 << 20:
                own = words(texts[at].as_py())
                parts.append(np.fromiter(map(get, own, repeat(0)), np.int64, len(own)))
                parts.append(np.zeros(_PAD, np.int64))
                bounds.append((size, size + len(own)))
                size += len(own) + _PAD
                at += 1
            ids = np.concatenate(parts)
            lows = np.array([b[0] for b in bounds])
            best: dict[tuple[int, int], tuple] = {}
            for start, k, d in seeds.hits(ids, lows).T.tolist():  # the item may reach beyond the document on both sides
                got = seeds.verify(ids, *bounds[d], start, k)
                if got and ((d, k) not in best or got[2] > best[d, k][2]):
                    best[d, k] = got
            for (d, k), (a, b, s) in sorted(best.items()):
                yield first + d, seeds.items[k][0], a - bounds[d][0], b - bounds[d][0], s


def _scan(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    scanner = Scanner(items)

    def run(batches):
        for batch in batches:
            rows = [(batch.column(0)[row].as_py(), item, a, b, s, s / (b - a)) for row, item, a, b, s in scanner.find(batch.column(1))]
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.mapInArrow(run, FOUND)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item of which it holds a passage, with the place of the passage in words.

    A passage: on one alignment of the item with the whole text, words from the first to the last window of WINDOW
    words of which SIMILARITY agree; an item with fewer words than that has to be there as it is, and one with
    under LEAST_WORDS never matches. A shared seed starts each comparison, and each such window has one, so all
    passages are found. Null and empty texts hold nothing; very long ones are searched whole. Rows with a null id can
    be found too, with a null doc_id. Repeated rows give a row each; ties take the first place. Items that are null or
    without an id are passed over; repeated items give a row each. Only the named columns are read, so others can have
    any names. No documents or no items: no rows.
    """
    out = None
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    for block in item_blocks(benchmark, item_col, item_text):
        one = _scan(rows, block)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], FOUND)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a passage of the benchmark; each row is judged where it is, so none is shuffled.

    What a passage is, contaminated() says, and what nulls, long texts and repeated items do. All other rows stay, with
    all their columns, whatever their names: null and empty texts, null ids, repeated rows. No items: all rows stay.
    """
    for block in item_blocks(benchmark, item_col, item_text):
        docs = docs.mapInArrow(_cleaner(Scanner(block), docs.columns.index(text_col)), docs.schema)
    return docs


def _cleaner(scanner: Scanner, column: int):
    def run(batches):
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[row for row, *_ in scanner.find(batch.column(column))] or slice(0, 0)] = False
            yield batch.filter(pa.array(keep))

    return run


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
