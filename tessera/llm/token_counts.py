"""Token counts that follow edits: a segment tree of pre-tokens for each document, kept in a table between edits."""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tessera.llm.shared import materialize

#: Pre-tokens of a leaf when a tree is built, and those over which an edited tree is built anew.
LEAF, FULL_LEAF = 128, 1024
#: Characters before an edit on which a pre-token's end can depend, by the pattern's look-ahead and contractions.
CONTEXT = 2
MAX_CACHE = 400_000
EDITS = "array<struct<start:bigint,stop:bigint,text:string>>"


def _bytes(numbers: np.ndarray) -> bytes:
    """Numbers as bytes: one each under 255, else 255 here and four more behind all."""
    big = numbers >= 255
    return int(len(numbers)).to_bytes(8, "little") + np.where(big, 255, numbers).astype(np.uint8).tobytes() + numbers[big].astype("<u4").tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u4", -1, 8 + n)
    return out


class Counter:
    """Splits text into pre-tokens and counts the tokens of each; a pre-token is encoded once while it is remembered."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        out = list(map(self.cache.get, pieces))
        if None in out:
            if len(self.cache) > MAX_CACHE:
                self.cache = {}
            encode, cache = self.encoding.encode_ordinary, self.cache
            for i, n in enumerate(out):
                if n is None:
                    piece = pieces[i]
                    n = cache.get(piece)
                    if n is None:
                        n = len(encode(piece))
                        if len(piece) <= 64:
                            cache[piece] = n
                    out[i] = n
        return out


class TokenTree:
    """A document as leaves of consecutive pre-tokens, and sums of characters and tokens over subtrees."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.reencoded = 0
        pieces = counter.pattern.findall(text)
        self._fill([(pieces[i : i + LEAF], counts[i : i + LEAF]) for counts in [counter.counts(pieces)] for i in range(0, len(pieces), LEAF)] or [([], [])])

    @classmethod
    def restored(cls, text: str, saved: bytes, counter: Counter) -> TokenTree:
        """The tree of text as saved() gave it; nothing is split or encoded."""
        tree = cls.__new__(cls)
        tree.counter, tree.reencoded = counter, 0
        lengths, counts = np.split(_numbers(zlib.decompress(saved)), 2)
        ends = np.cumsum(lengths)
        pieces = [text[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        counts = counts.tolist()
        tree._fill([(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)] or [([], [])])
        return tree

    def saved(self) -> bytes:
        """The leaves: pre-tokens' characters and tokens; with the text that is the whole tree."""
        lengths = np.array([len(p) for pieces, _ in self.leaves for p in pieces], np.int64)
        counts = np.array([n for _, own in self.leaves for n in own], np.int64)
        return zlib.compress(_bytes(np.concatenate([lengths, counts])), 1)

    def _fill(self, leaves: list[tuple[list[str], list[int]]]) -> None:
        self.leaves = leaves
        self.size = 1 << (len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (pieces, counts) in enumerate(leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(map(len, pieces)), sum(counts)
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pieces(self) -> int:
        return sum(len(p) for p, _ in self.leaves)

    def text(self) -> str:
        return "".join(p for pieces, _ in self.leaves for p in pieces)

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the character at; the end belongs to the last leaf."""
        node, first = 1, 0
        at = min(at, max(0, self.n_chars - 1))
        while node < self.size:
            node *= 2
            if at >= first + self.chars[node]:
                first += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), first

    def _update(self, leaf: int) -> None:
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(map(len, self.leaves[leaf][0])), sum(self.leaves[leaf][1])
        while node > 1:
            node //= 2
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, stop: int, text: str) -> None:
        """Put text in the place of characters start to stop; both are held within the document.

        Pre-tokens that end over CONTEXT characters before the edit stand. From there the new text is split until a
        split falls on an old one behind the edit; what follows that is as it was.
        """
        start = min(max(0, start), self.n_chars)
        stop = min(max(start, stop), self.n_chars)
        leaf, first = self._find(max(0, start - CONTEXT - 1))
        pieces, counts = self.leaves[leaf]
        kept, at = 0, first
        while kept < len(pieces) and at + len(pieces[kept]) < start - CONTEXT:
            at += len(pieces[kept])
            kept += 1
        # Old pre-tokens from (leaf, kept) on, leaf by leaf, as far as needed.
        old: list[tuple[int, list[str], list[int]]] = [(leaf, pieces[kept:], counts[kept:])]
        tail = "".join(pieces[kept:])
        following = leaf + 1
        while at + len(tail) < stop or following < len(self.leaves) and at + len(tail) < stop + 64:
            old.append((following, *self.leaves[following]))
            tail += "".join(self.leaves[following][0])
            following += 1
        shift = len(text) - (stop - start)
        while True:
            fresh = tail[: start - at] + text + tail[stop - at :]
            ends, here = {}, at
            for k, (_, own, _) in enumerate(old):
                for j, p in enumerate(own):
                    if here >= stop:
                        ends[here - at + shift] = (k, j)
                    here += len(p)
            done = following >= len(self.leaves)
            new, pos, sync = [], 0, None
            for m in self.counter.pattern.finditer(fresh):
                if pos in ends and pos >= start - at + len(text):
                    sync = ends[pos]
                    break
                if not done and m.end() + CONTEXT >= len(fresh):
                    break
                new.append(m.group())
                pos = m.end()
            else:
                if done:
                    sync = (len(old), 0)
            if sync is None and pos in ends and pos >= start - at + len(text):
                sync = ends[pos]
            if sync is not None:
                break
            old.append((following, *self.leaves[following]))
            tail += "".join(self.leaves[following][0])
            following += 1
        self.reencoded += sum(map(len, new))
        k, j = sync
        self.leaves[leaf] = (pieces[:kept] + new, counts[:kept] + self.counter.counts(new))
        if k == 0:
            self.leaves[leaf] = (self.leaves[leaf][0] + old[0][1][j:], self.leaves[leaf][1] + old[0][2][j:])
        for i, (number, own, own_counts) in enumerate(old[1:], 1):
            if i < k:
                self.leaves[number] = ([], [])
            elif i == k:
                self.leaves[number] = (own[j:], own_counts[j:])
            if i <= k:
                self._update(number)
        self._update(leaf)
        if len(self.leaves[leaf][0]) > FULL_LEAF:
            pieces = [p for own, _ in self.leaves for p in own]
            counts = [c for _, own in self.leaves for c in own]
            self._fill([(pieces[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(pieces), LEAF)])


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    """One for each worker process and file."""
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


TREE = "doc_id long, text string, n_pieces long, n_tokens long, leaves binary"


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str] | None = None) -> DataFrame:
    """The tree of each row of docs, as a row (doc_id, text, n_pieces, n_tokens, leaves) that can be written and edited later.

    Null and empty texts have no tokens. Whole texts are encoded, however long. A row stands alone, so null and repeated
    ids and rows and any other columns don't matter. No rows: none out.
    """
    path, pattern = files or tokenizer()

    def run(batches):
        own = counter(path, pattern)
        for batch in batches:
            trees = [TokenTree(t.as_py() or "", own) for t in batch.column(1)]
            numbers = [pa.array([t.n_pieces for t in trees], pa.int64()), pa.array([t.n_tokens for t in trees], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *numbers, pa.array([t.saved() for t in trees], pa.binary())], names=["doc_id", "text", "n_pieces", "n_tokens", "leaves"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, TREE)


def edit_trees(trees: DataFrame, edits: Column, files: tuple[str, str] | None = None, counts_only: bool = False) -> DataFrame:
    """The trees after their edits, with n_tokens_before, n_edits and n_chars_encoded beside; only what the edits touch is encoded.

    trees: what token_trees() or edit_trees() gave, read back from wherever it was written. edits: a column of type EDITS
    over it; each edit's positions are characters of the text as the edits before it left it. A null list, a null edit
    and a null text in one change nothing or are empty; positions outside the text are moved to its ends. counts_only:
    without text and leaves, for readers that want the numbers. A row stands alone. No rows: none out.
    """
    path, pattern = files or tokenizer()

    def run(batches):
        own = counter(path, pattern)
        for batch in batches:
            rows = []
            for text, leaves, todo in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                tree = TokenTree.restored(text.as_py() or "", leaves.as_py(), own)
                before, pieces = tree.n_tokens, tree.n_pieces
                todo = [e for e in todo.as_py() or () if e is not None]
                for e in todo:
                    tree.edit(e["start"] or 0, (e["stop"] if e["stop"] is not None else e["start"]) or 0, e["text"] or "")
                rows.append((pieces, before, len(todo), tree.n_tokens, tree.reencoded, *(() if counts_only else (tree.text(), tree.n_pieces, tree.saved()))))
            found = list(zip(*rows, strict=True)) or [()] * (5 if counts_only else 8)
            pieces, before, n_edits, after, encoded = (pa.array(c, pa.int64()) for c in found[:5])
            if counts_only:
                yield pa.RecordBatch.from_arrays([batch.column(0), pieces, before, n_edits, after, encoded], names=NAMES)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[5], pa.string()), pa.array(found[6], pa.int64()), after, pa.array(found[7], pa.binary()), before, n_edits, encoded], names=["doc_id", "text", "n_pieces", "n_tokens", "leaves", "n_tokens_before", "n_edits", "n_chars_encoded"])

    schema = ", ".join(f"{n} long" for n in NAMES) if counts_only else f"{TREE}, n_tokens_before long, n_edits long, n_chars_encoded long"
    return trees.select("doc_id", "text", "leaves", edits.cast(EDITS).alias("edits")).mapInArrow(run, schema)


NAMES = ["doc_id", "n_pieces", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_encoded"]


def revision(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The edits of the registered query: an insertion, a deletion of five characters and a replacement of twelve, at places that follow the id."""
    n = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1
    at = [F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), n) for k in range(3)]
    one = lambda start, length, text: F.struct(start.alias("start"), (start + length).alias("stop"), F.lit(text).alias("text"))
    return F.array(one(at[0], 0, " as amended,"), one(at[1], 5, ""), one(at[2], 12, "It's 2 new\n words"))


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Trees of all documents are written; a second job reads them back and applies each document's edits."""
    trees = materialize(token_trees(spark.read.parquet(f"{sf_dir}/documents.parquet")), "trees", "zstd")
    return edit_trees(trees, revision(), counts_only=True)
