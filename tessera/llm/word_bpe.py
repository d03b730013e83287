"""Token ids of a word-end BPE file for many texts at once, in NumPy: words are hashed, looked up, and merged once.

The ids equal those of the tokenizers library, which encodes the rare words that the fast way leaves out.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from tessera.llm.shared import LONGEST, WordHashes, column_bytes, split_words

#: Slots of the table of known words (a power of two), the share that is filled and the ids that are kept before all are
#: forgotten. Bounds memory between blocks: 12 bytes a slot, 8 a word and 4 an id, 75 MB in all.
WORD_BITS, FULL = 21, 0.6
MAX_IDS = 8 << 20
#: Bytes of the texts that are encoded at once; a text is never cut.
BLOCK = 4 << 20
NO_RANK = np.int32(1 << 30)


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class HashTable:
    """Positive 64-bit keys -> int32 values, by open addressing over arrays."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add distinct keys that aren't there; the table grows where they don't fit."""
        if self.n + len(keys) > 0.85 * len(self.keys):
            held = np.flatnonzero(self.keys)
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self.__init__(max(self.bits, int(np.ceil(np.log2(len(keys) / 0.6)))))
        self.n += len(keys)
        todo, at = np.arange(len(keys)), self._slots(keys)
        while len(todo):
            free = self.keys[at] == 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], values[todo[put]]
            todo, at = todo[~put], at[~put] + 1 & len(self.keys) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The keys' values, -1 where there is none."""
        at = self._slots(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((got != keys) & (got != 0))
        at = at[todo]
        while len(todo):
            at = at + 1 & len(self.keys) - 1
            got = self.keys[at]
            hit = got == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            go = ~hit & (got != 0)
            todo, at = todo[go], at[go]
        return out


class PairTable:
    """(left, right) -> (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.table, self.merged = HashTable(18), np.append(merged, 0).astype(np.int32)
        self.table.put(self._keys(left, right), np.arange(len(left), dtype=np.int32))

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)) + np.uint64(1)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self.table.find(self._keys(left, right))
        return np.where(rank < 0, NO_RANK, rank), self.merged[rank]


class WordEncoder:
    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        end = spec["model"]["end_of_word_suffix"]
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.parts = regex.compile(f"(?:{pattern})|\n")
        self.plain = regex.compile(r"(?V0)[!-įı-ɏ]*")
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + end] for c in chars], np.int32)
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        self.table = PairTable(ids[:, 0], ids[:, 1], ids[:, 2])
        self.words = WordHashes(11)
        self._forget()

    def _forget(self) -> None:
        self.known = HashTable(WORD_BITS)
        self.ids, self.first, self.n = np.empty(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keep lists of these sizes, one after the other; their places."""
        used = int(self.first[self.n])
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.empty(len(ids) + used // 2, np.uint32)])
        if self.n + len(sizes) >= len(self.first):
            self.first = np.concatenate([self.first[: self.n + 1], np.zeros(len(sizes) + self.n // 2, np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.first[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)
        return np.arange(self.n - len(sizes), self.n, dtype=np.int32)

    def _take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists at these places, joined, and their sizes."""
        start = self.first[places]
        sizes = self.first[places + 1] - start
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(start - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def bpe(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the merges of all pieces, none empty, run side by side: each round joins every piece's lowest pair."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        piece = np.repeat(np.arange(len(pieces)), lengths)
        is_last = np.zeros(len(raw), bool)
        is_last[np.cumsum(lengths) - 1] = True
        ids = np.where(is_last, self.last[raw], self.inner[raw])
        rank, made = np.full(len(ids), NO_RANK, np.int32), np.zeros(len(ids), np.int32)
        inside = np.flatnonzero(~is_last)
        rank[inside], made[inside] = self.table.find(ids[inside], ids[inside + 1])
        done_piece, done_ids = [], []
        while len(ids):
            starts = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            size = np.diff(np.append(starts, len(ids)))
            low = np.minimum.reduceat(rank, starts)
            over = low == NO_RANK
            if over.any():
                gone = np.repeat(over, size)
                done_piece.append(piece[gone])
                done_ids.append(ids[gone])
                stay = ~gone
                ids, piece, rank, made = ids[stay], piece[stay], rank[stay], made[stay]
                size, low = size[~over], low[~over]
                if not len(ids):
                    break
            join = rank == np.repeat(low, size)
            if (join[1:] & join[:-1]).any():  # a run of equal symbols: from the left, every second pair
                at = np.arange(len(join))
                before = np.maximum.accumulate(np.where(join, -1, at))
                join &= (at - before) % 2 == 1
            where = np.flatnonzero(join)
            ids[where] = made[where]
            keep = np.ones(len(ids), bool)
            keep[where + 1] = False
            moved = np.cumsum(keep)[where] - 1
            ids, piece, rank, made = ids[keep], piece[keep], rank[keep], made[keep]
            touched = np.zeros(len(ids), bool)
            touched[moved] = touched[moved[moved > 0] - 1] = True
            again = np.flatnonzero(touched)
            rank[again] = NO_RANK
            ok = again[again + 1 < len(ids)]
            ok = ok[piece[ok] == piece[ok + 1]]
            rank[ok], made[ok] = self.table.find(ids[ok], ids[ok + 1])
        if not done_ids:
            return np.empty(0, np.uint32), lengths * 0
        piece, ids = np.concatenate(done_piece), np.concatenate(done_ids)
        order = np.argsort(piece, kind="stable")
        return ids[order].astype(np.uint32), np.bincount(piece, minlength=len(pieces))

    def _pieces_places(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of distinct pre-tokens, of which those that aren't known are merged; alone they are words, too."""
        places = self.known.find(keys)
        fresh = np.flatnonzero(places < 0)
        if len(fresh):
            data, a = raw.tobytes(), starts[fresh]
            places[fresh] = self._add(*self.bpe([data[i:j] for i, j in zip(a.tolist(), (a + sizes[fresh]).tolist(), strict=True)]))
            self.known.put(keys[fresh], places[fresh])
        return places

    def _letters_places(self, words: list[bytes]) -> np.ndarray:
        """Places of words of ASCII letters in lower case: each is one pre-token."""
        raw, sizes = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        keys, first, code = np.unique(self.words.hashes(raw, starts, sizes), return_index=True, return_inverse=True)
        return self._pieces_places(raw, starts[first], sizes[first], keys)[code]

    def _plain_places(self, words: list[str]) -> np.ndarray:
        """Places of words of the plain alphabet, by way of their pre-tokens, of which those that aren't known are merged."""
        parts = self.parts.findall("\n".join(words).lower())
        raw = np.frombuffer(" ".join(parts).encode("utf-8"), np.uint8)
        bounds = np.flatnonzero(raw == 32)
        starts, ends = np.concatenate(([0], bounds + 1)), np.append(bounds, len(raw))
        sizes = ends - starts
        gap = raw[starts] == 10  # between one word's pre-tokens and the next one's
        owner = np.cumsum(gap)[~gap]
        starts, sizes = starts[~gap], sizes[~gap]
        keys, first, code = np.unique(self.words.hashes(raw, starts, sizes), return_index=True, return_inverse=True)
        places = self._pieces_places(raw, starts[first], sizes[first], keys)
        place, n = places[code], np.bincount(owner, minlength=len(words))
        out = np.empty(len(words), np.int32)
        single = n == 1
        of_single = single[owner]
        out[single] = place[of_single]
        ids, lengths = self._take(place[~of_single])
        several = np.flatnonzero(~single)
        out[several] = self._add(ids, np.bincount(np.searchsorted(several, owner[~of_single]), lengths, len(several)).astype(np.int64))
        return out

    def _library(self, words: list[str]) -> np.ndarray:
        ids = [np.array(e.ids, np.uint32) for e in self.library.encode_batch(words, add_special_tokens=False)]
        return self._add(np.concatenate(ids), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn(self, words: list[str]) -> np.ndarray:
        """Places of words that aren't known."""
        if not words:
            return np.empty(0, np.int32)
        if "<|" not in (text := "\n".join(words)) and self.plain.fullmatch(text.replace("\n", "")):
            return self._plain_places(words)
        hard = np.array(["<|" in w or not self.plain.fullmatch(w) for w in words])
        out = np.empty(len(words), np.int32)
        out[hard] = self._library([w for w, is_hard in zip(words, hard, strict=True) if is_hard])
        if not hard.all():
            out[~hard] = self._plain_places([w for w, is_hard in zip(words, hard, strict=True) if not is_hard])
        return out

    def encode(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text; null is empty."""
        raw, offsets = column_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        out: list[np.ndarray] = []
        while len(out) < len(offsets) - 1:
            at = len(out)
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1)
            out += self._block(raw[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at])
        return out

    def _block(self, raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The ids of the texts raw[bounds[i] : bounds[i + 1]]."""
        if self.known.n > FULL * (1 << WORD_BITS) or self.first[self.n] > MAX_IDS:
            self._forget()
        if not len(raw):
            return [np.empty(0, np.uint32)] * (len(bounds) - 1)
        starts, sizes = split_words((raw == 32) | (raw == 10), bounds)
        short = sizes <= LONGEST
        keys = self.words.hashes(raw, starts, np.minimum(sizes, LONGEST))
        places = np.where(short, self.known.find(keys), -1)
        new = np.flatnonzero(places < 0)
        if len(new):
            text = raw.tobytes()
            word = lambda k: [text[a:b] for a, b in zip(starts[k].tolist(), (starts[k] + sizes[k]).tolist(), strict=True)]
            long, new = new[~short[new]], new[short[new]]
            fresh, first, code = np.unique(keys[new], return_index=True, return_inverse=True)
            own = word(new[first])
            plain = np.fromiter(map(bytes.isalpha, own), bool, len(own))
            found = np.empty(len(own), np.int32)
            found[plain] = self._letters_places([w.lower() for w, ok in zip(own, plain, strict=True) if ok])
            found[~plain] = self._learn([w.decode() for w, ok in zip(own, plain, strict=True) if not ok])
            unknown = self.known.find(fresh) < 0  # a word can have become known as a pre-token of another
            self.known.put(fresh[unknown], found[unknown])
            places[new] = found[code]
            if len(long):
                places[long] = self._library([w.decode() for w in word(long)])
        ids, lengths = self._take(places)
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, bounds)].tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
