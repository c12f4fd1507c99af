"""Token ids of whole texts, one run of the library per distinct piece of text instead of per text.

A text is cut where neither vocabulary used here can have a token across: before a space or line feed that
follows a certain non-blank, and between a letter or digit and ASCII punctuation (the apostrophe aside, which
begins contractions). Both split there before any merge, so a text's ids are its pieces' ids in turn.
Pieces repeat; each distinct one goes through the library once for each Python worker, and is found again by
a 64-bit hash in a table of numpy arrays, whose size is fixed; its length and a second, unrelated hash must agree
too. Bytes are read in portions that end at a cut, so a text of any length takes bounded memory besides its ids. Texts
that hold the name of an added token, which a cut would part, go through the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from fieldglass.llm.common import KEPT

#: Slots of a worker's table (a power of two), the pieces it holds before it starts anew, and the bytes read at once
#: (more only for a single longer piece); a portion has fewer pieces than the table holds.
SLOTS, REMEMBERED, PORTION = 1 << 22, 1_500_000, 1 << 20

_WIDE = np.uint64(0x9E3779B97F4A7C15)  # odd, so powers have inverses modulo 2**64
_RANDOM = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OTHER = np.random.default_rng(20240608).integers(1, 1 << 63, 256, dtype=np.uint64)  # summed whatever the order

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 97) & ((_BYTES | 32) <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_PUNCT = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER & ~_DIGIT & (_BYTES != 39)
_BLANK = (_BYTES == 32) | (_BYTES == 10)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class PieceEncoder:
    """Encodes UTF-8 bytes with a file of the tokenizers library, add_special_tokens=False.

    drop_blank: the vocabulary ignores white space, so a piece may lose the blank before it. added: the name of an
    added token (<|endoftext|>) in a text is that token, as the library has it by default; else it is ordinary text.
    """

    def __init__(self, path: str, drop_blank: bool = False, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.drop_blank = Tokenizer.from_file(path), drop_blank
        self.tokenizer.encode_special_tokens = not added
        self.names = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.up = self.down = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.values = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.ids, self.starts, self.known = np.empty(1 << 20, np.uint32), np.zeros(REMEMBERED + 2, np.int64), 0
        self.proof = np.zeros(REMEMBERED + 2, np.uint64)  # of each piece: its second hash and its length

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash's piece, -1 if it has none yet."""
        found = np.full(len(hashes), -1, np.int64)
        slot, left = (hashes >> np.uint64(42)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            key = self.keys[slot]
            hit = key == hashes[left]
            found[left[hit]] = self.values[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) % SLOTS
        return found

    def _place(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slot = (hashes >> np.uint64(42)).astype(np.int64)
        while len(hashes):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]
            own = self.keys[slot] == hashes
            self.values[slot[own]] = numbers[own]
            hashes, numbers, slot = hashes[~own], numbers[~own], (slot[~own] + 1) % SLOTS

    def _learn(self, pieces: list[str], proof: np.ndarray) -> np.ndarray:
        """Encodes pieces and remembers their ids; their numbers."""
        coded = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        many = np.fromiter(map(len, coded), np.int64, len(coded))
        at = self.starts[self.known]
        ends = at + np.cumsum(many)
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[at : ends[-1]] = np.fromiter((i for x in coded for i in x), np.uint32, int(many.sum()))
        numbers = np.arange(self.known, self.known + len(coded))
        self.starts[numbers + 1], self.proof[numbers] = ends, proof
        self.known += len(coded)
        return numbers

    def _cuts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Places of data that begin a piece, then its end; data begins with one, bounds are where texts begin."""
        letter, punct, blank = _LETTER[data], _PUNCT[data], _BLANK[data]
        wide = np.zeros(len(data), bool)  # last byte of U+00C0 to U+07FF, never white space
        wide[1:] = (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
        word = letter | _DIGIT[data]
        word[1:] |= (data[:-1] >= 0xC3) & (data[:-1] <= 0xC8) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        solid = wide | ((data > 32) & (data < 127))
        here = np.zeros(len(data), bool)
        here[1:] = (blank[1:] & solid[:-1]) | (punct[1:] & word[:-1]) | (letter[1:] & punct[:-1])
        here[0] = True
        here[bounds] = True
        return np.append(np.flatnonzero(here), len(data))

    def encode(self, data: np.ndarray, bounds: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts back to back and each text's bounds there; `end` closes every text."""
        if self.names and len(whole := self._named(data, bounds)):
            return self._spliced(data, bounds, end, whole)
        return self._by_pieces(data, bounds, end)

    def _named(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Numbers of the texts that hold the name of an added token."""
        raw, found = data.tobytes(), []
        for name in self.names:
            at = raw.find(name)
            while at >= 0:
                k = int(np.searchsorted(bounds, at, side="right")) - 1
                if at + len(name) <= bounds[k + 1]:
                    found.append(k)
                    at = raw.find(name, int(bounds[k + 1]))
                else:  # it only seems to go on into the next text
                    at = raw.find(name, at + 1)
        return np.unique(np.array(found, np.int64))

    def _spliced(self, data: np.ndarray, bounds: np.ndarray, end: int | None, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(bounds)
        kept = np.repeat(~np.isin(np.arange(len(sizes)), whole), sizes)
        sizes[whole] = 0
        ids, edges = self._by_pieces(data[kept], np.concatenate([[0], np.cumsum(sizes)]), end)
        parts, many, at = [], np.diff(edges), 0
        for k in whole.tolist():
            own = self.tokenizer.encode(data[bounds[k] : bounds[k + 1]].tobytes().decode(), add_special_tokens=False).ids
            parts += [ids[at : edges[k]], np.array(own, np.uint32)]
            at, many[k] = edges[k], many[k] + len(own)
        return np.concatenate([*parts, ids[at:]]), np.concatenate([[0], np.cumsum(many)])

    def _by_pieces(self, data: np.ndarray, bounds: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(bounds) - 1
        parts, edges, done, at, size = [np.zeros(0, np.uint32)], np.zeros(n + 1, np.int64), 0, 0, PORTION
        while at < len(data):
            portion = data[at : at + size]
            first, last = np.searchsorted(bounds, [at, at + len(portion)])  # texts that begin here
            cuts = self._cuts(portion, bounds[first:last] - at)
            if at + len(portion) < len(data):
                if len(cuts) == 2:  # one piece goes on past the portion
                    size *= 2
                    continue
                cuts = cuts[:-1]
                last = np.searchsorted(bounds, at + cuts[-1])
            ids, total = self._pieces(portion[: cuts[-1]], cuts)
            edges[first:last] = done + total[np.searchsorted(cuts, bounds[first:last] - at)]
            parts.append(ids)
            at, done, size = at + int(cuts[-1]), done + len(ids), PORTION
        edges[np.searchsorted(bounds, len(data)) :] = done
        ids = np.concatenate(parts)
        if end is not None:
            closed = np.full(len(ids) + n, end, np.uint32)
            keep = np.ones(len(closed), bool)
            edges = edges + np.arange(n + 1)
            keep[edges[1:] - 1] = False
            closed[keep] = ids
            ids = closed
        return ids, edges

    def _pieces(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces that begin at starts (the last one is the end), and how many come before each piece."""
        if len(data) >= len(self.up):
            self.up = _powers(int(_WIDE), len(data) + 1)
            self.down = _powers(pow(int(_WIDE), -1, 1 << 64), len(data) + 1)
        sums, other = np.zeros(len(data) + 1, np.uint64), np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RANDOM[data] * self.up[: len(data)], out=sums[1:])
        np.cumsum(_OTHER[data], out=other[1:])
        first, after = starts[:-1], starts[1:]
        if self.drop_blank:
            first = first + _BLANK[data[first]]
        hashes = (sums[after] - sums[first]) * self.down[first]
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        hashes[hashes == 0] = 1
        proof = (other[after] - other[first]) * np.uint64(0x9E3779B97F4A7C15) + (after - first).astype(np.uint64)
        raw = data.tobytes()
        found = self._find(hashes)
        if (miss := np.flatnonzero(found < 0)).size:
            new, where = np.unique(hashes[miss], return_index=True)
            if self.known + len(new) > REMEMBERED:
                self._forget()
                miss, (new, where) = np.arange(len(hashes)), np.unique(hashes, return_index=True)
            at = miss[where]
            for k in range(0, len(new), 50_000):
                some = at[k : k + 50_000]
                self._place(new[k : k + 50_000], self._learn(self._texts(raw, first[some], after[some]), proof[some]))
            found[miss] = self._find(hashes[miss])
        if (self.proof[found] != proof).any():  # an equal hash, but not the same piece
            return self._library(raw, first, after)
        begin, many = self.starts[found], self.starts[found + 1] - self.starts[found]
        total = np.concatenate([[0], np.cumsum(many)])
        return self.ids[np.repeat(begin - total[:-1], many) + np.arange(total[-1])], total

    @staticmethod
    def _texts(raw: bytes, first: np.ndarray, after: np.ndarray) -> list[str]:
        return [raw[a:b].decode() for a, b in zip(first.tolist(), after.tolist(), strict=True)]

    def _library(self, raw: bytes, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """_pieces without the table."""
        coded = [x.ids for x in self.tokenizer.encode_batch_fast(self._texts(raw, first, after), add_special_tokens=False)]
        total = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int64)
        return np.fromiter((i for x in coded for i in x), np.uint32, int(total[-1])), total


def encoder(path: str, drop_blank: bool = False, added: bool = False) -> PieceEncoder:
    """This Python worker's encoder for a file; kept from task to task until one of another operator comes."""
    key = ("encoder", path, drop_blank, added)
    if key not in KEPT:
        KEPT[key] = PieceEncoder(*key[1:])
    return KEPT[key]
