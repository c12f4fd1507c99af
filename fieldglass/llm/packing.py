"""Sum-of-squares online packing of token sequences into fixed windows.

A document's ids fill whole windows first; what is left over (shorter than a window) is one item. An item goes
to the fill level h whose change from h to h + size lowers most the sum, over all levels below the capacity, of
the squared number of windows partly filled to that level; the numbers are kept in one array indexed by level.
Each task packs its own rows in one pass, so no row is shuffled. The windows still open at a task's end (or, for
bounded memory, once there are more than OPEN_LIMIT) are closed by cutting: the emptiest one's pieces move on
into the fullest ones, and the last remainder is cut at powers of two, where nothing is padded.

Null and empty texts are one end id. Repeated rows are packed as often as they come. Extra columns are dropped.
An empty table gives no rows. A null doc_id is kept as null.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fieldglass.llm.common import text_slices, utf8_view
from fieldglass.llm.tokenize import encoder

WINDOW, END_ID, OPEN_LIMIT = 2048, 1, 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: A piece: doc_id, first id's place in the document, ids, the document's number of ids.
Piece = tuple[object, int, np.ndarray, int]


class SumOfSquares:
    """Packs items one by one; `closed` collects finished windows as lists of pieces."""

    def __init__(self, window: int = WINDOW, open_limit: int = OPEN_LIMIT):
        self.window, self.open_limit = window, open_limit
        self.counts = np.zeros(window + 1, np.int64)  # by level; a new window has level 0, a full one is not kept
        self.open: defaultdict[int, list[list[Piece]]] = defaultdict(list)
        self.closed: list[list[Piece]] = []
        self.n_open = 0

    def level(self, size: int) -> int:
        """The best level for an item; the fullest of equals."""
        n = self.counts
        here, there = n[: self.window - size + 1], n[size : self.window + 1]
        change = 2 * (there - here) + 2
        change[0] = 2 * n[size] + 1 if size < self.window else 0
        change[-1] = min(change[-1], 1 - 2 * n[self.window - size]) if size < self.window else change[-1]
        possible = here > 0
        possible[0] = True
        change = np.where(possible, change, np.iinfo(np.int64).max)
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def _put(self, pieces: list[Piece], level: int) -> None:
        if level == self.window:
            self.closed.append(pieces)
        else:
            self.open[level].append(pieces)
            self.counts[level] += 1
            self.n_open += 1

    def _take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def add(self, doc: object, ids: np.ndarray) -> None:
        whole = len(ids) // self.window * self.window
        for at in range(0, whole, self.window):
            self.closed.append([(doc, at, ids[at : at + self.window], len(ids))])
        if size := len(ids) - whole:
            level = self.level(size)
            self._put([*(self._take(level) if level else []), (doc, whole, ids[whole:].copy(), len(ids))], level + size)
            if self.n_open > self.open_limit:
                self.close_by_cutting()

    def close_by_cutting(self, last: bool = False) -> None:
        """Leaves one open window at most; none if last."""
        windows = [self._take(level) for level in range(self.window - 1, 0, -1) for _ in range(self.counts[level])]
        spare: list[Piece] = []
        current: list[Piece] = []
        room = self.window
        while windows or spare or current:
            if not current:
                if windows:
                    current = windows.pop(0)
                    room = self.window - sum(len(p[2]) for p in current)
                else:
                    current, room = [], self.window
            while room and (spare or windows):
                if not spare:
                    spare = windows.pop()
                doc, start, ids, total = spare.pop()
                current.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            if room:
                break
            self.closed.append(current)
            current = []
        if current and not last:
            self._put(current, self.window - room)
        elif current:
            self._powers_of_two(current)

    def _powers_of_two(self, pieces: list[Piece]) -> None:
        left = sum(len(p[2]) for p in pieces)
        pieces = pieces[::-1]
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            part: list[Piece] = []
            while room:
                doc, start, ids, total = pieces.pop()
                part.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self.closed.append(part)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, drop_blank: bool = False, added: bool = False) -> DataFrame:
    """Pack every document's ids (text encoded by the file, then end_id); one row per piece, columns SCHEMA.

    sequence_id is unique and holds the task's number above bit 40; offset is gapless from 0 in a sequence.
    added, drop_blank: see PieceEncoder; the latter True only for a vocabulary that ignores white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(tokenizer_path, drop_blank, added), SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 40
        schema = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            out: list[list] = [[] for _ in schema]
            for pieces in packer.closed:
                offset = 0
                for doc, start, ids, total in pieces:
                    for column, value in zip(out, (doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), total, sequence, offset), strict=True):
                        column.append(value)
                    offset += len(ids)
                sequence += 1
            packer.closed = []
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], schema=schema)

        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, edges = coder.encode(*utf8_view(part.column("text")), end_id)
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    packer.add(doc, ids[edges[k] : edges[k + 1]])
                yield from rows()
        packer.close_by_cutting(last=True)
        yield from rows()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
