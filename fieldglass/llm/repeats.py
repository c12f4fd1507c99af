"""Repeated passages by maximal repeats of an enhanced suffix array, over a corpus of any size.

`maximal_repeats` sorts suffixes, takes the common prefixes of neighbours and scans them with a stack. Each
interval of the common-prefix tree is a repeat; it is maximal if what stands before its occurrences differs (or
cannot be seen). A maximal repeat is returned with all its occurrences, not just neighbouring ones. Every match
of two documents that can be extended on neither side is such a repeat, so the bytes covered by strings that
also start in a document with a smaller id are the occurrences whose document isn't the repeat's smallest.

To spread this over a cluster, suffixes are grouped by anchors. Of every LENGTH-byte window the smallest hash
of its GRAM-byte strings is the anchor, so equal windows have equal anchors at equal places, and a window is
assigned to its anchor's group. An occurrence of an anchor needs only its context: the bytes of the windows
assigned to it. Occurrences with the same anchor and the same context are one class, kept by its smallest
document: all others are covered right away. Only where a group has several classes do their contexts travel,
one each, and go through the suffix array. A group of over HOT classes (a common phrase) is split by what follows and
precedes the anchor: its windows travel one by one, under their own hashes, so equal ones still meet. Classes are first formed inside a map task's own slice of the
corpus, so a passage in a third of all documents reaches a group once per slice.

Steps: (1) anchors, packed by bucket; (2) classes: covered places, and the contexts wanted; (3) those by
document; (4) texts meet the wanted places and give contexts, packed by bucket; (5) suffix arrays; (6) texts
(the same exchange again) meet all covered places. The class of a context is told by over 90 bits of hashes.

Texts are bytes; null texts are empty; texts shorter than LENGTH have no window; matches never cross documents;
a document is no source for itself. Rows with a null doc_id take no part. Rows that share a doc_id count as one
document and should be copies. Extra columns are dropped; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import cut, partitions, text_map, utf8_view

LENGTH, GRAM = 50, 20
_WINDOW = LENGTH - GRAM + 1
#: Classes of a group whose contexts meet in one task.
HOT = 4096
#: Contexts sorted at once: their suffixes' bytes take about 10 MB.
AT_ONCE = 4000
#: Bytes of text whose anchors make a bucket: there are as many buckets as the corpus asks for, so a task's memory
#: does not grow with it.
BUCKET_BYTES = 64 << 20

_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            out = np.ones(1, np.uint64)
            while len(out) < n:
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            tables.append(out)
        _powers[:] = tables
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best over every run of `width` consecutive values."""
    n = 1
    while 2 * n <= width:
        x = best(x[:-n], x[n:])
        n *= 2
    return best(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Anchors of texts stored back to back: hash, context class, row, pos (in the text), before, more.

    The windows assigned to an anchor start at pos - before and at the next `more` bytes.
    """
    n = len(data)
    empty = {k: np.zeros(0, np.int64) for k in ("row", "pos", "before", "more")} | {k: np.zeros(0, np.uint64) for k in ("hash", "context")}
    if n < LENGTH:
        return empty
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_RANDOM[data] * up[:n], out=sums[1:])
    h = _mix((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]) | np.uint64(1)
    least = _slide(h, _WINDOW, np.minimum)
    crossing = np.zeros(n + 1, np.int32)  # windows that don't lie inside one text
    np.add.at(crossing, np.maximum(bounds[1:] - LENGTH + 1, bounds[:-1]), 1)
    np.add.at(crossing, bounds[1:], -1)
    least[np.cumsum(crossing)[: len(least)] > 0] = 0
    edge = np.zeros(_WINDOW - 1, np.uint64)
    pos = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), _WINDOW, np.maximum)[: len(h)] == h)
    if not len(pos):
        return empty
    # Neighbouring windows with the same least hash form a run; an anchor's own windows are a part of one.
    starts = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends, value = np.append(starts[1:], len(least)) - 1, least[starts]
    run, own = np.searchsorted(starts, np.minimum(pos, len(least) - 1), side="right") - 1, h[pos]
    left = np.flatnonzero((value[run] != own) | (ends[run] < pos - _WINDOW + 1))
    while len(left):
        run[left] -= 1
        left = left[value[run[left]] != own[left]]
    low, high = np.maximum(starts[run], pos - _WINDOW + 1), np.minimum(ends[run], pos)
    context = _mix((sums[high + LENGTH] - sums[low]) * down[low] + (high - low).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + (pos - low).astype(np.uint64))
    row = np.searchsorted(bounds, pos, side="right") - 1
    return {"hash": own, "context": context, "row": row, "pos": pos - bounds[row], "before": pos - low, "more": high - low}


def stack_scan(common: list[int], left: list[int], docs: list[int], least: int) -> list[tuple[int, int, int, int]]:
    """(length, first, last, smallest document) of the left-diverse intervals with length >= least.

    common[i] is the common prefix of suffixes i - 1 and i; left[i] the byte before suffix i, -1 if unseen.
    """
    found, stack = [], []  # [length, first, byte before all of them (-1: diverse or unseen), smallest document]
    for i in range(1, len(left) + 1):
        now = common[i] if i < len(left) else 0
        first, before, doc = i - 1, left[i - 1], docs[i - 1]
        while stack and stack[-1][0] > now:
            length, start, own, smallest = stack.pop()
            before, doc, first = own if own == before else -1, min(doc, smallest), start
            if before < 0:
                found.append((length, first, i - 1, doc))
        if now < least:
            continue
        if stack and stack[-1][0] == now:
            top = stack[-1]
            top[2], top[3] = top[2] if top[2] == before else -1, min(top[3], doc)
        else:
            stack.append([now, first, before, doc])
    return found


def maximal_repeats(texts: list[bytes], docs: list[int], groups: list[int] | None = None, least: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Maximal repeats among texts of the same group: arrays (repeat, length, text, start, smallest document).

    One element per occurrence; equal `repeat` is one repeat. What stands before a text's first byte is unseen.
    All suffixes are laid out side by side, so the texts should be contexts of some hundred bytes.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    many = np.maximum(0, sizes - least + 1)
    total = int(many.sum())
    if total < 2:
        return none
    text = np.repeat(np.arange(len(texts)), many)
    shift = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
    base, data = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(texts), np.uint8)
    begin, length = base[text] + shift, sizes[text] - shift
    width = int(length.max())
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    table = np.lib.stride_tricks.sliding_window_view(padded, width)[begin]
    table[np.arange(width) >= length[:, None]] = 0
    group = np.zeros(total, np.int64) if groups is None else np.asarray(groups, np.int64)[text]
    number = [x.astype(">u4").view(np.uint8).reshape(-1, 4) for x in (group, length)]
    keyed = np.concatenate([number[0], table, number[1]], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 8}").ravel(), kind="stable")
    text, shift, begin, length, group, table = (x[order] for x in (text, shift, begin, length, group, table))
    same = table[1:] == table[:-1]
    common = np.where(same.all(1), width, same.argmin(1))
    common = np.concatenate([[0], np.where(group[1:] == group[:-1], np.minimum(common, np.minimum(length[1:], length[:-1])), 0)])
    left = np.where(shift > 0, padded[begin - 1].astype(np.int64), -1)
    doc = np.asarray(docs, np.int64)[text]
    deep = np.concatenate([[False], common[1:] >= least, [False]])
    begins, stops = np.flatnonzero(~deep[:-1] & deep[1:]), np.flatnonzero(deep[:-1] & ~deep[1:]) + 1
    out = []
    for a, z in zip(begins.tolist(), stops.tolist(), strict=True):
        own = doc[a:z]
        if z - a == 2:  # the commonest tree: one interval of two suffixes
            if own[0] != own[1] and (left[a] != left[a + 1] or left[a] < 0):
                out.append((int(common[a + 1]), a, a + 1, int(own.min())))
        elif own.min() != own.max():
            out += [(size, a + i, a + j, d) for size, i, j, d in stack_scan(common[a:z].tolist(), left[a:z].tolist(), own.tolist(), least)]
    if not out:
        return none
    size, first, last, smallest = (np.asarray(x, np.int64) for x in zip(*out, strict=True))
    count = last - first + 1
    repeat = np.repeat(np.arange(len(out)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[repeat]
    return repeat, size[repeat], text[at], shift[at], smallest[repeat]


# Packed columns of numbers: a row of a shuffle holds thousands of them.
def pack(*columns: np.ndarray) -> bytes:
    return b"".join([len(columns[0]).to_bytes(4, "little"), *[np.ascontiguousarray(c).tobytes() for c in columns]])


def unpack(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        n, at = int.from_bytes(blob[:4], "little"), 4
        for part, kind in zip(parts, kinds, strict=True):
            part.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(p) for p in parts]


def _by(key: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(value, indices in order) for each value of key."""
    order = np.argsort(key, kind="stable")
    edges = np.searchsorted(key[order], np.arange(n + 1))
    for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield k, order[edges[k] : edges[k + 1]]


def _part(doc: np.ndarray, n: int) -> np.ndarray:
    return (_mix(doc.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


ANCHOR = ("<u8", "<u8", "<i8", "<u4", "u1", "u1")  # hash, class, document, pos, before, more
SPAN = ("<i8", "<u4", "<u4")  # document, start, length
WANTED = ("<i8", "<u8", "<u4", "u1", "u1", "u1")  # document, hash, pos, before, more, whether its group is hot


def _planes(numbers: np.ndarray, width: int) -> np.ndarray:
    """The low bytes of numbers, all first bytes first: what repeats lies together for the shuffle's compression."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)


def _from_planes(blob: bytes, at: int, n: int, width: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T
    return wide.view("<u8")[:, 0]


#: Bytes of an anchor's hash (its bucket tells more of it), class, place among the documents, pos, before, more.
_WIDTHS = (5, 6, 2, 4, 1, 1)


def _anchor_blob(h: np.ndarray, c: np.ndarray, doc: np.ndarray, pos: np.ndarray, before: np.ndarray, more: np.ndarray) -> bytes:
    """Eleven bytes of hashes and a few of place for each anchor; documents once each."""
    names, where = np.unique(doc, return_inverse=True)
    return pack(*_planes(names, 8)) + pack(*[p for x, w in zip((h, c, where, pos, before, more), _WIDTHS, strict=True) for p in _planes(x, w)])


def _read_anchor_blobs(blobs: list[bytes], buckets: list[int]) -> list[np.ndarray]:
    parts: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in ANCHOR]
    for blob, bucket in zip(blobs, buckets, strict=True):
        many = int.from_bytes(blob[:4], "little")
        names = _from_planes(blob, 4, many, 8).view("<i8")
        at = 4 + 8 * many
        n = int.from_bytes(blob[at : at + 4], "little")
        at += 4
        columns = []
        for width in _WIDTHS:
            columns.append(_from_planes(blob, at, n, width))
            at += n * width
        columns[0] |= np.uint64(bucket << 40)
        columns[2] = names[columns[2].astype(np.int64)]
        for part, column, kind in zip(parts, columns, ANCHOR, strict=True):
            part.append(column.astype(kind))
    return [np.concatenate(p) for p in parts]


def _even_keys(docs: DataFrame, n: int) -> np.ndarray:
    """A key for each of n partitions that a shuffle into n partitions sends there, so each gets one bucket."""
    tried = docs.sparkSession.range(40 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    found = {r.p: r.id for r in tried.groupBy("p").agg(F.min("id").alias("id")).collect()}
    spare = iter(range(40 * n, 41 * n))
    return np.array([found[p] if p in found else next(spare) for p in range(n)], np.int64)


def _classes(h: np.ndarray, c: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """An order by hash, class, document, place; and in it: new group, new class, the class's smallest document."""
    order = np.lexsort((pos, doc, c, h))
    h, c, doc = h[order], c[order], doc[order]
    group = np.concatenate([[True], h[1:] != h[:-1]])
    fresh = group | np.concatenate([[True], c[1:] != c[:-1]])
    leader = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return order, group, fresh, leader


def _emit(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    kinds = {"bucket": pa.int64(), "part": pa.int64(), "kind": pa.int32(), "doc": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.binary())) for c, n in zip(columns, names, strict=True)], names=names)


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables of covered places, doc and spans (packed start and length): by class, and by suffix arrays."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    usual, most = partitions(docs.sparkSession), HOT
    n = max(usual, -(-size // BUCKET_BYTES))
    keys = _even_keys(docs, n)

    def dealt(df: DataFrame, by: str) -> DataFrame:
        return df.repartition(n, by) if n > usual else df.repartition(by)
    text = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")

    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        part = part.filter(part.column("doc").is_valid())
        a = anchors(*utf8_view(part.column("text")))
        doc = part.column("doc").to_numpy()[a["row"]]
        rows: list[tuple] = []
        if len(doc):
            order, _, _, leader = _classes(a["hash"], a["context"], doc, a["pos"])
            a, doc = {k: v[order] for k, v in a.items()}, doc[order]
            keep = doc == leader
            if not keep.all():
                gone = ~keep
                rows.append((int(keys[int(doc[gone][0]) % n]), 1, pack(doc[gone].astype("<i8"), (a["pos"] - a["before"])[gone].astype("<u4"), (a["more"] + LENGTH)[gone].astype("<u4"))))
            a, doc = {k: v[keep] for k, v in a.items()}, doc[keep]
            for bucket, at in _by(((a["hash"] >> np.uint64(40)) % np.uint64(n)).astype(np.int64), n):
                at = at[np.lexsort((a["pos"][at], doc[at]))]
                rows.append((int(keys[bucket]), 0, _anchor_blob(*[a[k][at] for k in ("hash", "context")], doc[at], *[a[k][at] for k in ("pos", "before", "more")])))
        return _emit(rows, ["bucket", "kind", "blob"])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, buckets, passed = [], [], []
        for b in batches:
            kind = b.column("kind").to_pylist()
            for k, bucket, blob in zip(kind, b.column("bucket").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if k:
                    passed.append(blob)
                else:
                    blobs.append(blob)
                    buckets.append(bucket)
        covered = [unpack(passed, *SPAN)]
        wanted = [np.zeros(0, k) for k in WANTED]
        h, c, doc, pos, before, more = _read_anchor_blobs(blobs, buckets)
        if len(h):
            order, group, _, leader = _classes(h, c, doc, pos)
            h, doc, pos, before, more = h[order], doc[order], pos[order].astype(np.int64), before[order], more[order]
            gone = doc != leader
            covered.append([doc[gone], (pos - before)[gone].astype("<u4"), (more[gone].astype(np.int64) + LENGTH).astype("<u4")])
            number, first = np.cumsum(group) - 1, np.flatnonzero(group)
            several = np.minimum.reduceat(leader, first) != np.maximum.reduceat(leader, first)
            ask = several[number] & ~gone
            hot = np.bincount(number[ask], minlength=len(first)) > most
            wanted = [doc[ask], h[ask], pos[ask].astype("<u4"), before[ask], more[ask], hot[number[ask]].astype("u1")]
        covered = [np.concatenate(x) for x in zip(*covered, strict=True)]
        yield from _by_part(covered, wanted, keys)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, asked = [], []
        for b in batches:
            done += [x for x in b.column("spans").to_pylist() if x]
            asked += [x for x in b.column("wanted").to_pylist() if x]
        yield from _by_doc(unpack(done, *SPAN), unpack(asked, *WANTED))

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[], [], [], []]
            windows: dict[bytes, list] = {}  # of hot groups: occurrences (document, start)
            for doc, page, blob in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                if not blob or not page:
                    continue
                raw = page.encode()
                _, h, pos, before, more, hot = unpack([blob], *WANTED)
                low, plain = pos.astype(np.int64) - before, hot == 0
                columns[0] += h[plain].tolist()
                columns[1] += [doc] * int(plain.sum())
                columns[2] += low[plain].tolist()
                columns[3] += [raw[a:z] for a, z in zip(low[plain].tolist(), (low + more + LENGTH)[plain].tolist(), strict=True)]
                for a, n_more in zip(low[~plain].tolist(), more[~plain].tolist(), strict=True):
                    for start in range(a, a + n_more + 1):
                        windows.setdefault(raw[start : start + LENGTH], []).append((doc, start))
            gone: list[tuple[int, int]] = []
            for window, places in windows.items():  # the smallest document of this batch speaks for the others
                smallest = min(places)[0]
                gone += [x for x in places if x[0] != smallest]
                for doc, start in (x for x in places if x[0] == smallest):
                    for column, item in zip(columns, (xxhash.xxh64_intdigest(window), doc, start, window), strict=True):
                        column.append(item)
            h, doc, low = (np.asarray(x, k) for x, k in zip(columns[:3], ("<u8", "<i8", "<u4"), strict=True))
            sizes, rows = np.fromiter(map(len, columns[3]), "u1", len(columns[3])), []
            for bucket, at in _by((h % np.uint64(n)).astype(np.int64), n):
                rows.append((int(keys[bucket]), 0, pack(h[at], doc[at], low[at], sizes[at]) + b"".join([columns[3][i] for i in at.tolist()])))
            if gone:
                where = np.asarray(gone, np.int64)
                rows.append((int(keys[where[0, 0] % n]), 1, pack(where[:, 0].astype("<i8"), where[:, 1].astype("<u4"), np.full(len(gone), LENGTH, "<u4"))))
            yield _emit(rows, ["bucket", "kind", "blob"])

    def suffix_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, texts, passed = [[], [], []], [], []
        for b in batches:
            for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), strict=True):
                if kind:
                    passed.append(blob)
                    continue
                h, doc, low, sizes = unpack([blob], "<u8", "<i8", "<u4", "u1")
                for c, x in zip(columns, (h, doc, low), strict=True):
                    c.append(x)
                at = len(blob) - int(sizes.sum(dtype=np.int64))
                ends = at + np.cumsum(sizes, dtype=np.int64)
                texts += [blob[z - s : z] for z, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
        covered = [unpack(passed, *SPAN)]
        h, doc, low = (np.concatenate([np.zeros(0, k), *c]) for c, k in zip(columns, ("<u8", "<i8", "<u4"), strict=True))
        low = low.astype(np.int64)
        order = np.lexsort((low, doc, h))
        edges = np.append(np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0])), len(order))
        a = 0
        while a < len(order):  # whole groups, about AT_ONCE contexts at a time
            z = max(int(edges[np.searchsorted(edges, a + AT_ONCE, side="right") - 1]), int(edges[np.searchsorted(edges, a, side="right")]))
            some = order[a:z]
            a = z
            group = np.cumsum(np.concatenate([[0], np.diff(h[some]) != 0]))
            mine = [texts[i] for i in some.tolist()]
            # A context's first window may have a longer repeat in another anchor's group, so it counts as a text's start.
            _, size, text, shift, smallest = maximal_repeats(mine, doc[some], group)
            own = doc[some][text]
            gone = own > smallest
            covered.append([own[gone], (low[some][text] + shift)[gone].astype("<u4"), size[gone].astype("<u4")])
        yield from _by_part([np.concatenate(x) for x in zip(*covered, strict=True)], [np.zeros(0, k) for k in WANTED], keys)

    parted, by_doc = "part long, spans binary, wanted binary", "doc long, spans binary, wanted binary"
    filed = text_map(text, find, "bucket long, kind int, blob binary")
    classes = dealt(filed, "bucket").mapInArrow(classify, parted)
    first = cut(dealt(classes, "part").mapInArrow(gather, by_doc))
    asked = text.join(first.select(F.col("doc").alias("_doc"), "wanted"), F.col("doc") == F.col("_doc"), "left").select("doc", "text", "wanted")
    contexts = asked.mapInArrow(context, "bucket long, kind int, blob binary")
    second = dealt(dealt(contexts, "bucket").mapInArrow(suffix_arrays, parted), "part").mapInArrow(gather, by_doc)
    return first.select("doc", "spans"), second.select("doc", "spans")


def _by_part(covered: list[np.ndarray], wanted: list[np.ndarray], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    n, rows = len(keys), {}
    for which, columns in enumerate((covered, wanted)):
        for part, at in _by(_part(columns[0], n), n):
            at = at[np.lexsort((columns[1][at], columns[0][at]))]
            rows.setdefault(part, [int(keys[part]), None, None])[1 + which] = pack(*[c[at] for c in columns])
    yield _emit([tuple(r) for r in rows.values()], ["part", "spans", "wanted"])


def union(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans, as starts and stops."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    start, stop = start[order].astype(np.int64), np.maximum.accumulate((start.astype(np.int64) + length)[order])
    fresh = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[fresh], stop[np.append(np.flatnonzero(fresh)[1:] - 1, len(stop) - 1)]


def _by_doc(covered: list[np.ndarray], wanted: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    names = np.unique(np.concatenate([covered[0], wanted[0]]))
    covered = [c[np.argsort(covered[0], kind="stable")] for c in covered]
    wanted = [c[np.argsort(wanted[0], kind="stable")] for c in wanted]
    edges = [np.append(np.searchsorted(c[0], names), len(c[0])) for c in (covered, wanted)]
    rows: list[tuple] = []
    for k, doc in enumerate(names.tolist()):
        a, z = edges[0][k], edges[0][k + 1]
        start, stop = union(covered[1][a:z], covered[2][a:z])
        b, y = edges[1][k], edges[1][k + 1]
        rows.append((doc, pack(start.astype("<u4"), (stop - start).astype("<u4")) if z > a else None, pack(*[c[b:y] for c in wanted]) if y > b else None))
        if len(rows) == 5000:
            yield _emit(rows, ["doc", "spans", "wanted"])
            rows = []
    yield _emit(rows, ["doc", "spans", "wanted"])


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with_text: the remaining bytes as `kept`."""
    first, second = spans(docs)
    text = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    joined = text.join(first.select(F.col("doc").alias("_doc"), "spans"), F.col("doc") == F.col("_doc"), "left").select("doc", "text", "spans")
    joined = joined.join(second.select(F.col("doc").alias("_doc"), F.col("spans").alias("more")), F.col("doc") == F.col("_doc"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for page, *blobs in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), b.column("more").to_pylist(), strict=True):
                raw = (page or "").encode()
                start, stop = union(*unpack([x for x in blobs if x], "<u4", "<u4"))
                edges = [0, *np.stack([start, stop], 1).ravel().tolist(), len(raw)]
                kept = b"".join([raw[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)])
                for column, value in zip(out, (len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            columns = [b.column("doc"), *[pa.array(c, pa.int64()) for c in out[:3]], pa.array(out[3], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(out[4], pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select("doc", "text", "spans", "more").mapInArrow(run, SCHEMA + ", kept binary" * with_text)
