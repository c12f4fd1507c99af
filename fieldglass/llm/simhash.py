"""SimHash near-duplicates, candidates pruned by the pigeonring principle.

A fingerprint has `blocks` x 64 bits: a bit is 1 if it is set in over half the hashes of a text's word shingles
(XXH64, seed 42, of the UTF-8 bytes; further blocks are fixed mixes of that hash). Equal fingerprints are one
class from the start, so copies cost one row each and never meet as pairs.

The bits lie on a ring of m consecutive segments. If two fingerprints differ in at most `tau` bits, then on some
segment i begins a chain whose first l segments differ in at most l * tau / m bits together, for every l up to m
(pigeonring; with l = 1 alone it is the pigeonhole principle). With tau < m the first segment must be equal, so
every class is filed under each segment's value, and a candidate pair of a bucket must pass the chain from that
segment before all bits are compared. That is exact. For tau >= m (`bands`), equal bit samples of the ring
propose the candidates instead, as many as find a pair at distance tau with probability `recall`; the chain
condition then may begin anywhere, and the full check decides.

A bucket of over HOT rows is cut into blocks of rows; every pair of blocks is its own group, so no task holds a
whole hot bucket. Inside a group only links of a spanning forest leave the task, found by a breadth-first
search that compares each newly reached fingerprint with those not reached yet.

With `similar` a link must also hold between the shingle sets themselves: each class carries its set as 32-bit hashes
if it has at most WHOLE shingles, else a sketch (the least hash of each of BINS parts of the hash range, one byte of
it), whose equal share of filled parts estimates the Jaccard similarity within about 0.01. Two whole sets are compared
exactly. The links of fingerprints then only part the classes into families, which
every link lies within. A family meets with its sketches in one task, and the search compares both fingerprints and
sketches before a row counts as reached, so a mate that fails takes no row out of the search. A family of over HOT
rows is filed under its bit samples once more, sketches included, and searched bucket by bucket.

Defined results: a text that is null or has no words has fingerprint zero and links like any other; fewer words
than a shingle are one shingle; repeats count; rows with a null doc_id get a fingerprint and no component;
repeated doc_ids are one document; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import components, cut, deal, local_roots, text_map

#: Rows of one bucket that a task takes whole.
HOT = 4096
#: Shingles of a set that is kept whole; parts of a sketch beyond that, and how much lower than asked its estimate may
#: be. Whole sets are counted out only if their sketches put them within NEARLY of the threshold.
WHOLE, BINS, SLACK, NEARLY = 512, 2048, 0.01, 0.05
#: Longest run of a bucket handled by shifted comparison rather than by search.
SHORT = 24


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle; words are split at ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _mixed(h: np.ndarray, block: int) -> np.ndarray:
    """Block 0 is the hash; the others are finalised multiples of it."""
    if not block:
        return h
    h = (h + np.uint64(block)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fold(h: np.ndarray, blocks: int = 1) -> np.ndarray:
    """The fingerprint of hashes: `blocks` unsigned 64-bit words; bit b of a word is worth 2**b."""
    out = np.zeros(blocks, np.uint64)
    for block in range(blocks):
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):  # bounded memory for very long texts
            bits = np.unpackbits(_mixed(h[at : at + (1 << 16)], block).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count += bits.sum(0, dtype=np.int64)
        out[block] = np.packbits(2 * count > len(h), bitorder="little").view("<u8")[0] if len(h) else 0
    return out


def sketch(h: np.ndarray) -> bytes:
    """A 1 and the sorted distinct 32-bit hashes, if they are few; else a 0, BINS bits that tell which parts have a
    hash, and a byte of 1 to 255 of the least hash of each such part."""
    mixed = np.unique((_mixed(h, 101) >> np.uint64(32)).astype("<u4"))
    if len(mixed) <= WHOLE:
        return b"\1" + mixed.tobytes()
    filled, least = _parts(mixed)
    return b"\0" + np.packbits(filled).tobytes() + least.tobytes()


def _parts(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which parts sorted hashes fill, and the byte of each one's least."""
    part = mixed >> np.uint32(21)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(part)), bool), part[1:] != part[:-1]]))
    filled = np.zeros(BINS, bool)
    filled[part[first]] = True
    return filled, (mixed[first] % np.uint32(255) + np.uint32(1)).astype(np.uint8)


class Sketches:
    """Sketches side by side: a row of BINS bytes for each, 0 for empty parts, and the sets that are whole."""

    def __init__(self, sketches: list[bytes]):
        self.rows = np.zeros((len(sketches), BINS), np.uint8)
        self.whole: list[np.ndarray | None] = []
        for k, s in enumerate(sketches):
            hashes = np.frombuffer(s, "<u4", offset=1) if s[:1] == b"\1" else None
            self.whole.append(hashes)
            filled, least = _parts(hashes) if hashes is not None else (np.unpackbits(np.frombuffer(s, np.uint8, BINS // 8, 1)).astype(bool), np.frombuffer(s, np.uint8, offset=1 + BINS // 8))
            self.rows[k, filled] = least

    def alike(self, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
        """Whether the rows a[i] and b[i] have this Jaccard similarity."""
        out = np.zeros(len(a), bool)
        for at in range(0, len(a), 4096):
            some = slice(at, at + 4096)
            near = similarity(self.rows[a[some]], self.rows[b[some]])
            out[some] = near >= least - SLACK
            for k in np.flatnonzero(np.abs(near - least) <= NEARLY).tolist():
                x, y = self.whole[a[at + k]], self.whole[b[at + k]]
                if x is not None and y is not None:
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    out[at + k] = both >= least * (len(x) + len(y) - both)
        return out


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of opened sketches."""
    either = np.count_nonzero(a | b, axis=1)
    same = np.count_nonzero((a == b) & (a != 0), axis=1)
    return np.where(either > 0, (same / np.maximum(either, 1) - 1 / 255) * 255 / 254, 1.0)


def fingerprints(docs: DataFrame, k: int = 3, blocks: int = 1, sketched: bool = False) -> DataFrame:
    """doc_id, `fp` (binary, little-endian words) and, if asked for, `sketch` of every row."""

    def kernel(part: pa.RecordBatch) -> pa.RecordBatch:
        prints, sketches = [], []
        for t in part.column("text").to_pylist():
            h = shingle_hashes((t or "").encode(), k)
            prints.append(fold(h, blocks).astype("<u8").tobytes())
            sketches.append(sketch(h) if sketched else None)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "fp", "sketch"])

    return text_map(docs.select(F.col("doc_id").cast("long"), "text"), kernel, "doc_id long, fp binary, sketch binary")


def _samples(bits: int, width: int, many: int) -> list[np.ndarray]:
    """Fixed pseudo-random bit places of each band."""
    rng = np.random.default_rng(77)
    return [np.sort(rng.choice(bits, width, replace=False)) for _ in range(many)]


def _segments(bits: int, m: int) -> list[np.ndarray]:
    return np.array_split(np.arange(bits), m)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Chain:
    """The pigeonring condition for pairs of fingerprints, then the full check."""

    def __init__(self, bits: int, tau: int, m: int, anywhere: bool):
        self.tau, self.m, self.anywhere = tau, m, anywhere
        masks = np.zeros((m, bits // 8), np.uint8)
        for i, places in enumerate(_segments(bits, m)):
            for p in places:
                masks[i, p // 8] |= 1 << (p % 8)
        self.masks = masks.view("<u8")

    def linked(self, a: np.ndarray, b: np.ndarray, start: np.ndarray | int) -> np.ndarray:
        """a, b: (..., words); start: the segment each pair's chain begins on, if it is known."""
        x = a ^ b
        if self.anywhere:
            # A pair within tau has a segment whose chain passes; a chain of all m segments is the full check.
            parts = [np.bitwise_count(x & mask).sum(-1, dtype=np.int64) for mask in self.masks]
            passed = np.zeros(x.shape[:-1], bool)
            for i in range(self.m):
                total, ok = np.zeros(x.shape[:-1], np.int64), np.ones(x.shape[:-1], bool)
                for length in range(1, self.m + 1):
                    total = total + parts[(i + length - 1) % self.m]
                    ok &= total * self.m <= length * self.tau
                passed |= ok
            return passed
        total, ok = np.zeros(x.shape[:-1], np.int64), np.ones(x.shape[:-1], bool)
        for length in range(1, self.m + 1):
            mask = self.masks[(start + length - 1) % self.m]
            total = total + np.bitwise_count(x & mask).sum(-1, dtype=np.int64)
            ok &= total * self.m <= length * self.tau
        return ok  # the last length holds all bits


def bucket_links(keys: np.ndarray, starts: np.ndarray, fps: np.ndarray, chain: Chain, alike=None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, root row) among rows of equal key; the arrays are sorted by key.

    alike: a further condition on links, from two arrays of rows to an array of truth values.
    """
    n = len(keys)
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if n else np.zeros(1, np.int64)
    size = np.diff(edge)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    run = np.repeat(size, size)
    for shift in range(1, int(min(SHORT, size.max(initial=0)))):
        a = np.flatnonzero((run[:-shift] <= SHORT) & (keys[shift:] == keys[:-shift])) if n > shift else np.zeros(0, np.int64)
        if len(a):
            a = a[chain.linked(fps[a], fps[a + shift], starts[a])]
            if alike is not None:
                a = a[alike(a, a + shift)]
            left.append(a)
            right.append(a + shift)
    for k in np.flatnonzero(size > SHORT):
        rest, start = np.arange(edge[k], edge[k + 1]), int(starts[edge[k]])
        front = np.zeros(0, np.int64)
        while len(rest):
            if not len(front):
                front, rest = rest[:1], rest[1:]
                continue
            near = np.full(len(rest), -1, np.int64)
            step = max(1, 200_000 // len(rest))
            for at in range(0, len(front), step):
                open_ = np.flatnonzero(near < 0)
                if not len(open_):
                    break
                some = front[at : at + step]
                ok = chain.linked(fps[some][:, None], fps[rest[open_]][None], start)
                if alike is not None:
                    i, j = np.nonzero(ok)
                    ok[i, j] = alike(some[i], rest[open_[j]])
                hit = ok.any(0)
                near[open_[hit]] = some[ok[:, hit].argmax(0)]
            got = near >= 0
            left.append(near[got])
            right.append(rest[got])
            front, rest = rest[got], rest[~got]
    root = local_roots(n, np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(root != np.arange(n))
    return moved, root[moved]


def _filed(classes: DataFrame, places: list[np.ndarray], bits: int, more: tuple[str, ...] = ()) -> DataFrame:
    """key, doc, fp and `more` columns: each class under the value of each of the places."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                raw = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(batch.num_rows, bits // 8)
                flat = np.unpackbits(raw, axis=1, bitorder="little")
                names = ["doc", "fp", *more]
                for i, p in enumerate(places):
                    value = flat[:, p].astype(np.int64) @ (np.int64(1) << np.arange(len(p), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array((np.int64(i) << 48) | value), *map(batch.column, names)], names=["key", *names])

    types = {"doc": "long", "fp": "binary", "sketch": "binary", "family": "long"}
    return classes.mapInArrow(file, "key long, " + ", ".join(f"{c} {types[c]}" for c in ("doc", "fp", *more)))


def _compared(dealt: DataFrame, words: int, chain: Chain, least: float | None = None) -> DataFrame:
    """Spanning links (a, b: doc ids) of each (key, block); least: of similarity, from the column `sketch`."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key, block, doc = (rows.column(c).to_numpy() for c in ("key", "block", "doc"))
            fp = np.frombuffer(b"".join(rows.column("fp").to_pylist()), "<u8").reshape(-1, words)
            order = np.lexsort((doc, block, key))
            key, block, doc, fp = key[order], block[order], doc[order], fp[order]
            alike = None
            if least is not None:
                column = rows.column("sketch").to_pylist()
                sketches = Sketches([column[i] for i in order.tolist()])

                def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                    return sketches.alike(a, b, least)

            group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
            a, b = bucket_links(group, key >> 48, fp, chain, alike)
            for at in range(0, len(a), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(doc[a[at : at + 50_000]]), pa.array(doc[b[at : at + 50_000]])], names=["a", "b"])

        many = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if least is not None and many >= 4 * HOT:  # rows come in order of group: all but the last are whole
                rows = pa.Table.from_batches(held)
                key, block = rows.column("key").to_numpy(), rows.column("block").to_numpy()
                last = np.flatnonzero((key != key[-1]) | (block != block[-1]))
                if len(last):
                    whole = int(last[-1]) + 1
                    yield from flush(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
                    many = len(rows) - whole
            held.append(batch)
            many += batch.num_rows
        if many:
            yield from flush(pa.Table.from_batches(held))

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def links(classes: DataFrame, bits: int, tau: int, m: int, bands: tuple[int, int] | None = None) -> DataFrame:
    """Spanning links (a, b: doc ids) of the classes (`doc`, `fp`) within tau bits; bands: (width, many)."""
    places = _samples(bits, *bands) if bands else _segments(bits, m)
    keyed = _filed(classes, places, bits)
    dealt = deal(keyed, ["key"], F.col("doc"), HOT).select("key", "block", "doc", "fp")
    return _compared(dealt, bits // 64, Chain(bits, tau, m, bool(bands)))


def similar_links(found: DataFrame, classes: DataFrame, bits: int, tau: int, m: int, bands: tuple[int, int], least: float) -> DataFrame:
    """Spanning links within tau bits and of similarity `least` inside the families that the links `found` form."""
    families = components(found)
    members = cut(classes.join(families, classes["doc"] == families["node"]).select(F.col("component").alias("family"), "doc", "fp", "sketch"))
    over = cut(members.groupBy("family").count().where(F.col("count") > HOT).select("family"))
    columns = ["key", "block", "doc", "fp", "sketch"]
    dealt = members.join(over, "family", "left_anti").select(F.col("family").alias("key"), F.lit(0).cast("long").alias("block"), "doc", "fp", "sketch").repartition("key")
    dealt = dealt.sortWithinPartitions("key", "block")
    proven = _compared(dealt, bits // 64, Chain(bits, tau, m, True), least)
    if over.isEmpty():
        return proven
    large = _filed(members.join(over, "family", "left_semi").select("doc", "fp", "sketch", "family"), _samples(bits, *bands), bits, ("sketch", "family"))
    keyed = large.withColumn("key", F.xxhash64("family", "key")).drop("family")
    dealt = deal(keyed, ["key"], F.col("doc"), HOT).select(*columns).sortWithinPartitions("key", "block")
    return proven.unionByName(_compared(dealt, bits // 64, Chain(bits, tau, m, True), least)).distinct()


def groups(docs: DataFrame, k: int = 3, blocks: int = 1, tau: int = 2, m: int = 3, recall: float | None = None, reach: int | None = None, similar: float | None = None) -> DataFrame:
    """doc_id, fp (binary), component_id (smallest doc_id reachable by links, itself included).

    recall: None asks for the exact segments (tau < m); a probability asks for bands that find a pair at `reach`
    bits (default tau) so often. similar: the least Jaccard similarity of the shingle sets of a link.
    """
    prints = cut(fingerprints(docs, k, blocks, similar is not None))
    classes = prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc"), F.min_by("sketch", "doc_id").alias("sketch"))
    classes = cut(classes)
    prints = prints.select("doc_id", "fp")
    bits = 64 * blocks
    bands = None
    if recall is not None:
        n = max(2, classes.count())
        width = max(14, math.ceil(math.log2(n)) - 2)  # a few chance mates in a bucket at any size
        alike = (1 - (reach or tau) / bits) ** width
        bands = (width, math.ceil(math.log(1 - recall) / math.log(1 - alike)))
    elif tau >= m:
        raise ValueError("tau must be below m unless a recall is given")
    found = links(classes.select("doc", "fp"), bits, tau, m, bands)
    if similar is not None:
        found = similar_links(found, classes, bits, tau, m, bands, similar)
    joined = components(found)
    named = classes.join(joined, classes.doc == joined.node, "left").select("fp", F.coalesce("component", "doc").alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: The stage's own setting: five-word shingles of similarity 0.8. Such texts differ in 0.151 of the bits on average;
#: bands are laid out for 0.164, the full check admits 0.22, and the sets decide.
NEAR = {"k": 5, "blocks": 4, "tau": 56, "m": 4, "recall": 0.93, "reach": 42, "similar": 0.8}


def deduplicate(docs: DataFrame, **setting) -> DataFrame:
    """docs without the documents that have a smaller doc_id in their group; columns unchanged."""
    found = groups(docs, **(NEAR | setting))
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_dropped"], "left_anti")
