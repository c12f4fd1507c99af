"""Near-duplicate vectors by a forest of random-projection trees.

Vectors are compared only inside a class: same label, same number of components. A tree splits recursively at
the median of a random projection; both sides also get the vectors that lie within a margin of it (spill), so
close pairs are seldom parted, and TREES trees with other directions catch what one tree parts. Medians are
fitted on a bounded sample (vectors by a hash of vec_id, SAMPLE of them and SAMPLE_BYTES at most); every vector is
indexed. A node with fewer than FIT sample vectors takes the median that the nearest ancestor with as many has in the
node's own direction. The depth follows the class's size, so leaves stay near LEAF vectors at any scale; a class of
LEAF vectors or fewer is one leaf of one tree. All pairs of a leaf are compared in double precision, in blocks, a leaf
at a time; leaves over HOT rows are dealt as pairs of blocks, so no task holds a hot leaf.

Equal vectors are one class from the start, with a count. A pair of distinct vectors that meets in several
leaves is counted in the first one only (each row carries the list of its leaves), so a task can return its
vectors' numbers of links, and a spanning forest of the links, instead of pairs.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, or whose label or
vec_id is null, link with nothing; their component is themselves. Rows with a repeated vec_id count as copies.
Extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.common import components, cut, deal, local_roots

COSINE, TREES, LEAF, SAMPLE, SAMPLE_BYTES, FIT, HOT, MARGIN = 0.98, 8, 32, 20_000, 32 << 20, 64, 4096, 1.25
SEED, DEEPEST = 5, 40


def direction(tree: int, node: int, dims: int) -> np.ndarray:
    v = np.random.default_rng([SEED, tree, node, dims]).normal(size=dims)
    return v / np.linalg.norm(v)


def margin(cosine: float, dims: int) -> float:
    """MARGIN standard deviations of half the projected gap between two unit vectors at this cosine."""
    return MARGIN * math.sqrt(max(0.0, 2 - 2 * cosine) / dims) / 2


class Tree:
    """Thresholds by node (1 is the root, 2n and 2n + 1 lie below n), from a sample that all trees share."""

    def __init__(self, number: int, sample: np.ndarray, depth: int, gap: float):
        self.number, self.sample, self.gap = number, sample, gap
        self.cuts: dict[int, float] = {}
        self.rows: dict[int, np.ndarray] = {}  # of fitted nodes with an unfitted one below
        stack = [(1, np.arange(len(sample)))]
        while stack:
            node, rows = stack.pop()
            if node >= 1 << depth or len(rows) < FIT:
                continue
            projected = sample[rows] @ direction(number, node, sample.shape[1])
            self.cuts[node] = middle = float(np.median(projected))
            below = [(2 * node, rows[projected <= middle]), (2 * node + 1, rows[projected > middle])]
            if min(len(r) for _, r in below) < FIT:
                self.rows[node] = rows
            stack += below

    def cut(self, node: int) -> float:
        """The node's threshold; one that the sample is too small for is worked out when it is first asked for."""
        if node not in self.cuts:
            above = node
            while above and above not in self.rows:
                above >>= 1
            some = self.sample[self.rows[above]] if above else self.sample
            self.cuts[node] = float(np.median(some @ direction(self.number, node, some.shape[1]))) if len(some) else 0.0
        return self.cuts[node]

    def route(self, vectors: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs; depth is each row's own."""
        rows, leaves = [], []
        stack = [(1, np.arange(len(vectors)))]
        while stack:
            node, at = stack.pop()
            level = node.bit_length() - 1
            done = depth[at] <= level
            if done.any():
                rows.append(at[done])
                leaves.append(np.full(int(done.sum()), node))
                at = at[~done]
            if not len(at):
                continue
            projected, middle = vectors[at] @ direction(self.number, node, vectors.shape[1]), self.cut(node)
            stack += [(2 * node, at[projected <= middle + self.gap]), (2 * node + 1, at[projected > middle - self.gap])]
        return np.concatenate(rows or [np.zeros(0, int)]), np.concatenate(leaves or [np.zeros(0, int)])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as stored, 4 or 8 bytes a component, in double precision."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f4" if len(raw[0]) == 4 * dims else "<f8").reshape(-1, dims).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dims, raw (components, little-endian, in the precision they have) of the vectors that may link."""
    single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    kind = "<f4" if single else "<f8"
    ok = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("embedding")
            values, offsets = np.asarray(lists.values, kind) + np.dtype(kind).type(0), lists.offsets.to_numpy()  # no negative zero
            raw = [values[a:z].tobytes() for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            dims = np.diff(offsets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(dims), pa.array(raw, pa.binary())], names=["vec_id", "label", "dims", "raw"])

    chosen = vectors.where(F.coalesce(ok, F.lit(False))).select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<float>" if single else "array<double>"))
    return chosen.mapInArrow(run, "vec_id long, label string, dims int, raw binary")


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Of distinct vectors (vec, n, label, dims, raw): vec, root (of a spanning forest), others (linked copies)."""
    sizes = classes.groupBy("label", "dims").agg(F.count("*").alias("size"))
    # One row for each number of components that occurs.
    shapes = {r.dims: (r.total, r.most) for r in sizes.groupBy("dims").agg(F.sum("size").alias("total"), F.max("size").alias("most")).collect()}
    if not shapes:
        return classes.sparkSession.createDataFrame([], "vec long, root long, others long")
    bytes_ = 8 * sum(dims * total for dims, (total, _) in shapes.items())
    share = min(1.0, SAMPLE / sum(t for t, _ in shapes.values()), SAMPLE_BYTES / bytes_)
    chosen = classes.where(F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < share * (1 << 30)).select("dims", "raw").collect()
    forest = {}
    for dims, (_, most) in shapes.items():
        sample = [r.raw for r in chosen if r.dims == dims]
        sample = _unit(_matrix(pa.array(sample, pa.binary()), dims)) if sample else np.zeros((0, dims))
        depth = min(DEEPEST, max(0, math.ceil(math.log2(most / LEAF))))
        forest[dims] = [Tree(t, sample, depth, margin(cosine, dims)) for t in range(TREES if depth else 1)]
    shared = classes.sparkSession.sparkContext.broadcast(forest)  # the sample, and a threshold for every FIT of it

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                shape, depth = b.column("dims").to_numpy(), np.ceil(np.log2(np.maximum(1, b.column("size").to_numpy() / LEAF))).astype(int)
                for dims in np.unique(shape):
                    here = np.flatnonzero(shape == dims)
                    vectors = _unit(_matrix(b.column("raw").take(pa.array(here)), int(dims)))
                    own = np.minimum(depth[here], DEEPEST)
                    found = []
                    for tree in shared.value[int(dims)]:  # a class that is not split is compared in the first tree alone
                        some = np.flatnonzero((own > 0) | (tree.number == 0))
                        at_, leaf = tree.route(vectors[some], own[some])
                        found.append((some[at_], leaf))
                    rows = np.concatenate([r for r, _ in found])
                    codes = np.concatenate([(np.int64(t) << 48) | leaf for t, (_, leaf) in enumerate(found)])
                    order = np.lexsort((codes, rows))
                    rows, codes = rows[order], codes[order]
                    edges = np.searchsorted(rows, np.arange(len(here) + 1))
                    lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(codes))
                    take = pa.array(here[rows])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(c).take(take) for c in ("label", "dims")] + [pa.array(codes)] + [b.column(c).take(take) for c in ("vec", "n", "raw")] + [lists.take(pa.array(rows))],
                        names=["label", "dims", "leaf", "vec", "n", "raw", "leaves"],
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Rows] = []  # rows come sorted: one leaf is held at a time
        for b in batches:
            out: list[tuple[np.ndarray, ...]] = []
            for rows in _leaves(b):
                if held and held[-1].key != rows.key:
                    out += leaf_links(Rows.joined(held), cosine)
                    held = []
                held.append(rows)
            yield _found(out)
        yield _found(leaf_links(Rows.joined(held), cosine) if held else [])

    named = classes.join(sizes, ["label", "dims"]).select("label", "dims", "vec", "n", "raw", "size")
    filed = named.mapInArrow(file, "label string, dims int, leaf long, vec long, n long, raw binary, leaves array<long>")
    dealt = deal(filed, ["label", "dims", "leaf"], F.col("vec"), HOT)
    columns = ("label", "dims", "leaf", "block", "mine", "vec", "n", "raw", "leaves")
    return dealt.select(*columns).sortWithinPartitions("label", "dims", "leaf", "block", "vec").mapInArrow(compare, "vec long, root long, others long")


@dataclass
class Rows:
    """Rows of one leaf (or of one pair of its blocks): their key, vectors, ids, numbers of copies, blocks and leaves."""

    key: tuple  # label, dims, leaf, block
    x: np.ndarray
    vec: np.ndarray
    n: np.ndarray
    mine: np.ndarray
    codes: np.ndarray  # (rows, TREES, the most leaves of a tree that a row has), -1 where there are fewer

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        if len(parts) == 1:
            return parts[0]
        wide = max(p.codes.shape[2] for p in parts)
        codes = [np.pad(p.codes, ((0, 0), (0, 0), (0, wide - p.codes.shape[2])), constant_values=-1) for p in parts]
        return Rows(parts[0].key, *(np.concatenate([getattr(p, c) for p in parts]) for c in ("x", "vec", "n", "mine")), np.concatenate(codes))


def _leaves(batch: pa.RecordBatch) -> Iterator[Rows]:
    """The leaves of a sorted batch, in order."""
    if not batch.num_rows:
        return
    names = batch.column("label").to_pylist()
    dims, leaf, block = (batch.column(c).to_numpy() for c in ("dims", "leaf", "block"))
    label = batch.column("label").dictionary_encode().indices.to_numpy()
    shape = np.concatenate([[0], np.flatnonzero((dims[1:] != dims[:-1]) | (label[1:] != label[:-1])) + 1, [batch.num_rows]])
    for low, high in zip(shape[:-1].tolist(), shape[1:].tolist(), strict=True):
        step = max(1, (8 << 20) // (8 * int(dims[low])))
        for at in range(low, high, step):
            part = batch.slice(at, min(step, high - at))
            x, codes = _matrix(part.column("raw"), int(dims[low])), _codes(part.column("leaves"))
            vec, n, mine = (part.column(c).to_numpy() for c in ("vec", "n", "mine"))
            here, which = leaf[at : at + len(vec)], block[at : at + len(vec)]
            edges = np.concatenate([[0], np.flatnonzero((here[1:] != here[:-1]) | (which[1:] != which[:-1])) + 1, [len(vec)]]).tolist()
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                yield Rows((names[at], int(dims[low]), int(here[a]), int(which[a])), x[a:z], vec[a:z], n[a:z], mine[a:z], codes[a:z])


def _codes(lists: pa.Array) -> np.ndarray:
    """Lists of leaves (tree << 48 | node, ascending) as an array of rows, trees and places."""
    flat, offsets = lists.flatten().to_numpy(), lists.offsets.to_numpy()
    row, tree = np.repeat(np.arange(len(lists)), np.diff(offsets)), flat >> 48
    fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (tree[1:] != tree[:-1])])
    first = np.flatnonzero(fresh)
    place = np.arange(len(flat)) - np.repeat(first, np.diff(np.append(first, len(flat))))
    out = np.full((len(lists), TREES, int(place.max()) + 1), -1, np.int64)
    out[row, tree, place] = flat
    return out


def _found(links: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*links, strict=True) if links else [()] * 3)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["vec", "root", "others"])


def _met_before(codes: np.ndarray, a: np.ndarray, b: np.ndarray, leaf: int) -> np.ndarray:
    """Whether the rows a and b share a leaf that comes before this one."""
    out = np.zeros(len(a), bool)
    for tree in range((leaf >> 48) + 1):
        left = np.flatnonzero(~out)
        if not len(left):
            break
        one, two = codes[a[left], tree][:, :, None], codes[b[left], tree][:, None, :]
        out[left] = ((one == two) & (one >= 0) & (one < leaf)).any((1, 2))
    return out


def leaf_links(rows: Rows, cosine: float) -> list[tuple[np.ndarray, ...]]:
    """(vec, root, others) of one leaf's rows that link, if any; each pair counts if this is its first leaf."""
    if len(rows.vec) < 2:
        return []
    leaf, block = rows.key[2], rows.key[3]
    x, vec, n, mine = rows.x, rows.vec, rows.n, rows.mine
    x = x / np.abs(x).max(1, keepdims=True)
    norm = np.sqrt((x * x).sum(1))
    low, high = block >> 24, block & ((1 << 24) - 1)
    count, root_a, root_b = np.zeros(len(vec), np.int64), [np.zeros(0, int)], [np.zeros(0, int)]
    for at in range(0, len(vec), 512):
        c = (x[at : at + 512] @ x[at:].T) / (norm[at : at + 512, None] * norm[None, at:])
        i, j = np.nonzero(np.triu(c >= cosine, 1))
        i, j = i + at, j + at
        if low != high:  # two blocks: pairs inside one of them have a group of their own
            across = mine[i] != mine[j]
            i, j = i[across], j[across]
        for k in range(0, len(i), 100_000):
            a, b = i[k : k + 100_000], j[k : k + 100_000]
            root_a.append(a)
            root_b.append(b)
            once = ~_met_before(rows.codes, a, b, leaf)
            np.add.at(count, a[once], n[b[once]])
            np.add.at(count, b[once], n[a[once]])
    a, b = np.concatenate(root_a), np.concatenate(root_b)
    if not len(a):
        return []
    root = local_roots(len(vec), a, b)
    said = np.flatnonzero((count > 0) | (root != np.arange(len(vec))))
    return [(vec[said], vec[root[said]], count[said])]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    good = cut(usable(vectors))
    classes = cut(good.groupBy("label", "dims", "raw").agg(F.min("vec_id").alias("vec"), F.count("*").alias("n")))
    found = cut(links(classes, cosine))
    joined = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("vec").agg(F.sum("others").alias("others"))
    facts = (
        classes.join(counts, "vec", "left")
        .join(joined, F.col("vec") == F.col("node"), "left")
        .select("label", "dims", "raw", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "vec").alias("component_id"))
    )
    linked = good.join(facts, ["label", "dims", "raw"]).select("vec_id", "n_links", "component_id")
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("_links"), F.min("component_id").alias("_component"))
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, "vec_id", "left")
    component = F.coalesce("_component", "vec_id")
    return every.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
