"""Shared parts of the corpus operators: checkpoints, Arrow text views, connected components.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by the vectorised kernels; bounds a Python worker's memory.
CHUNK_BYTES = 2 << 20

#: What an operator keeps in a Python worker from task to task. A worker serves all operators in turn.
KEPT: dict = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is set, a temporary one if all runs on this
    machine, as in tests; on a cluster that is an error, for executors elsewhere would not see it."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldglass-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one, removed when the driver ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder, if it is there and the session still runs."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext._jsc
    if jvm is None or context is None:
        return
    try:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone first when the driver ends
        return


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def let_go() -> None:
    """Begins a task of an operator that keeps nothing: what others kept in this worker goes, and memory that is free goes
    back to the system, as far as the C library can give it."""
    KEPT.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts take about `limit` bytes; one long text stands alone."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes.astype(np.int64)), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column back to back, and each row's bounds there (null: empty)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def text_map(docs: DataFrame, kernel, schema: str, column: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """Apply `kernel(record batch) -> record batch` to slices of bounded text size, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in text_slices(batch, column, limit):
                yield kernel(part)

    return docs.mapInArrow(run, schema)


def deal(keyed: DataFrame, keys: list[str], unit, hot: int) -> DataFrame:
    """keyed, dealt out so that each task holds whole groups, with columns `mine` and `block`.

    A group is a key's rows; a key with over `hot` rows is cut into parts by a hash of `unit`, and every pair of
    parts (low, high) is a group of its own: block is low << 24 | high, mine a row's part. Others have block 0.
    """
    over = cut(keyed.groupBy(*keys).count().where(F.col("count") > hot))
    zero = F.lit(0).cast("long")
    if over.isEmpty():
        return keyed.withColumns({"mine": zero, "block": zero}).repartition(*keys)
    many = F.coalesce(F.ceil(F.col("count") / (hot // 2)), F.lit(1)).cast("long")
    pairs = F.transform(
        F.sequence(zero, F.col("many") - 1),
        lambda other: F.shiftleft(F.least("mine", other), 24).bitwiseOR(F.greatest("mine", other)),
    )
    parted = keyed.join(over, keys, "left").withColumn("many", many).withColumn("mine", F.pmod(F.xxhash64(unit), F.col("many")))
    return parted.withColumn("block", F.explode(pairs)).drop("count", "many").repartition(*keys, "block")


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of 0..n-1 over links a-b, all in memory."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        open_ = low != high
        if not open_.any():
            break
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Distributed connected components by alternating large and small stars.

    edges: columns `a`, `b` of one orderable type; nulls and loops are ignored, repeats are harmless.
    Returns (`node`, `component`), one row per node that has a link, component being the smallest node
    reachable. Each round is two grouped minima (partial aggregates) and two joins whose skewed sides
    adaptive execution may split, so a hub's links never meet in one task; lineage is cut every round.
    """
    star = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    if star.isEmpty():
        return star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    seen = None
    for _ in range(rounds):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written out, the minima are a plain side of the join, so that a hub's links can be split among tasks.
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))
                )
            ).alias("e")
        )
        star = cut(small.select("e.a", "e.b").where("a <> b").distinct())
        now = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("connected components did not settle")
    named = star.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return named.unionByName(star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
