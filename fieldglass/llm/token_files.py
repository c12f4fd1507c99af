"""Token-id files: one zstandard frame per document, a trailing seek table, a checksum per frame.

A file is the frames in document order, one skippable frame with the documents' ids, and the seekable-format
table: a skippable frame of (compressed size, size, low half of XXH64 of the ids' bytes) per frame and a footer
that names their number. A reader takes the footer, then only the frames of the documents it wants, and checks
each against its checksum (every frame also has zstandard's own). Ids are little-endian unsigned 32-bit.

Documents are range-partitioned by doc_id, one file per partition, written by the task to a folder that all
executors share; a task's files are named for its attempt, so only the files of attempts that ended are used.
Null and empty texts hold the end id alone; a null doc_id sorts first; repeated doc_ids are ordered by text;
extra columns are dropped; an empty table gives no file and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.common import scratch, text_slices, utf8_view
from fieldglass.llm.tokenize import encoder

END_ID = 1
# Fixed values of the zstandard seekable format.
SEEK_MAGIC, SEEK_FOOTER_MAGIC, SEEK_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
DOCS_MAGIC = 0x184D2A50
NO_DOC = -(1 << 63)


class FrameWriter:
    """Writes one file; `add` in document order, then `close`."""

    def __init__(self, sink, level: int = 1):
        self.sink = sink
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = np.ascontiguousarray(ids, "<u4").tobytes()
        if len(raw) >= 1 << 32:
            raise ValueError(f"document {doc_id} has more ids than a frame can hold")
        frame = self.zstd.compress(raw)
        self.sink.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.docs.append(NO_DOC if doc_id is None else doc_id)

    def close(self) -> None:
        docs = self.zstd.compress(np.asarray(self.docs, "<i8").tobytes())
        self.sink.write(struct.pack("<II", DOCS_MAGIC, len(docs) + 4) + docs + struct.pack("<I", len(docs)))
        table = np.asarray(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self.entries), SEEK_CHECKSUMS, SEEK_FOOTER_MAGIC)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class FrameReader:
    """Reads chosen documents of one file; `source` is seekable."""

    def __init__(self, source):
        self.source, self.zstd = source, zstandard.ZstdDecompressor()
        end = source.seek(0, 2) or source.tell()
        source.seek(end - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_FOOTER_MAGIC or flags != SEEK_CHECKSUMS:
            raise ValueError("no seek table with checksums at the file's end")
        source.seek(end - 9 - 12 * n - 8)
        if struct.unpack("<II", source.read(8)) != (SEEK_MAGIC, 12 * n + 9):
            raise ValueError("the seek table's header doesn't fit its footer")
        self.entries = np.frombuffer(source.read(12 * n), "<u4").reshape(n, 3)
        source.seek(end - 9 - 12 * n - 12)
        size = struct.unpack("<I", source.read(4))[0]
        source.seek(end - 9 - 12 * n - 12 - size)
        self.docs = np.frombuffer(self.zstd.decompress(source.read(size)), "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        self.at = -1

    def ids(self, k: int) -> np.ndarray:
        if self.at != self.starts[k]:
            self.source.seek(int(self.starts[k]))
        packed = self.source.read(int(self.entries[k, 0]))
        self.at = self.starts[k + 1]
        raw = self.zstd.decompress(packed, max_output_size=int(self.entries[k, 1]))
        if len(raw) != self.entries[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} doesn't fit its checksum")
        return np.frombuffer(raw, "<u4")

    def find(self, doc_ids: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Only the frames of these documents are read."""
        for k in np.flatnonzero(np.isin(self.docs, list(doc_ids))):
            yield int(self.docs[k]), self.ids(int(k))


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, drop_blank: bool = True, added: bool = False) -> list[dict]:
    """Write docs under folder; a summary per file (path, n_docs, n_tokens, start), in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = sink = None
        tokens, first, coder = 0, None, encoder(tokenizer_path, drop_blank, added)
        for batch in batches:
            for part in text_slices(batch, "text"):
                ids, edges = coder.encode(*utf8_view(part.column("text")), end_id)
                tokens += len(ids)
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    if writer is None:
                        store, root = pyarrow.fs.FileSystem.from_uri(folder)
                        store.create_dir(root, recursive=True)
                        name = f"part-{uuid.uuid4().hex}.ids"
                        sink, first = store.open_output_stream(f"{root}/{name}", compression=None), NO_DOC if doc is None else doc
                        writer = FrameWriter(sink)
                    writer.add(doc, ids[edges[k] : edges[k + 1]])
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_docs": [len(writer.docs)], "n_tokens": [tokens], "first_doc": [first]})

    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # One small row per partition, whatever the number of documents.
    files = sorted(dealt.mapInArrow(run, "path string, n_docs long, n_tokens long, first_doc long").collect(), key=lambda r: r.first_doc)
    out, start = [], 0
    for f in files:
        out.append({"path": f.path, "n_docs": f.n_docs, "n_tokens": f.n_tokens, "start": start})
        start += f.n_tokens
    return out


READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, files: list[dict], with_ids: bool = False) -> DataFrame:
    """Every document of these files: READ_SCHEMA, and the ids themselves as `ids` if asked for."""
    schema = READ_SCHEMA + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start in ((p, s) for b in batches for p, s in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True)):
            store, place = pyarrow.fs.FileSystem.from_uri(path)
            with store.open_input_file(place) as source:
                reader, out = FrameReader(source), []
                for k, doc in enumerate(reader.docs.tolist()):
                    ids = reader.ids(k)
                    row = (None if doc == NO_DOC else doc, start, len(ids), zlib.crc32(ids))
                    out.append((*row, ids.astype(np.int64)) if with_ids else row)
                    start += len(ids)
                    if len(out) == (200 if with_ids else 5000):
                        yield batch_of(out)
                        out = []
                yield batch_of(out)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [[] for _ in schema.split(", ")]
        types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    listed = spark.createDataFrame([(f["path"], f["start"]) for f in files], "path string, start long")
    return listed.repartition(max(1, len(files)), F.col("start")).mapInArrow(run, schema)


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name below the shared one, removed when the driver ends."""
    return scratch(spark, "token-ids")
