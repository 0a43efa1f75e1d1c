"""Files of token ids in independent zstandard frames, with a trailing seek table and a checksum for each frame.

A file is in the public seekable format of zstandard: any zstandard tool can decompress it, and a reader that knows the
table decompresses only the frames that it needs.

    data frames       the ids of the documents one after another, 32 bits, little-endian, `frame_ids` in each but the last
    directory frames  among the data frames, one for every `directory_docs` documents: n (64 bits), n doc_ids (64 bits), n
                      bytes (1: the doc_id is null), n ends in ids (64 bits)
    index frame       the last one: for each directory its frame, its documents, the ids before it, its first and its last
                      doc_id, and whether these are null, 64 bits each
    skippable frame   0x184D2A5E, its size; for each frame its compressed and its decompressed size and the low 32 bits
                      of the XXH64 of its content; the number of frames, 0x80 (checksums are there), 0x8F92EAB1

A reader of one document decompresses the index, the directories that can have its doc_id, and its data frames. A writer
holds one frame and one directory.

Files hold documents in ascending order of doc_id, nulls first, and shard s lies before shard s + 1. Repeated doc_ids
are documents of their own, ordered by text. Null texts are empty. An empty table has no files. A file is written under
the attempt's own name and then moved, so a task that runs again after a lost executor does no harm.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.columns import text_slices
from ledgerloom.llm.tokens import SLICE_BYTES, binary, encoder, with_end
from ledgerloom.shipping import ship

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


def file_system(uri: str):
    """The file system of a URI and the path there, as executors see it."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class Writer:
    """Writes one file to an open stream."""

    def __init__(self, out, frame_ids: int = 1 << 16, level: int = 3, directory_docs: int = 1 << 14):
        import zstandard

        self.out, self.frame_ids, self.directory_docs = out, frame_ids, directory_docs
        self.table: list[tuple[int, int, int]] = []
        self.z = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.n_docs = self.n_listed = 0
        self.docs: list[tuple[int | None, int]] = []  # not in a directory yet: doc_id, end
        self.index: list[tuple[int, ...]] = []

    def _frame(self, content: bytes) -> None:
        import xxhash

        packed = self.z.compress(content)
        self.out.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def _directory(self) -> None:
        part, self.docs = self.docs[: self.directory_docs], self.docs[self.directory_docs :]
        keys, ends = [d for d, _ in part], [e for _, e in part]
        self.index.append((len(self.table), len(part), self.n_listed, keys[0] or 0, keys[-1] or 0, keys[0] is None, keys[-1] is None))
        self._frame(struct.pack("<q", len(keys)) + np.array([d or 0 for d in keys], "<i8").tobytes() + bytes(d is None for d in keys) + np.array(ends, "<i8").tobytes())
        self.n_listed = ends[-1]

    def add(self, doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.docs += zip(doc_ids, (self.n_ids + bounds[1:]).tolist(), strict=True)
        self.n_docs += len(doc_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.frame_ids:
            joined, at = np.concatenate(self.held).astype("<u4"), 0
            while len(joined) - at >= self.frame_ids:
                self._frame(joined[at : at + self.frame_ids].tobytes())
                at += self.frame_ids
            self.held, self.n_held = [joined[at:]], len(joined) - at
        while len(self.docs) >= self.directory_docs:
            self._directory()

    def close(self) -> None:
        if self.n_held:
            self._frame(np.concatenate(self.held).astype("<u4").tobytes())
        if self.docs:
            self._directory()
        self._frame(np.array(self.index, "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, 12 * len(self.table) + 9))
        self.out.write(b"".join(struct.pack("<III", *x) for x in self.table))
        self.out.write(struct.pack("<IBI", len(self.table), 0x80, SEEKABLE))


class Directory:
    """Some documents in a row: doc_ids, nulls, and their bounds in ids of the file."""

    def __init__(self, content: bytes, before: int):
        k = struct.unpack_from("<q", content)[0]
        self.doc_ids = np.frombuffer(content, "<i8", k, 8)
        self.nulls = np.frombuffer(content, np.uint8, k, 8 + 8 * k).astype(bool)
        self.bounds = np.concatenate([[before], np.frombuffer(content, "<i8", k, 8 + 9 * k)])


class Reader:
    """Reads documents from a file that can be read at any place; decompresses only the frames that hold them."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags != 0x80:
            raise ValueError("no seek table with checksums")
        begin = size - 17 - 12 * n
        head, length = struct.unpack("<II", self._at(begin, 8))
        if head != SKIPPABLE or length != 12 * n + 9:
            raise ValueError("the seek table is damaged")
        table = np.frombuffer(self._at(begin + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.sizes, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.places = np.concatenate([[0], np.cumsum(self.packed)])
        self.index = np.frombuffer(self.frame(n - 1), "<i8").reshape(-1, 7)
        self.data = np.setdiff1d(np.arange(n - 1), self.index[:, 0])  # the frames of ids
        self.first = np.concatenate([[0], np.cumsum(self.sizes[self.data])]) // 4  # ids before each of them

    def _at(self, place: int, n: int) -> bytes:
        self.source.seek(place)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        try:
            content = zstandard.ZstdDecompressor().decompress(self._at(int(self.places[k]), int(self.packed[k])), max_output_size=int(self.sizes[k]))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame {k} is damaged") from e
        if len(content) != self.sizes[k] or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"the checksum of frame {k} is wrong")
        return content

    def directories(self) -> Iterator[Directory]:
        for k in range(len(self.index)):
            yield self.directory(k)

    def directory(self, k: int) -> Directory:
        return Directory(self.frame(int(self.index[k, 0])), int(self.index[k, 2]))

    def ids(self, a: int, b: int) -> np.ndarray:
        """The ids from place a to b of this file."""
        if a == b:
            return np.zeros(0, "<u4")
        k, last = (int(np.searchsorted(self.first, x, "right")) - 1 for x in (a, b - 1))
        joined = np.frombuffer(b"".join(self.frame(int(x)) for x in self.data[k : last + 1]), "<u4")
        return joined[a - self.first[k] : b - self.first[k]]

    def documents(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this doc_id."""
        _, _, _, low, high, low_null, high_null = self.index.T
        # nulls come first
        may = low_null == 1 if doc_id is None else ((low_null == 1) | (low <= doc_id)) & (high_null == 0) & (high >= doc_id)
        out = []
        for k in np.flatnonzero(may).tolist():
            d = self.directory(k)
            found = np.flatnonzero(d.nulls) if doc_id is None else np.flatnonzero((d.doc_ids == doc_id) & ~d.nulls)
            out += [self.ids(int(d.bounds[x]), int(d.bounds[x + 1])) for x in found]
        return out


#: Bytes of a table's files that make one shard, where there are more than shuffle partitions of them.
SHARD_BYTES = 256 << 20


def _shards(docs: DataFrame) -> int:
    """spark.sql.shuffle.partitions, or more for tables that Spark knows to be large."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, -(-size // SHARD_BYTES)) if size < 1 << 60 else least  # more: Spark does not know


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shards: int | None = None, frame_ids: int = 1 << 16) -> list[tuple[int, str, int, int]]:
    """Writes all documents and returns the manifest: (shard, path, documents, ids before the shard), a row a file.

    The driver gets one small row for each file, which is as many as there are partitions. shards: by default
    as many as there are shuffle partitions, or more for tables beyond SHARD_BYTES for each of them."""
    spark = docs.sparkSession
    ship(spark)
    n = shards or _shards(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get(), encoder(tokenizer)
        parts = text_slices(batches, limit=SLICE_BYTES)
        if (part := next(parts, None)) is None:
            return
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        path, own = f"{root}/shard-{task.partitionId():06d}.ids.zst", f"{root}/_attempt-{task.taskAttemptId()}"
        with fs.open_output_stream(own) as out:
            writer = Writer(out, frame_ids)
            while part is not None:
                writer.add(part.column("doc_id").to_pylist(), *with_end(*enc.ids(part.column("text")), end_id))
                part = next(parts, None)
            writer.close()
        fs.move(own, path)
        yield pa.record_batch([pa.array([x]) for x in (task.partitionId(), path, writer.n_docs, writer.n_ids)], names=["shard", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    found = sorted(rows.mapInArrow(run, "shard long, path string, n_docs long, n_ids long").collect())
    before = np.concatenate([[0], np.cumsum([r.n_ids for r in found], dtype=np.int64)]).tolist()
    return [(r.shard, r.path, r.n_docs, b) for r, b in zip(found, before, strict=False)]


def read(spark: SparkSession, manifest: list[tuple[int, str, int, int]], folder: str, group: int = 1 << 20) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, ids."""
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                _, path, _, before = manifest[k]
                with file_system(folder)[0].open_input_file(path) as source:
                    r = Reader(source)
                    for d in r.directories():
                        at = 0
                        while at < len(d.doc_ids):
                            end = max(at + 1, int(np.searchsorted(d.bounds, d.bounds[at] + group, "right")) - 1)
                            bounds = d.bounds[at : end + 1]
                            ids = r.ids(int(bounds[0]), int(bounds[-1]))
                            yield pa.record_batch(
                                [pa.array(d.doc_ids[at:end], mask=d.nulls[at:end]), pa.array(before + bounds[:-1]), pa.array(np.diff(bounds)), binary(ids, bounds - bounds[0]).cast(pa.binary())],
                                names=["doc_id", "start", "n_tokens", "ids"],
                            )
                            at = end

    ship(spark)
    return spark.range(0, len(manifest), 1, max(1, len(manifest))).mapInArrow(run, schema)
