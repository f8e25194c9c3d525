"""Token-id files with bit planes: blocks of ids transposed to planes, each compressed with zstandard.

A file holds the documents of one range of doc_id:

    "HFBP" | block 0 | block 1 | ... | document index | block index | tail

A block is BLOCK ids of 32 bits. Plane i is bit i of every id, packed to bytes and compressed alone;
planes that are all zero are empty. The block index has the place and the size of every plane, the
document index doc_id and length of every document, and the tail where the indexes start. So a reader
opens a file at its end and fetches only the blocks it wants.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornfold.llm.common import Run, partitions
from hornfold.llm.tokens import encoder, slices, vocabulary

MAGIC = b"HFBP"
BLOCK = 1 << 16
PLANES = 32
END_ID = 1
LEVEL = 3
TAIL = struct.Struct("<QQQQQ4s")


def planes(ids: np.ndarray) -> list[bytes]:
    """The bit planes of a block, lowest bit first; an all-zero plane is empty."""
    used = int(np.bitwise_or.reduce(ids)) if len(ids) else 0
    return [
        np.packbits((ids >> np.uint32(i)).astype(np.uint8) & 1, bitorder="little").tobytes() if used >> i & 1 else b""
        for i in range(PLANES)
    ]


def from_planes(found: list[bytes], count: int) -> np.ndarray:
    ids = np.zeros(count, "<u4")
    for i, plane in enumerate(found):
        if plane:
            bits = np.unpackbits(np.frombuffer(plane, np.uint8), count=count, bitorder="little")
            ids |= bits.astype("<u4") << np.uint32(i)
    return ids


class Writer:
    """Writes one file. It gets its name when whole, so a lost task leaves none that counts."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.part = fs, path, f"{path}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.part)
        self.out.write(MAGIC)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.at, self.tokens, self.waiting = len(MAGIC), 0, []
        self.held = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.blocks: list[tuple[int, ...]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            whole = np.concatenate(self.waiting)
            full = len(whole) // BLOCK * BLOCK
            for i in range(0, full, BLOCK):
                self._block(whole[i : i + BLOCK])
            self.waiting, self.held = [whole[full:]], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        data = [self.zstd.compress(plane) if plane else b"" for plane in planes(ids)]
        self.blocks.append((self.at, len(ids), *map(len, data)))
        self.out.write(b"".join(data))
        self.at += sum(map(len, data))
        self.tokens += len(ids)

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        index = np.asarray([i or 0 for i in self.ids], "<i8").tobytes() + np.asarray(self.lengths, "<u8").tobytes()
        if None in self.ids:  # a flag for each document, only where one has no id
            index += np.asarray([i is None for i in self.ids], "u1").tobytes()
        index = self.zstd.compress(index)
        blocks = self.zstd.compress(np.asarray(self.blocks, "<u8").tobytes())
        self.out.write(index + blocks + TAIL.pack(self.at, len(index), len(blocks), len(self.ids), self.tokens, MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        self.zstd = zstandard.ZstdDecompressor()
        tail = self._bytes(self.file.size() - TAIL.size, TAIL.size)
        at, index, blocks, docs, self.tokens, magic = TAIL.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        found = self.zstd.decompress(self._bytes(at, index))
        self.ids = np.frombuffer(found, "<i8", docs)
        self.lengths = np.frombuffer(found, "<u8", docs, 8 * docs).astype(np.int64)
        self.nulls = np.frombuffer(found, "u1", docs, 16 * docs) if len(found) > 16 * docs else np.zeros(docs, "u1")
        self.blocks = np.frombuffer(self.zstd.decompress(self._bytes(at + index, blocks)), "<u8").reshape(-1, 2 + PLANES)

    def _bytes(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, no: int) -> np.ndarray:
        at, count, *sizes = self.blocks[no].tolist()
        data, found, place = self._bytes(at, sum(sizes)), [], 0
        for size in sizes:
            found.append(self.zstd.decompress(data[place : place + size]) if size else b"")
            place += size
        return from_planes(found, count)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in the order written; holds one block and one document at a time."""
        held, no = np.zeros(0, "<u4"), 0
        ids = (None if null else i for i, null in zip(self.ids.tolist(), self.nulls.tolist(), strict=True))
        for doc_id, length in zip(ids, self.lengths.tolist(), strict=True):
            parts, missing = [], length
            while missing > len(held):
                parts.append(held)
                missing -= len(held)
                held, no = self.block(no), no + 1
            parts.append(held[:missing])
            held = held[missing:]
            yield doc_id, np.concatenate(parts)


def write(docs: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Writes files in ascending doc_id order, null first; per file ``shard``, ``path``, ``docs``, ``tokens``.

    ``folder`` is a URI of shared storage that pyarrow's file systems know (local, hdfs, s3, gs).
    A task that runs twice writes the same file twice under its one name.
    """
    ordered = (
        docs.select("doc_id", "text")
        # The start of the text splits an id, or null, that many rows share.
        .repartitionByRange(partitions(docs.sparkSession), "doc_id", F.substring("text", 1, 64))
        .sortWithinPartitions("doc_id", "text")
        .select(F.spark_partition_id().alias("shard"), F.col("doc_id").cast("long"), "text")
    )

    def to_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = shard = None
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, 2):
                if writer is None:
                    shard = part.column(0)[0].as_py()
                    fs, root = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    writer = Writer(fs, f"{root}/{shard:07d}.hfbp")
                found = encoder(path).encode(part.column(2))
                for doc_id, ids in zip(part.column(1).to_pylist(), found, strict=True):
                    writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer:
            writer.close()
            row = {"shard": [shard], "path": [writer.path], "docs": [len(writer.ids)], "tokens": [writer.tokens]}
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), types, strict=True)], list(row))

    return ordered.mapInArrow(to_file, "shard int, path string, docs long, tokens long")


def read(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Per document of the ``files`` (shard, path, before): doc_id, start, n_tokens, ids_crc32, read from them."""

    def from_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found: list[tuple[int | None, int, int, int]] = []
                for doc_id, ids in Reader(fs, path).documents():
                    found.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                columns = zip(*found, strict=True) if found else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    spread = files.select("path", "before").repartition(partitions(spark), "path")
    return spread.mapInArrow(from_file, "doc_id long, start long, n_tokens long, ids_crc32 long")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as a URI: one without a scheme is on the session's own file system, as its other tables are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found if "://" in found or not found.startswith("file:") else f"file://{found[len('file:') :]}"


def remove_parts(spark: SparkSession, folder: str) -> None:
    """Delete what lost tasks left: files that were never whole."""
    parts = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.hfbp.*")
    system = parts.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(parts) or []:
        system.delete(status.getPath(), False)


def store(
    docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID, null_ids: bool = False
) -> DataFrame:
    """Write all texts as token files and read them back; per document doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it in ascending doc_id order. Null and empty
    texts are the end id alone. Rows that share a doc_id are ordered by text. Rows without a doc_id
    come first with ``null_ids``, else they are refused. An empty table makes no file and gives an empty
    result. Columns beside doc_id and text are not looked at.
    """
    spark = docs.sparkSession
    if not null_ids and not docs.where("doc_id IS NULL").isEmpty():
        raise ValueError("documents without a doc_id can't be put in order")
    run = Run(spark, "tokens")
    base = qualified(spark, folder or run.path)
    shards = run.table(write(docs, f"{base}/files", path or vocabulary("word_bpe_49k.json"), end_id), "shards")
    remove_parts(spark, f"{base}/files")
    # One row for each file.
    rows = sorted(tuple(r) for r in shards.select("shard", "path", "tokens").collect())
    starts, before = [], 0
    for _, file, tokens in rows:
        starts.append((file, before))
        before += tokens
    files = spark.createDataFrame(starts, "path string, before long")
    return read(spark, files, f"{base}/files")
