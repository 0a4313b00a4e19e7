"""Token ids in files of shuffled planes: blocks of ids are transposed into bit or byte planes, each compressed.

A shard file holds, in this order: MAGIC; for each block of ``block`` ids its planes, each a zstandard frame; the
document index (zstandard frames of doc ids, of null flags and of id counts); the chunk index (for each block its place,
its number of ids and the lengths of its planes), as JSON; the length of that JSON as 8 bytes; MAGIC. A reader needs the tail alone
to find the blocks that hold a given id.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bound_batches, id_and_text, slices
from ._shared import fresh, open_fs
from ._word_tokens import word_tokens

MAGIC = b"TLPLANE1"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, mode: str = "byte") -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first; higher planes that are all zero are left out."""
    ids = np.ascontiguousarray(ids, "<u4")
    bits = int(ids.max()).bit_length() if len(ids) else 0
    rows = ids.view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(-(-bits // 8))]
    if mode != "bit":
        raise ValueError("mode is byte or bit")
    return [np.packbits((rows[:, k // 8] >> (k % 8)) & 1, bitorder="little").tobytes() for k in range(bits)]


def from_planes(planes: list[bytes], n: int, mode: str = "byte") -> np.ndarray:
    """The ids that ``to_planes`` took."""
    rows = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        raw = np.frombuffer(plane, np.uint8)
        if mode == "byte":
            rows[:, k] = raw
        else:
            rows[:, k // 8] |= np.unpackbits(raw, count=n, bitorder="little") << (k % 8)
    return rows.reshape(-1).view("<u4")


class ShardWriter:
    """Writes one shard; ids wait in memory until they fill a block."""

    def __init__(self, out, block: int = 1 << 18, mode: str = "byte", level: int = 3):
        import zstandard

        self.out, self.block, self.mode = out, block, mode
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.at = out.write(MAGIC) or len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.held = self.n_tokens = 0
        self.chunks: list[list] = []
        self.doc_ids: list = []
        self.counts: list[np.ndarray] = []

    def _put(self, raw: bytes) -> int:
        self.out.write(raw)
        self.at += len(raw)
        return len(raw)

    def add(self, doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.counts.append(np.asarray(counts, "<i8"))
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_tokens += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, "<u4")
        to = len(ids) if last else len(ids) - len(ids) % self.block
        for k in range(0, to, self.block):
            part = ids[k : min(k + self.block, to)]
            place = self.at
            self.chunks.append([place, len(part), [self._put(self.compress(p)) for p in to_planes(part, self.mode)]])
        self.waiting, self.held = [ids[to:].copy()], len(ids) - to

    def finish(self) -> None:
        self._flush(True)
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        own = np.array([d or 0 for d in self.doc_ids], "<i8")
        counts = np.concatenate(self.counts) if self.counts else np.empty(0, "<i8")
        place = self.at
        index = [self._put(self.compress(x.tobytes())) for x in (own, null, counts)]
        tail = json.dumps({"mode": self.mode, "documents": [place, len(own), index], "chunks": self.chunks}).encode()
        self.out.write(tail + struct.pack("<Q", len(tail)) + MAGIC)


class ShardReader:
    """Reads a shard by its index; ``f`` is a seekable file."""

    def __init__(self, f):
        import zstandard

        self.f = f
        self.expand = zstandard.ZstdDecompressor().decompress
        size = f.seek(0, os.SEEK_END)
        size = f.tell() if size is None else size
        (n,) = struct.unpack("<Q", self._at(size - 16, 8))
        if self._at(size - 8, 8) != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a token shard")
        head = json.loads(self._at(size - 16 - n, n))
        self.mode, self.chunks = head["mode"], head["chunks"]
        place, self.n_docs, lengths = head["documents"]
        parts = []
        for k in lengths:
            parts.append(self.expand(self._at(place, k)))
            place += k
        own, null, self.counts = np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<i8")
        self.doc_ids = [None if z else d for d, z in zip(own.tolist(), null.tolist(), strict=True)]

    def _at(self, place: int, n: int) -> bytes:
        self.f.seek(place)
        return bytes(self.f.read(n))

    def blocks(self) -> Iterator[np.ndarray]:
        for place, n, lengths in self.chunks:
            planes = []
            for k in lengths:
                planes.append(self.expand(self._at(place, k)))
                place += k
            yield from_planes(planes, n, self.mode)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of each document; one block is held at a time, besides the document's own ids."""
        blocks, held = self.blocks(), np.empty(0, "<u4")
        for doc_id, n in zip(self.doc_ids, self.counts.tolist(), strict=True):
            parts, lack = [], n
            while lack:
                if not len(held):
                    held = next(blocks)
                parts.append(held[:lack])
                held = held[len(parts[-1]) :]
                lack -= len(parts[-1])
            yield doc_id, parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, "<u4"), *parts])


def write_token_files(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int | None = 2, mode: str = "byte", block: int = 1 << 18) -> DataFrame:
    """Writes the ids of all documents, in ascending order of doc_id, as shard files; returns their manifest.

    Rows are dealt by ranges of doc_id, so the shards follow one another; a shard is sorted within (nulls first; rows
    of one doc_id by text). A task writes under a name of its own attempt and renames when done: a lost executor
    leaves no half-written shard. The manifest (path, n_docs, n_tokens, start: ids in earlier shards) has a row for
    each shard, so only as many rows reach the driver. ``out`` defaults to a new folder below the shared one.

    A null text counts as empty, an empty one holds the end id alone; an empty table gives no shard.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = out or fresh(spark, "token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, writer = word_tokens(tokenizer), TaskContext.get(), None
        fs, root = open_fs(folder)
        name = f"{root}/shard-{task.partitionId():08d}.tlp"
        temporary = f"{name}.{task.taskAttemptId()}"
        for part in slices(batches):
            if writer is None:
                fs.create_dir(root, recursive=True)
                file = fs.open_output_stream(temporary)
                writer = ShardWriter(file, block, mode)
            ids, bounds = encoder.encode(part.column("text"))
            if end_id is not None:
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
            writer.add(part.column("doc_id").to_pylist(), np.diff(bounds), ids)
        if writer is not None:
            writer.finish()
            file.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [name], "n_docs": [len(writer.doc_ids)], "n_tokens": [writer.n_tokens]})

    ranged = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # sorted here: a distributed sort of so few rows would sample, and so write, the shards twice
    shards = sorted(ranged.mapInArrow(run, "shard long, path string, n_docs long, n_tokens long").collect())
    start, rows = 0, []
    for s in shards:
        rows.append((s["path"], s["n_docs"], s["n_tokens"], start))
        start += s["n_tokens"]
    manifest = spark.createDataFrame(rows, "path string, n_docs long, n_tokens long, start long").withColumn("folder", F.lit(folder))
    return manifest.repartition(max(1, len(rows)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Reads shards back: a row for each document, with the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                fs, _ = open_fs(shard["folder"])
                with fs.open_input_file(shard["path"]) as f:
                    start, rows = shard["start"], []
                    for doc_id, ids in ShardReader(f).documents():
                        rows.append((doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                        start += len(ids)
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.mapInArrow(run, READ)
