"""Packing of token ids into windows by Karmarkar-Karp multiway differencing.

Every task packs what it reads, group by group, so nothing is shuffled and memory is bounded by a group. Pieces of a
full window are cut from longer documents first. The remainders of a group are merged by differencing into
near-equal windows; a reserve of short pieces, cut from the group's last documents, evens the sums out to about one
token, and the group is closed just below a multiple of the capacity. Where a window still exceeds the capacity, the
number of windows rises.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ._arrow import bound_batches, id_and_text, slices
from ._kk import windows
from ._word_tokens import word_tokens

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


class Packer:
    """Takes documents' ids one by one; ``take()`` returns the pieces of the groups closed so far.

    capacity: tokens of a window. group: windows of a group. reserve: lengths of the short pieces cut for each window
    of a group. slack: tokens that a group leaves free for each of its windows.
    """

    def __init__(self, first_sequence: int, capacity: int = 2048, group: int = 128, reserve: tuple[int, ...] = (32, 16, 8, 4, 2, 1), slack: int = 1):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self.reserve, self.slack = capacity, tuple(sorted((r for r in reserve if r < capacity), reverse=True)), slack
        self.coarse_room = max(capacity, group * (capacity - slack) - group * sum(self.reserve))
        self.group = group
        self.sequence = first_sequence
        self.rows: list[tuple] = []
        self._open()

    def _open(self) -> None:
        self.pieces: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.total = 0
        self.fine: list[int] | None = None

    def add(self, doc_id, ids: np.ndarray) -> None:
        at, n, cap = 0, len(ids), self.capacity
        while n - at >= cap:
            self._row((doc_id, at, ids[at : at + cap], n), self.sequence, 0)
            self.sequence += 1
            at += cap
        while at < n:
            if self.fine is None:
                take = min(n - at, self.coarse_room - self.total)
            else:
                take = min(n - at, self.fine[-1])
            self.pieces.append((doc_id, at, ids[at : at + take], n))
            self.total += take
            at += take
            if self.fine is None:
                if self.total >= self.coarse_room:
                    self.fine = sorted(self.reserve * self.group)
            elif take < self.fine[-1]:
                self.fine[-1] -= take
            else:
                self.fine.pop()
            if self.fine is not None and not self.fine:
                self._close()

    def finish(self) -> None:
        """Packs an unfinished group; its last pieces are cut short, as those of other groups are."""
        if self.fine is None and self.pieces:
            k = -(-self.total // self.capacity)
            lengths = [*self.reserve] * k
            room = min(sum(lengths), self.total // 2)
            cut: list[tuple] = []
            while room > 0:
                doc_id, start, ids, n = self.pieces.pop()
                keep = max(0, len(ids) - room)
                if keep:
                    self.pieces.append((doc_id, start, ids[:keep], n))
                room -= len(ids) - keep
                while keep < len(ids):
                    take = min(len(ids) - keep, lengths.pop(0) if lengths else 1)
                    cut.append((doc_id, start + keep, ids[keep : keep + take], n))
                    keep += take
            self.pieces += cut
        self._close()

    def _close(self) -> None:
        for _, members in windows([len(p[2]) for p in self.pieces], self.capacity):
            offset = 0
            for m in sorted(members):
                self._row(self.pieces[m], self.sequence, offset)
                offset += len(self.pieces[m][2])
            self.sequence += 1
        self._open()

    def _row(self, piece: tuple, sequence: int, offset: int) -> None:
        doc_id, start, ids, n = piece
        self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4")), n, sequence, offset))

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=NAMES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, **options) -> DataFrame:
    """Packs all documents into windows of at most ``capacity`` tokens; one row for each piece of a document.

    A document's ids are those of the tokenizers library for its whole text, then ``end_id``. Each id lies in exactly
    one piece. ``sequence_id`` is unique: the input partition in its upper bits, a counter in its lower 32; ``offset``
    is gapless from 0 in each sequence.

    Null texts count as empty and hold just the end id (without one they make no piece). A null ``doc_id`` and
    repeated rows are packed like any others, each row a document of its own. An empty table gives no rows; very
    long texts are cut; other columns are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_tokens(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, capacity, **options)
        for part in slices(batches):
            ids, bounds = encoder.encode(part.column("text"))
            for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                own = ids[bounds[k] : bounds[k + 1]]
                packer.add(doc_id, own if end_id is None else np.append(own, own.dtype.type(end_id)))
            if rows := packer.take():
                yield _batch(rows)
        packer.finish()
        if rows := packer.take():
            yield _batch(rows)

    return id_and_text(docs).mapInArrow(run, SCHEMA)
