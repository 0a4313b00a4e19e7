"""Byte-level BPE as a monoid: halves are encoded recursively and joined at their boundary.

A token sequence is the encoding of its bytes exactly if each pair of neighbours is the encoding of its own bytes.
So when two encodings are joined, a window of tokens around the boundary is encoded anew and grows until the pairs
at its two edges are such pairs; the tokens outside can't change then. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import bound_batches, id_and_text, slices

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class TreeBpe:
    """Encodes and decodes with the given ranks. leaf: bytes up to which a span is merged directly.

    Leaves and boundary windows recur far more often than words, so their encodings are kept (up to ``kept`` each).
    """

    def __init__(self, ranks: dict[bytes, int], leaf: int = 6, kept: int = 200_000):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.leaf = max(1, leaf)
        self.kept = kept
        self.pairs: dict[tuple[int, int], bool] = {}
        self.spans: dict[bytes, list[int]] = {}

    def _direct(self, raw: bytes) -> list[int]:
        """The lowest rank merges first, the leftmost of equal ones."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        parts = [raw[k : k + 1] for k in range(len(raw))]
        found = [ranks.get(raw[k : k + 2]) for k in range(len(raw) - 1)]
        while True:
            best, at = None, -1
            for k, r in enumerate(found):
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                return [ranks[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at < len(found):
                found[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                found[at - 1] = ranks.get(parts[at - 1] + parts[at])

    def _stable(self, a: int, b: int) -> bool:
        """Whether two neighbours are the encoding of their own bytes."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > self.kept:
                self.pairs.clear()
            known = self.pairs[a, b] = self._span(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def _span(self, raw: bytes) -> list[int]:
        """A leaf or window; the list is not to be changed."""
        found = self.spans.get(raw)
        if found is None:
            found = self._direct(raw)
            if len(raw) <= 24:
                if len(self.spans) > self.kept:
                    self.spans.clear()
                self.spans[raw] = found
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the two texts together, from that of each."""
        if not left or not right:
            return left + right
        if self._stable(left[-1], right[0]):
            return left + right
        size = 1
        while True:
            i, j = min(size, len(left)), min(size, len(right))
            raw = b"".join(map(self.tokens.__getitem__, left[len(left) - i :] + right[:j]))
            window = self._span(raw)
            keep_left, keep_right = left[: len(left) - i], right[j:]
            if (not keep_left or self._stable(keep_left[-1], window[0])) and (not keep_right or self._stable(window[-1], keep_right[0])):
                return keep_left + window + keep_right
            size *= 2

    def encode(self, raw: bytes) -> list[int]:
        """Token ids of the bytes of one match."""
        if len(raw) <= self.leaf:
            return self._span(raw) if raw else []
        half = len(raw) // 2
        return self.join(self.encode(raw[:half]), self.encode(raw[half:]))

    def decode(self, ids: list[int], leaf: int = 1 << 12) -> bytes:
        """The bytes of ids, concatenated up the tree."""
        level = [b"".join(map(self.tokens.__getitem__, ids[k : k + leaf])) for k in range(0, len(ids), leaf)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


#: Letters and numbers of the first 256 characters, for a pattern that the faster module can match.
LETTERS, NUMBERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
#: Separators that Python counts as white space and the pattern's own engine doesn't, and what lies beyond LATIN.
ODD = re.compile(r"[\x1c-\x1fĀ-\U0010ffff]").search


class TextBpe:
    """Whole texts: each match of the pattern is encoded separately, and kept in a cache of bounded size."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, latin: bool, capacity: int = 300_000):
        import regex

        # fullwidth: \s of the pattern's engine is White_Space, without U+001C to U+001F
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\t-\r \x85\xa0\p{Z}").replace(r"\s", r"[\t-\r \x85\xa0\p{Z}]").replace(r"\S", r"[^\t-\r \x85\xa0\p{Z}]")).findall
        self.latin = LATIN.findall if latin else None
        self.tree = TreeBpe(ranks)
        self.capacity = capacity
        self.ids: dict[str, tuple[int, ...]] = {}
        self.texts: dict[str, str] = {}

    def matches(self, text: str) -> list[str]:
        return self.latin(text) if self.latin and not ODD(text) else self.find(text)

    def learn(self, matches: list[str]) -> None:
        """Encodes what the cache lacks."""
        ids, texts = self.ids, self.texts
        if len(ids) > self.capacity:
            ids.clear()
            texts.clear()
        for m in {*matches}.difference(ids):
            found = ids[m] = tuple(self.tree.encode(m.encode()))
            texts[m] = " ".join(map(str, found))

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text."""
        matches = self.matches(text)
        self.learn(matches)
        return list(chain.from_iterable(map(self.ids.__getitem__, matches)))

    def row(self, text: str) -> tuple[int, str, str]:
        """(number of ids, digest of the ids, digest of the decoded bytes)."""
        matches = self.matches(text)
        self.learn(matches)
        ids = list(chain.from_iterable(map(self.ids.__getitem__, matches)))
        shown = " ".join(map(self.texts.__getitem__, matches))
        return len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(self.tree.decode(ids)).hexdigest()


_made: dict[tuple, TextBpe] = {}


def text_bpe(path: str, pattern: str) -> TextBpe:
    """One encoder for each Python worker."""
    if (path, pattern) not in _made:
        import public_tokenizers

        _made[path, pattern] = TextBpe(load_ranks(path), pattern, latin=pattern == public_tokenizers.PATTERN)
    return _made[path, pattern]


def encode_ids(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; a null or empty text has no ids. Rows stay as they are otherwise."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = text_bpe(ranks, pattern)
        for part in slices(batches):
            ids = [bpe.encode(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of rows of ``encode_ids``; null ids count as none."""
    bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = text_bpe(ranks, pattern).tree
        for batch in batches:
            raw = [tree.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def encode_digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Encodes and decodes every whole text; returns counts and digests, one row for each row of ``docs``.

    A null text counts as empty: no ids, and the digests of no bytes. A null doc_id stays null; repeated rows give
    repeated rows; an empty table gives none; other columns are ignored.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = text_bpe(ranks, pattern)
        for part in slices(batches):
            n, ids, raw = zip(*map(bpe.row, part.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, SCHEMA)
