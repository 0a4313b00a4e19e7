"""Token ids of whole texts by the tokenizers library, through a cache of white-space separated chunks.

The pre-tokenizer of the vocabulary never joins characters across white space, its normalizer neither, so the ids
of a text are those of its chunks, one after another. Each distinct chunk goes through the library; a batch's
chunks are coded by Arrow, and ids are gathered by numpy.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._arrow import plain, ragged, split_words, text_bytes

#: Letters and numbers of U+00A1 to U+00FF, beside ASCII's.
LETTERS, NUMBERS = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: The vocabulary's own split, for chunks in lower case of ASCII and Latin-1 characters; line feeds part the chunks.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|\n|[^\s{LETTERS}{NUMBERS}]+")
SIMPLE = re.compile(r"[!-~\xa1-\xff\n]+").fullmatch
#: A letter, then full stops or commas up to white space: the vocabulary splits between the two.
STOPPED = r"([a-z])([.,!?;:]+)(\s|$)"


def _byte_letters() -> np.ndarray:
    """The character that byte-level vocabularies write for each byte; the two separators used here stay."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    table = np.array([b if b in shown else next(spare) for b in range(256)], "<u2")
    table[[0x20, 0x0A]] = 0x20, 0x0A
    return table


BYTE_LETTERS = _byte_letters()


class WordTokens:
    """Encodes string arrays; ``capacity`` bounds the cache (entries), chunks over 64 characters aren't kept."""

    def __init__(self, path: str, capacity: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models

        self.tokenizer = Tokenizer.from_file(path)
        own = json.loads(self.tokenizer.to_str())["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in own["merges"]]
        # for distinct pieces that are already normalized and split; the library's own cache only costs there
        self.bare = Tokenizer(models.BPE(own["vocab"], merges, cache_capacity=0, end_of_word_suffix=own["end_of_word_suffix"]))
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        self.word_end[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith("</w>")]] = 1
        self.capacity = capacity
        self._reset()

    def _reset(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids = np.empty(1 << 16, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.starts = np.empty(1 << 15, np.int64)
        self.lengths = np.empty(1 << 15, np.int64)
        self.n_slots = self.n_ids = 0

    def _chunk_ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each chunk): simple chunks are split here, the others take the library's whole path."""
        joined = "\n".join(chunks).lower()
        if SIMPLE(joined) and "<|" not in joined:
            return self._simple_ids(joined, len(chunks))
        simple = [k for k, c in enumerate(chunks) if SIMPLE(c) and "<|" not in c and "\n" not in c]
        rest = sorted({*range(len(chunks))}.difference(simple))
        encoded = [x.ids for x in self.tokenizer.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False)]
        owner = np.repeat(rest, [len(x) for x in encoded]).astype(np.int64)
        ids = np.array([i for x in encoded for i in x], np.int64)
        if simple:
            more, each = self._simple_ids("\n".join([chunks[k] for k in simple]).lower(), len(simple))
            owner = np.concatenate([owner, np.repeat(simple, each)])
            ids = np.concatenate([ids, more])
            order = np.argsort(owner, kind="stable")
            owner, ids = owner[order], ids[order]
        return ids, np.bincount(owner, minlength=len(chunks))

    def _simple_ids(self, joined: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        pieces = PIECES.findall(joined)
        if not joined.isascii():
            raw = np.frombuffer(" ".join(pieces).encode(), np.uint8)
            pieces = BYTE_LETTERS[raw].tobytes().decode("utf-16-le").split(" ")
        ends = np.fromiter((p == "\n" for p in pieces), bool, len(pieces))
        # each distinct piece goes to the model once; a line feed has no id
        distinct = dict.fromkeys(pieces)
        encoded = self.bare.encode_batch_fast([list(distinct)], is_pretokenized=True, add_special_tokens=False)[0]
        flat = np.array(encoded.ids, np.int64)
        last = np.flatnonzero(self.word_end[flat]) + 1  # each piece has one such token, its last
        bounds = np.concatenate([[0], last])
        number = {p: k for k, p in enumerate(p for p in distinct if p != "\n")}
        number["\n"] = -1
        which = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))[~ends]
        lengths = (bounds[1:] - bounds[:-1])[which]
        owner = np.cumsum(ends)[~ends]
        return flat[ragged(bounds[which], lengths)], np.bincount(owner, weights=lengths, minlength=n).astype(np.int64)

    def _add(self, chunks: list[str]) -> np.ndarray:
        found, lengths = self._chunk_ids(chunks)
        n, total = len(chunks), len(found)
        if self.n_slots + n > len(self.starts):
            more = max(len(self.starts), n)
            self.starts, self.lengths = (np.concatenate([x, np.zeros(more, np.int64)]) for x in (self.starts, self.lengths))
        if self.n_ids + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), self.ids.dtype)])
        at = self.n_ids
        self.ids[at : at + total] = found
        slots = np.arange(self.n_slots, self.n_slots + n)
        self.starts[slots] = at + np.cumsum(lengths) - lengths
        self.lengths[slots] = lengths
        self.n_slots += n
        self.n_ids += total
        self.slot.update((c, s) for c, s in zip(chunks, slots.tolist(), strict=True) if len(c) <= 64)
        return slots

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, bounds of each row's ids); a null counts as empty."""
        col = plain(pc.fill_null(col, ""))
        raw = text_bytes(col)
        # Below U+0300 there are no combining marks: folding A-Z before the normalizer changes nothing, and saves cache.
        if not len(raw) or raw.max() < 0xCC:
            col = pc.replace_substring_regex(pc.ascii_lower(col), STOPPED, r"\1 \2\3")
        words, index, bounds = split_words(col)
        if len(self.slot) + len(words) > self.capacity:
            self._reset()
        get = self.slot.get
        slots = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = self._add([words[k] for k in new.tolist()])
        starts, lengths = self.starts[slots], self.lengths[slots]
        each = lengths[index]
        ids = self.ids[ragged(starts[index], each)]
        ends = np.concatenate([[0], np.cumsum(each)])
        return ids, ends[bounds]


_made: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """One encoder for each Python worker and vocabulary."""
    if path not in _made:
        _made[path] = WordTokens(path)
    return _made[path]
