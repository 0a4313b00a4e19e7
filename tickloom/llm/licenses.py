"""Licence scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from ._arrow import bound_batches, id_and_text, slices

#: Phrases (words in lower case) and labels that every scan reports.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Further notice phrases.
NOTICES = (
    ("apache license", "apache"), ("bsd license", "bsd"), ("cc by nc", "cc-by-nc"), ("cc by nd", "cc-by-nd"), ("cc by sa", "cc-by-sa"), ("creative commons", "cc"),
    ("gnu affero general public license", "agpl"), ("gnu lesser general public license", "lgpl"), ("isc license", "isc"), ("mit license", "mit"),
    ("mozilla public license", "mpl"), ("public domain", "public-domain"), ("without warranty of any kind", "no-warranty"), ("permission is hereby granted free of charge", "mit"),
)
TAG = "spdx-license-identifier"
#: ASCII in lower case; all that is neither a digit nor a letter becomes a space, other bytes stay.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SYMBOL = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
#: Licences that ask for more than attribution.
COPYLEFT = ("agpl", "gpl", "lgpl", "mpl", "epl", "cc-by-sa", "eupl")


@lru_cache(maxsize=None)
def automaton():
    """Phrases between spaces, and the tag; made once in each worker."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for base, table in ((True, BASE), (False, NOTICES)):
        for phrase, label in table:
            key = f" {phrase} "
            old = found.get(key, [])
            found.add_word(key, [*old, (base, label, len(key))])
    found.make_automaton()
    return found


@lru_cache(maxsize=None)
def tag_automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word(TAG, len(TAG))
    found.make_automaton()
    return found


def parse(symbols: list[str]):
    """Shunting-yard: the tree of ``with`` over ``and`` over ``or``; nested tuples (operator, left, right), or a name.

    Parsing ends at the first symbol that can't go on the expression; None if none can be read."""
    rank = {"or": 1, "and": 2, "with": 3}
    output: list = []
    operators: list[str] = []

    def reduce_() -> None:
        op, b, a = operators.pop(), output.pop(), output.pop()
        output.append((op, a, b))

    operand, depth, good = True, 0, 0
    for s in symbols:
        if operand and s == "(":
            operators.append(s)
            depth += 1
        elif operand and s not in rank and s != ")":
            output.append(s)
            operand = False
        elif not operand and s in rank:
            while operators and operators[-1] != "(" and rank[operators[-1]] >= rank[s]:
                reduce_()
            operators.append(s)
            operand = True
        elif not operand and s == ")" and depth:
            while operators[-1] != "(":
                reduce_()
            operators.pop()
            depth -= 1
        else:
            break
        good += 1
    if operand and operators and operators[-1] != "(":
        operators.pop()  # an operator without its right side
    while operators:
        if operators[-1] == "(":
            operators.pop()
        elif len(output) >= 2:
            reduce_()
        else:
            operators.pop()
    return output[-1] if output else None


def evaluated(tree) -> tuple[list[str], bool]:
    """(licences in order, whether the expression can be met without copyleft), without recursion: trees may be deep.

    An exception after ``with`` belongs to its licence, which stays what it is. Of ``or`` either side will do, ``and`` asks for both."""
    if tree is None:
        return [], False
    found: list[str] = []
    values: list[bool] = []
    todo: list = [tree]
    while todo:
        now = todo.pop()
        if isinstance(now, str):
            found.append(now)
            values.append(not now.startswith(COPYLEFT))
        elif len(now) == 1:  # both sides have their values
            b, a = values.pop(), values.pop()
            values.append(a or b if now[0] == "or" else a and b)
        elif now[0] == "with":
            todo.append(now[1])
        else:
            todo += [now[:1], now[2], now[1]]
    return found, values[0]


def permissive(tree) -> bool:
    """Whether the expression can be met without copyleft."""
    return evaluated(tree)[1]


def expressions(lowered: str) -> list:
    """The parsed expression after each identifier tag, up to the line's end or the next tag."""
    out = []
    ends = [end for end, _ in tag_automaton().iter(lowered)]
    for end, to in zip(ends, [*(e - len(TAG) + 1 for e in ends[1:]), len(lowered)], strict=True):
        stop = lowered.find("\n", end + 1, to)
        tree = parse(SYMBOL.findall(lowered[end + 1 : to if stop < 0 else stop].lstrip(" :\t")))
        if tree is not None:
            out.append(tree)
    return out


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a whole text."""
    raw = text.encode()
    words = raw.translate(FOLD).split(b" ")
    words = [w for w in words if w]
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, more, n, first, last = set(), set(), 0, None, None
    weight = 0.0
    at = spaces = 0
    for end, entries in automaton().iter(joined):
        for is_base, label, size in entries:
            if not is_base:
                more.add(label)
                continue
            n += 1
            base.add(label)
            start = end - size + 1  # of the space before the phrase
            if start >= at:
                spaces += joined.count(" ", at, start)
                at, place = start, spaces
            else:
                place = joined.count(" ", 0, start)
            first, last = place if first is None else min(first, place), place if last is None else max(last, place)
    if b"-" in raw and TAG in (lowered := raw.translate(LOWER).decode("utf-8", "replace")):
        for tree in expressions(lowered):
            found, free = evaluated(tree)
            more.update(found)
            more.add("spdx")
            weight = 1.0
            if free:
                more.add("permissive")
    if n or more:
        weight = max(weight, 1 - 0.5 ** (n + len(more)))
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), weight


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Scans every whole text; one row for each row of ``docs``.

    n_base: all places of the base phrases, overlapping ones included. first_word, last_word: the least and greatest start
    of these, null if there are none. Labels are distinct, sorted and joined by commas, empty if there are none. score:
    0 without a label, 1 with an identifier tag. A null text counts as empty. Other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    cols = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = list(zip(*map(scan, part.column("text").to_pylist()), strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(found, kinds, strict=True)]], names=cols)

    return id_and_text(docs).mapInArrow(run, SCHEMA)
