"""Language identification of mixed-language texts: script ranges, per-word scores and a Viterbi pass.

A word's script narrows the candidate languages. Its score for each is the log-likelihood ratio of its hashed byte
n-grams, learned from a bounded sample of labelled documents. A Viterbi pass over the words of a text, with a penalty
for switching, labels spans; the language that covers most letters is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._arrow import bound_batches, id_and_text, plain, slices, split_words
from ._sample import fitted, fold, stratified

#: First and last code points of scripts (Unicode blocks).
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"),
    (0x0600, 0x06FF, "Arabic"), (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"),
    (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"), (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
)
STARTS, ENDS = (np.array([s[k] for s in SCRIPTS]) for k in (0, 1))
NAMES = sorted({s[2] for s in SCRIPTS})
NUMBER = np.array([NAMES.index(s[2]) for s in SCRIPTS])
#: ASCII characters that belong to no word.
BETWEEN = r"[\x00-@\[-`{-\x7f]+"
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """languages: the labels. grams: a table for each n-gram length, (buckets, languages). scripts: which languages a
    script leaves, (scripts + 1, languages); the last row is for other scripts."""

    languages: list[str]
    lengths: tuple[int, ...]
    grams: list[np.ndarray]
    scripts: np.ndarray
    switch: float = 12.0
    outside: float = -12.0


def _words(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    col = pc.replace_substring_regex(pc.utf8_lower(plain(pc.fill_null(col, ""))), BETWEEN, " ")
    return split_words(col)


def _script_of(words: list[str]) -> np.ndarray:
    """The script of each word's first letter; the number of scripts for any other."""
    first = np.fromiter((ord(w[0]) if w else 0 for w in words), np.int64, len(words))
    at = np.searchsorted(STARTS, first, side="right") - 1
    return np.where((at >= 0) & (first <= ENDS[at]), NUMBER[at], len(NAMES))


def _gram_buckets(words: list[str], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all n-grams of bytes; a word's edges count as a byte of their own."""
    raw = np.frombuffer(("\n" + "\n".join(words) + "\n").encode(), np.uint8).astype(np.uint32)
    if len(raw) < n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    m = len(raw) - n + 1
    h = np.zeros(m, np.uint32)
    inside = np.ones(m, bool)
    for k in range(n):
        h = h * np.uint32(0x01000193) ^ (raw[k : k + m] + np.uint32(1) + np.uint32(k << 8))
        if 0 < k < n - 1:
            inside &= raw[k : k + m] != 10
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    feeds = np.cumsum(raw == 10)
    word = feeds[:m] - 1  # a gram that starts with an edge belongs to the word after it
    inside &= word < len(words)
    return word[inside], (h[inside] % np.uint32(buckets)).astype(np.int64)


def _has_letter(words: list[str]) -> np.ndarray:
    return np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in words), bool, len(words))


def fit(texts: list[str], langs: list[str], lengths: tuple[int, ...] = (3, 4), buckets: int = 1 << 16, smooth: float = 0.5) -> LanguageModel:
    """Counts the n-grams of labelled texts. A text of a rarer language counts as one of a common one: rates, not priors."""
    languages = sorted(set(langs))
    counts = [np.zeros((buckets, len(languages))) for _ in lengths]
    scripts = np.zeros((len(NAMES) + 1, len(languages)))
    for k, language in enumerate(languages):
        own = [t for t, x in zip(texts, langs, strict=True) if x == language]
        for at in range(0, len(own), 500):
            words, index, _ = _words(pa.array(own[at : at + 500], pa.string()))
            often = np.bincount(index, minlength=len(words)) * _has_letter(words)
            scripts[:, k] += np.bincount(_script_of(words), weights=often, minlength=len(NAMES) + 1)
            for table, n in zip(counts, lengths, strict=True):
                word, bucket = _gram_buckets(words, n, buckets)
                table[:, k] += np.bincount(bucket, weights=often[word], minlength=buckets)
    grams = []
    for table in counts:
        rate = np.log((table + smooth) / (table.sum(axis=0) + smooth * buckets))
        if languages:
            rate -= rate.mean(axis=1, keepdims=True)
        grams.append(rate.astype(np.float32))
    known = scripts / np.maximum(scripts.sum(axis=0), 1)
    return LanguageModel(languages, lengths, grams, known > 0.02)


def word_scores(model: LanguageModel, words: list[str]) -> np.ndarray:
    """(words, languages): what each word says for each language; 0 for a word without letters."""
    out = np.zeros((len(words), len(model.languages)), np.float32)
    if not words:
        return out
    for table, n in zip(model.grams, model.lengths, strict=True):
        word, bucket = _gram_buckets(words, n, len(table))
        found = table[bucket]
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(word, weights=found[:, k], minlength=len(words))
    np.clip(out, -10, 10, out=out)
    allowed = model.scripts[_script_of(words)]
    out[~allowed & allowed.any(axis=1, keepdims=True)] = model.outside
    out[~_has_letter(words)] = 0
    return out


def viterbi(scores: np.ndarray, index: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word, for all texts at once: ``index`` gives each word's row of ``scores``.

    A step takes one word of every text that is long enough; texts are ordered by length, so these are the first ones.
    """
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    lengths, starts = lengths[order], bounds[:-1][order]
    labels = np.zeros(len(index), np.int32)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t
    width = scores.shape[1]
    moved = np.zeros((len(index), width), bool)
    source = np.zeros(len(index), np.int32)
    delta = np.zeros((len(lengths), width), np.float64)
    for t in range(longest):
        n = active[t]
        at = starts[:n] + t
        now = delta[:n]
        if t:
            best = now.argmax(axis=1)
            other = now[np.arange(n), best][:, None] - switch
            moved[at] = now < other
            source[at] = best
            now = np.maximum(now, other)
        delta[:n] = now + scores[index[at]]
    state = delta.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        labels[at] = state[:n]
        state[:n] = np.where(moved[at, state[:n]], source[at], state[:n])
    return labels


def label_words(model: LanguageModel, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label of each word, letters of each word, bounds of each text's words)."""
    words, index, bounds = _words(col)
    weight = np.fromiter(map(len, words), np.int64, len(words)) * _has_letter(words)
    labels = viterbi(word_scores(model, words), index, bounds, model.switch)
    return labels, weight[index], bounds


def predict(model: LanguageModel, col: pa.Array) -> tuple[list[str], np.ndarray]:
    """(language, share of the letters that it covers) of each text; ``und`` and 0 without a letter."""
    n, width = len(col), len(model.languages)
    if not width:
        return [UNKNOWN] * n, np.zeros(n)
    labels, weight, bounds = label_words(model, col)
    row = np.repeat(np.arange(n), np.diff(bounds))
    covered = np.bincount(row * width + labels, weights=weight, minlength=n * width).reshape(n, width)
    total = covered.sum(axis=1)
    best = covered.argmax(axis=1)
    score = np.where(total > 0, covered[np.arange(n), best] / np.maximum(total, 1), 0.0)
    return [model.languages[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist(), strict=True)], score


def train(docs: DataFrame, each: int = 500) -> LanguageModel:
    """Fits on about ``each`` documents of every language: whole texts with a non-null lang, in the learning fold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null").filter(fold("doc_id", 3) != 1)
    bound_batches(docs.sparkSession)
    return fitted(stratified(rows, "lang", "doc_id", each).select("text", "lang"), lambda t: fit(t.column("text").to_pylist(), t.column("lang").to_pylist()))


def _shared(spark: SparkSession, model: LanguageModel):
    """The model is of fixed size: buckets times languages."""
    return spark.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; only the text is an input of a prediction.

    held_out: crc32 of the id as text, modulo 3, is 1 (false for a null id). A text that is null or has no letter is
    ``und`` with score 0; so are all texts if no language was learned. Repeated rows give repeated rows, an empty table
    none; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    shared = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs, score = predict(shared.value, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    own = id_and_text(docs).withColumn("held_out", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)))
    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, first_word, last_word, lang): the spans of one language of each text, words counted from 0.

    Words are runs of letters (ASCII characters that are no letters separate them). A null or empty text has no span.
    """
    bound_batches(docs.sparkSession)
    shared = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = shared.value
            labels, weight, bounds = label_words(own, part.column("text"))
            rows = []
            for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                at, to = int(bounds[k]), int(bounds[k + 1])
                places = at + np.flatnonzero(weight[at:to])
                if not len(places):
                    continue
                cut = np.flatnonzero(np.diff(labels[places])) + 1
                for group in np.split(places, cut):
                    rows.append((doc_id, int(group[0]) - at, int(group[-1]) - at, own.languages[labels[group[0]]]))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "first_word", "last_word", "lang"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, first_word long, last_word long, lang string")


def kept(docs: DataFrame, model: LanguageModel, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, of which one language covers at least ``least`` of the letters.

    Null and empty texts, and those without letters, go; if no language was learned, all do. Null ids, repeated rows and
    further columns stay as they are; an empty table gives an empty one."""
    bound_batches(docs.sparkSession)
    shared = _shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs, score = predict(shared.value, part.column("text"))
            good = (score >= least) & np.array([x != UNKNOWN for x in langs], bool)
            yield part.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
