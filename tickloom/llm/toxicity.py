"""Toxicity by a convolutional text classifier in numpy.

Words are hashed twice, a word's embedding is the sum of its two buckets'. Filters of several widths slide over the
embeddings, each keeps its greatest response over the whole text, and a logistic unit reads these. Thresholds are
calibrated for each language, as it shows in the text's own function words, and scores are stretched so that every
threshold lies at 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import bound_batches, id_and_text, plain, ragged, slices, split_words
from ._sample import fitted, fold, stratified

#: Common function words by which the language of a text shows.
FUNCTION_WORDS = {
    "de": "der die das und den dem nicht mit von ist ein eine auf für auch sich".split(),
    "en": "the of and to in that was for on with his by from they this have".split(),
    "es": "el los las del que y en una por con para su no se al lo".split(),
    "fr": "le les des et dans une est pour que qui au sur pas par plus du".split(),
}
#: ASCII characters that are neither letters nor digits.
BETWEEN = r"[\x00-/:-@\[-`{-\x7f]+"

#: Rows of either hash's embedding table.
BUCKETS = 1 << 16


@dataclass
class ToxicityModel:
    widths: tuple[int, ...]
    emb: np.ndarray  # (2 * BUCKETS, dim): the two hashes' tables
    filters: list[np.ndarray]  # (width, dim, filters) for each width
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.5
    tables: list[list[np.ndarray]] = field(default_factory=list)

    def prepare(self) -> None:
        """Each filter's response to each bucket, so that a convolution is a sum of looked-up rows."""
        self.tables = [[self.emb @ f[j] for j in range(len(f))] for f in self.filters]


def _words(col: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    col = pc.replace_substring_regex(pc.utf8_lower(plain(pc.fill_null(col, ""))), BETWEEN, " ")
    words, index, bounds = split_words(col)
    # white space at either end leaves empty words
    full = np.fromiter(map(bool, words), bool, len(words))[index] if words else np.empty(0, bool)
    kept = np.concatenate([[0], np.cumsum(full)])
    return words, index[full], kept[bounds]


def _hashes(words: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """(words, 2): rows of the embedding table."""
    if not words:
        return np.empty((0, 2), np.int32)
    raw = [w.encode() for w in words]
    a = np.fromiter(map(zlib.crc32, raw), np.int64, len(raw))
    b = np.fromiter((zlib.crc32(w, 0x9E3779B9) for w in raw), np.int64, len(raw))
    return np.stack([a % buckets, buckets + (b >> 5) % buckets], axis=1).astype(np.int32)


def _encoded(texts: list[str], step: int = 250) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(buckets of each position, bounds of each text, languages that show), a few texts at a time."""
    pairs, lengths, langs = [np.empty((0, 2), np.int32)], [np.empty(0, np.int64)], []
    for at in range(0, len(texts), step):
        words, index, bounds = _words(pa.array(texts[at : at + step], pa.string()))
        pairs.append(_hashes(words)[index])
        lengths.append(np.diff(bounds))
        langs += _languages(words, index, bounds)
    return np.concatenate(pairs), np.concatenate([[0], np.cumsum(np.concatenate(lengths))]), langs


def _languages(words: list[str], index: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The language whose function words are most frequent in each text; empty if there are none."""
    names = sorted(FUNCTION_WORDS)
    mark = {}
    for k, name in enumerate(names):
        for w in FUNCTION_WORDS[name]:
            mark.setdefault(w, []).append(k)
    counts = np.zeros((len(bounds) - 1, len(names)))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for k in range(len(names)):
        is_mark = np.fromiter((k in mark.get(w, ()) for w in words), bool, len(words))
        if is_mark.any():
            counts[:, k] = np.bincount(row, weights=is_mark[index], minlength=len(counts))
    best = counts.argmax(axis=1)
    return [names[b] if c else "" for b, c in zip(best.tolist(), counts.max(axis=1).tolist(), strict=True)]


def _pooled(model: ToxicityModel, pairs: np.ndarray, bounds: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """(texts, all filters): each filter's greatest response, 0 at least. Positions are taken block by block."""
    n = len(bounds) - 1
    out = np.zeros((n, sum(f.shape[2] for f in model.filters)), np.float32)
    text = np.repeat(np.arange(n), np.diff(bounds))
    col = 0
    for tables, bias in zip(model.tables, model.bias, strict=True):
        width, size = len(tables), tables[0].shape[1]
        for at in range(0, len(pairs), block):
            to = min(len(pairs), at + block)
            own = text[at:to]
            total = np.tile(bias, (to - at, 1)).astype(np.float32)
            for j in range(width):
                end = min(len(pairs), to + j)
                fits = np.zeros(to - at, bool)
                fits[: end - at - j] = text[at + j : end] == own[: end - at - j]  # beyond the text's end there is nothing
                both = pairs[at + j : end]
                found = tables[j][both[:, 0]] + tables[j][both[:, 1]]
                total[: end - at - j] += found * fits[: end - at - j, None]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.maximum.reduceat(total, first, axis=0)
            who = own[first]
            out[who, col : col + size] = np.maximum(out[who, col : col + size], best)
        col += size
    return out


def probabilities(model: ToxicityModel, pairs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text, before calibration."""
    if not model.tables:
        model.prepare()
    pooled = _pooled(model, pairs, bounds) if len(pairs) else np.zeros((len(bounds) - 1, len(model.out)), np.float32)
    return 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.out_bias, -30, 30)))


def scores(model: ToxicityModel, col: pa.Array) -> np.ndarray:
    """Calibrated scores: at 0.5 a text's probability meets its language's threshold."""
    words, index, bounds = _words(col)
    langs = _languages(words, index, bounds)
    p = probabilities(model, _hashes(words)[index], bounds)
    t = np.array([model.thresholds.get(x, model.default) for x in langs]) if len(langs) else np.empty(0)
    return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t)).clip(0, 1)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where the share of true positives exceeds that of false ones, counted ten times, by most; in the middle of the gap."""
    order = np.argsort(-p)
    p, y = p[order], y[order]
    gain = np.cumsum(y) / max(1, y.sum()) - 10 * np.cumsum(1 - y) / max(1, (1 - y).sum())
    k = int(gain.argmax())
    low = _logit(p[k + 1]) if k + 1 < len(p) else _logit(p[k]) - 2
    return float(np.clip(1 / (1 + np.exp(-(_logit(p[k]) + low) / 2)), 0.1, 0.95))


def _logit(p: float) -> float:
    p = float(np.clip(p, 1e-9, 1 - 1e-9))
    return float(np.log(p / (1 - p)))


def calibrated(p: np.ndarray, y: np.ndarray, langs: list[str], weight: float = 30.0) -> tuple[float, dict[str, float]]:
    """(common threshold, threshold of each language): a language's own, drawn towards the common one as if that stood for
    ``weight`` toxic cases, so that few cases change little. A language without cases of either kind has the common one."""
    if len(set(y.tolist())) < 2:
        return 0.5, dict.fromkeys(FUNCTION_WORDS, 0.5)
    common = _threshold(p, y)
    found = {}
    for name in FUNCTION_WORDS:
        own = np.array([x == name for x in langs], bool)
        n = float(y[own].sum())
        part = n / (n + weight) if n and n < own.sum() else 0.0
        logit = (1 - part) * _logit(common) + (part * _logit(_threshold(p[own], y[own])) if part else 0.0)
        found[name] = float(1 / (1 + np.exp(-logit)))
    return common, found


def fit(texts: list[str], labels: list[int], folds: int = 3, **options) -> ToxicityModel:
    """Trains on all texts. The thresholds come from each text's probability under a model that never saw it: one of
    ``folds``, each trained without its own part of the texts. Too few texts of either label leave thresholds at 0.5."""
    pairs, bounds, langs = _encoded(texts)
    y = np.asarray(labels, np.float64)
    model = _fit(pairs, bounds, y, np.arange(len(y)), **options)
    # dealt within each label, so that every part has cases of either
    part = np.zeros(len(y), np.int64)
    for k in (0, 1):
        own = np.flatnonzero(y == k)
        part[own] = np.arange(len(own)) % folds
    if min((y == 0).sum(), (y == 1).sum()) >= 2 * folds:
        p = np.zeros(len(y))
        for k in range(folds):
            own = np.flatnonzero(part == k)
            lengths = np.diff(bounds)[own]
            other = _fit(pairs, bounds, y, np.flatnonzero(part != k), **options)
            p[own] = probabilities(other, pairs[ragged(bounds[:-1][own], lengths)], np.concatenate([[0], np.cumsum(lengths)]))
        model.default, model.thresholds = calibrated(p, y, langs)
    model.tables = []  # made anew by each worker
    return model


def _fit(
    pairs: np.ndarray, bounds: np.ndarray, y: np.ndarray, learn: np.ndarray, dim: int = 8, widths: tuple[int, ...] = (1, 2, 3), each: int = 8, epochs: int = 4, batch: int = 32, rate: float = 0.05, seed: int = 7
) -> ToxicityModel:
    """Trains by Adagrad on the whole texts that ``learn`` lists."""
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.02, (2 * BUCKETS, dim))
    # the first dimension starts from the smoothed log-odds of each bucket's documents
    seen = np.zeros((2, 2 * BUCKETS))
    for d in learn:
        own = np.unique(pairs[bounds[d] : bounds[d + 1]])
        seen[int(y[d]), own] += 1
    of = np.array([max(1, (y[learn] == k).sum()) for k in (0, 1)])
    odds = np.log(((seen[1] + 3) / (of[1] + 3)) / ((seen[0] + 3 * of[0] / of[1]) / (of[0] + 3 * of[0] / of[1])))
    emb[:, 0] = np.clip(odds, -2, 4) / 4
    filters = [rng.normal(0, 0.1, (w, dim, each)) for w in widths]
    for f in filters:
        f[0, 0, : each // 2] += 1.0
    bias = [np.zeros(each) for _ in widths]
    out, out_bias = rng.normal(0.5, 0.1, each * len(widths)), np.array([-1.0])
    params = [emb, *filters, *bias, out, out_bias]
    grads2 = [np.full_like(p, 1e-2) for p in params]

    def update(k: int, g: np.ndarray, at=slice(None)) -> None:
        grads2[k][at] += g * g
        params[k][at] -= rate * g / np.sqrt(grads2[k][at])

    total, toxic = len(learn), y[learn].sum()
    weight = np.where(y == 1, total / max(1, 2 * toxic), total / max(1, 2 * (total - toxic)))
    for _ in range(epochs):
        order = rng.permutation(learn)
        for start in range(0, len(order), batch):
            docs = order[start : start + batch]
            docs = docs[np.diff(bounds)[docs] > 0]
            if not len(docs):
                continue
            ids = pairs[ragged(bounds[:-1][docs], np.diff(bounds)[docs])]
            text = np.repeat(np.arange(len(docs)), np.diff(bounds)[docs])
            found = gradients(params, len(widths), emb[ids[:, 0]] + emb[ids[:, 1]], text, y[docs], weight[docs] / len(docs))
            for k, g in enumerate(found[1:], 1):
                update(k, g)
            where, delta = found[0]
            for h in (0, 1):
                own, inverse = np.unique(ids[where, h], return_inverse=True)
                g_emb = np.zeros((len(own), dim))
                np.add.at(g_emb, inverse, delta)
                update(0, g_emb, own)
    return ToxicityModel(widths, emb.astype(np.float32), [f.astype(np.float32) for f in filters], [b.astype(np.float32) for b in bias], out.astype(np.float32), float(out_bias[0]))


def gradients(params: list[np.ndarray], n: int, x: np.ndarray, text: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4) -> list:
    """Of the weighted log loss, for ``params``: embeddings, ``n`` filters, their biases, output weights and bias.

    x: the embedding of each position; text: which text it belongs to, none of them empty. The first gradient is
    (positions, their gradients), positions repeated. ``decay`` times a parameter is added for filters and output weights."""
    filters, bias, out, out_bias = params[1 : 1 + n], params[1 + n : 1 + 2 * n], params[-2], params[-1]
    first = np.flatnonzero(np.diff(text, prepend=-1))
    last = np.append(first[1:], len(x))
    each = filters[0].shape[2]
    pooled, places = [], []
    for f, b in zip(filters, bias, strict=True):
        z = np.tile(b, (len(x), 1))
        for j in range(min(len(f), len(x))):
            fits = (text[j:] == text[: len(text) - j])[:, None]
            z[: len(z) - j] += (x[j:] @ f[j]) * fits
        best = np.array([z[a:e].argmax(axis=0) + a for a, e in zip(first, last, strict=True)])
        places.append(best)
        pooled.append(z[best, np.arange(each)])
    act = np.maximum(np.concatenate(pooled, axis=1), 0)
    p = 1 / (1 + np.exp(-np.clip(act @ out + out_bias[0], -30, 30)))
    dz = (p - y) * weight
    d_act = dz[:, None] * out * (act > 0)
    touched, parts, g_filters, g_bias = [], [], [], []
    for k, (f, best) in enumerate(zip(filters, places, strict=True)):
        g = d_act[:, k * each : (k + 1) * each]
        gf = np.zeros_like(f)
        for j in range(len(f)):
            at = np.minimum(best + j, len(x) - 1)
            ok = g * ((best + j < len(x)) & (text[at] == np.arange(len(y))[:, None]))
            for c in range(each):
                gf[j, :, c] = x[at[:, c]].T @ ok[:, c]
            parts.append((ok[:, :, None] * f[j].T[None]).reshape(-1, f.shape[1]))
            touched.append(at.reshape(-1))
        g_filters.append(gf + decay * f)
        g_bias.append(g.sum(axis=0))
    return [(np.concatenate(touched), np.concatenate(parts)), *g_filters, *g_bias, act.T @ dz + decay * out, np.array([dz.sum()])]


def train(docs: DataFrame, labels: DataFrame, toxic: int = 1200, clean: int = 4000) -> ToxicityModel:
    """Fits on about ``toxic`` and ``clean`` labelled documents of the two classes, whole texts, in the learning fold only.

    Of several labels for one document the toxic one counts; null labels count for nothing.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold("doc_id", 5) != 0)
    # as many rows as asked for, whatever the corpus: small enough to broadcast
    chosen = F.broadcast(stratified(known, "toxic", "doc_id", {1: toxic, 0: clean}))
    bound_batches(docs.sparkSession)

    def learned(rows: pa.Table) -> ToxicityModel:
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        return fit(rows.column("text").to_pylist(), rows.column("toxic").to_pylist())

    return fitted(id_and_text(docs).join(chosen, "doc_id").select("doc_id", "text", "toxic"), learned)


def classify(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; only the text is an input of a score.

    held_out: crc32 of the id as text, modulo 5, is 0 (false for a null id). A null or empty text gets the score of a
    text in which no filter responds. Repeated rows give repeated rows, an empty table none; other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: buckets times dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = scores(shared.value, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    own = id_and_text(docs).withColumn("held_out", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows, with all their columns, that aren't predicted to be toxic.

    A null or empty text is scored like one in which no filter responds. Null ids, repeated rows and further columns stay as
    they are; an empty table gives an empty one."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(scores(shared.value, part.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)
