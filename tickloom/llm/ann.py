"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample of the vectors, every vector is indexed in each. A query walks all trees
through one priority queue, ordered by the least margin on the way to a node, until the leaves it reached promise
enough candidates. Neighbouring leaves form groups of a fixed number; groups and queries meet by an equality join on
(group, part), where large groups are dealt to several parts. There the candidates of the leaves that a query reached
are ranked by exact distances, and a query's lists are merged: as many rows as it met groups, whatever their size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import bound_batches
from ._sample import fitted

#: Vectors that one part of a group of leaves holds, about; groups of leaves for each tree; queries that one task asks.
PART, GROUPS, ASKED = 32_768, 16, 256
#: Lengths of vectors that one table may hold.
LENGTHS = 64


@dataclass
class Forest:
    """normals, offsets, children: of all inner nodes, each tree's after one another; a child below 0 is leaf ``-1 - child``.
    roots: each tree's first node. counts: sampled vectors of each leaf; leaves are numbered over all trees."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    counts: np.ndarray


def fit(sample: np.ndarray, trees: int, leaf: int, seed: int = 11) -> Forest:
    """Splits at the median along the difference of two random points, until at most ``leaf`` vectors are left.

    Vectors that no plane parts (copies of one) stay together, in a leaf of any size."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, roots, counts = [], [], [], [], []

    def new_leaf(n: int) -> int:
        counts.append(n)
        return -len(counts)

    def split(own: np.ndarray):
        for _ in range(5):
            a, b = sample[rng.choice(own, 2, replace=False)]
            normal = a - b
            norm = np.sqrt(normal @ normal)
            if norm == 0:
                continue
            side = sample[own] @ (normal / norm)
            cut = float(np.median(side))
            right = side > cut
            if 0 < right.sum() < len(own):
                return normal / norm, cut, right
        return None

    for _ in range(trees):
        todo = [(np.arange(len(sample)), None, 0)]
        while todo:
            own, parent, which = todo.pop()
            found = split(own) if len(own) > leaf else None
            if found is None:
                node = new_leaf(len(own))
            else:
                normal, cut, right = found
                node = len(normals)
                normals.append(normal)
                offsets.append(cut)
                children.append([0, 0])
                todo += [(own[~right], node, 0), (own[right], node, 1)]
            if parent is None:
                roots.append(node)
            else:
                children[parent][which] = node
    dim = sample.shape[1] if sample.ndim == 2 else 0
    return Forest(np.array(normals).reshape(len(normals), dim), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(roots, np.int64), np.array(counts, np.int64))


def leaves_of(forest: Forest, x: np.ndarray) -> np.ndarray:
    """(vectors, trees): the leaf of each vector in each tree."""
    out = np.empty((len(x), len(forest.roots)), np.int64)
    for t, root in enumerate(forest.roots.tolist()):
        node = np.full(len(x), root, np.int64)
        while True:
            at = np.flatnonzero(node >= 0)
            if not len(at):
                break
            own = node[at]
            right = np.einsum("ij,ij->i", x[at], forest.normals[own]) > forest.offsets[own]
            node[at] = forest.children[own, right.astype(np.int64)]
        out[:, t] = -1 - node
    return out


def probes(forest: Forest, q: np.ndarray, enough: float) -> list[int]:
    """Leaves of all trees in order of their margins, until they hold ``enough`` of the sampled vectors."""
    side = forest.normals @ q - forest.offsets if len(forest.normals) else np.empty(0)
    queue = [(-np.inf, r) for r in forest.roots.tolist()]
    heapq.heapify(queue)
    found, out = 0, []
    children, counts = forest.children, forest.counts
    while queue and found < enough:
        margin, node = heapq.heappop(queue)
        if node < 0:
            out.append(-1 - node)
            found += int(counts[-1 - node])
            continue
        s = side[node]
        near, far = children[node, 1 if s > 0 else 0], children[node, 0 if s > 0 else 1]
        heapq.heappush(queue, (margin, int(near)))
        heapq.heappush(queue, (max(margin, abs(s)), int(far)))
    return out


def calibrated_share(forest: Forest, sample: np.ndarray, k: int, target: float, asked: int = 200, seed: int = 5) -> float:
    """The smallest of the shares tried at which sampled queries find ``target`` of their k nearest in the sample.

    A share is what the leaves visited hold, over all trees, in terms of the number of vectors; at twice the number of
    trees every leaf is visited."""
    trees = len(forest.roots)
    if len(sample) <= k:
        return 2.0 * trees
    who = np.random.default_rng(seed).permutation(len(sample))[:asked]
    leaves = leaves_of(forest, sample)
    best = []
    for q in who:
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        best.append(np.argpartition(d, k - 1)[:k])
    share = 0.02
    while share < trees:
        found = 0.0
        for q, near in zip(who, best, strict=True):
            visited = np.zeros(len(forest.counts), bool)
            visited[probes(forest, sample[q], share * len(sample))] = True
            found += visited[leaves[near]].any(axis=1).mean()
        if found >= target * len(who):
            return share
        share *= 1.3
    return 2.0 * trees


def nearest(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, leaves: np.ndarray | None = None, reached: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance) of the k nearest of ``x`` to each query, its own id apart; ties go to smaller ids.

    leaves: that of each of ``x``; reached: the leaves whose vectors count for each query."""
    if leaves is not None:
        known, at_leaf = np.unique(leaves, return_inverse=True)
    by_id = np.argsort(ids, kind="stable")
    starts = np.flatnonzero(np.diff(ids[by_id], prepend=ids[by_id][:1] - 1))
    out: list[tuple] = []
    # a cheap form of the distances, from a common centre, finds who may be among the k nearest; the exact form ranks those
    centre = x.mean(axis=0) if len(x) else 0.0
    near = x - centre
    squares = (near * near).sum(axis=1)
    error = 8 * (x.shape[1] + 4) * np.finfo(np.float64).eps
    for at in range(0, len(queries), 64):
        q = queries[at : at + 64]
        own_near = q - centre
        own_squares = (own_near * own_near).sum(axis=1)
        rough = own_squares[:, None] + squares[None] - 2 * (own_near @ near.T)
        own = query_ids[at : at + 64, None] == ids[None]
        rough[own] = np.inf
        if leaves is not None:
            for j in range(len(q)):
                rough[j, ~np.isin(known, reached[at + j])[at_leaf]] = np.inf
        for j in range(len(q)):
            row = rough[j]
            if len(starts) > k:
                # of each id its nearest row
                least = row if len(starts) == len(row) else np.minimum.reduceat(row[by_id], starts)
                bound = np.partition(least, k - 1)[k - 1]
                # what rounding may add grows with the terms, not with their difference
                who = np.flatnonzero(row <= bound + error * (own_squares[j] + squares)) if np.isfinite(bound) else np.flatnonzero(np.isfinite(row))
            else:
                who = np.flatnonzero(np.isfinite(row))
            d = np.sqrt(((x[who] - q[j]) ** 2).sum(axis=1))
            # repeated rows of one id count once
            order = np.lexsort((ids[who], d))
            _, first = np.unique(ids[who][order], return_index=True)
            order = order[np.sort(first)][:k]
            out.append((np.full(len(order), query_ids[at + j]), ids[who][order], d[order]))
    return tuple(np.concatenate([o[c] for o in out]) if out else np.empty(0) for c in range(3))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten() if isinstance(col, pa.Array) else col.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(col), -1).astype(np.float64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>): without vectors that are null, zero, empty or hold null or non-finite components, and
    without null ids."""
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return own.filter("vec_id is not null and v is not null and size(v) > 0").filter(good).filter(F.exists("v", lambda x: x != 0))


def search(vectors: DataFrame, every: int = 100, k: int = 10, trees: int = 8, leaf: int = 128, target: float = 0.96, sample: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, the row's whose vec_id is divisible by ``every``.

    trees, leaf: size of the forest, in vectors of the whole table. sample: vectors that the trees are fitted on, at
    most about so many. target: recall that sampled queries must reach in the sample; it sets how much of the forest a
    query visits, so clustered vectors need few leaves and evenly spread ones many.

    Vectors that are null, zero or not finite take no part, nor do null ids. Vectors of different lengths have no
    distance: each length has a forest of its own, and a table of over ``LENGTHS`` lengths is refused. Repeated rows of
    one id count once; of different vectors of one id the least is the query, and the nearest counts as candidate. Ties go
    to the smaller id. Fewer candidates than ``k`` are all returned. An empty table gives no rows.
    """
    bound_batches(vectors.sparkSession)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    own = usable(vectors)
    asks = F.pmod("vec_id", F.lit(every)) == 0
    sizes = own.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count(F.when(asks, 1)).alias("queries")).orderBy("dim").limit(LENGTHS + 1).collect()
    if len(sizes) > LENGTHS:
        raise ValueError(f"vectors of over {LENGTHS} lengths")
    out = own.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    for r in sizes:
        found = _search(own.filter(F.size("v") == r["dim"]), asks, r["n"], r["queries"], single, k, trees, leaf, target, sample)
        out = found if len(sizes) == 1 else out.unionByName(found)
    return out


def _search(own: DataFrame, asks: Column, n: int, queries: int, single: bool, k: int, trees: int, leaf: int, target: float, sample: int) -> DataFrame:
    """``search`` among ``n`` vectors of one length."""
    spark = own.sparkSession
    part = min(1.0, sample / max(1, n))
    chosen = own.filter(F.pmod(F.xxhash64("vec_id", F.lit("forest")), F.lit(1 << 30)) < part * (1 << 30)).dropDuplicates()

    def grown(rows: pa.Table) -> tuple[Forest, float, int]:
        fitted_on = _matrix(rows.column("v")) if rows.num_rows else np.empty((0, 0))
        fitted_on = fitted_on[np.lexsort(fitted_on.T)] if len(fitted_on) else fitted_on  # the same trees, however rows arrive
        planes = fit(fitted_on, trees, max(8, round(leaf * part)))
        return planes, calibrated_share(planes, fitted_on, k, target) * len(fitted_on), len(fitted_on)

    planes, enough, fitted_rows = fitted(chosen, grown)
    forest = spark.sparkContext.broadcast(planes)  # bounded by the sample

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = leaves_of(forest.value, _matrix(batch.column("v")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(found.tolist(), pa.list_(pa.int64()))], names=["vec_id", "v", "leaves"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [probes(forest.value, q, enough) for q in _matrix(batch.column("v"))]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(found, pa.list_(pa.int64()))], names=["vec_id", "v", "leaves"])

    kind = "vec_id long, v array<double>, leaves array<long>"
    # single precision is how they came: half the bytes to shuffle, and nothing is lost
    rows = own.mapInArrow(index, kind).select("vec_id", F.col("v").cast("array<float>" if single else "array<double>").alias("v"), F.explode("leaves").alias("leaf"))
    asking = own.filter(asks).repartition(max(1, -(-queries // ASKED)), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = asking.mapInArrow(ask, kind).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.explode("leaves").alias("leaf"))
    # groups of neighbouring leaves; the sample tells into how many parts each is dealt
    n_leaves, n_groups = len(planes.counts), trees * GROUPS
    of = lambda c: F.floor(c * n_groups / n_leaves)
    rows = rows.withColumn("group", of(F.col("leaf")))
    asked = asked.groupBy("query_id", of(F.col("leaf")).alias("group")).agg(F.first("q").alias("q"), F.collect_set("leaf").alias("reached"))
    held = np.bincount(np.arange(n_leaves) * n_groups // max(1, n_leaves), weights=planes.counts) * (n / max(1, fitted_rows))
    parts = {g: -(-int(held[g]) // PART) for g in np.flatnonzero(held > PART).tolist()}
    if parts:
        dealt = F.broadcast(spark.createDataFrame(list(parts.items()), "group long, parts long"))
        some = F.coalesce("parts", F.lit(1).cast("long"))
        rows = rows.join(dealt, "group", "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), some)).drop("parts")
        asked = asked.join(dealt, "group", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), some - 1))).drop("parts")
    else:
        rows, asked = (x.withColumn("part", F.lit(0).cast("long")) for x in (rows, asked))

    def rank(q: pa.Table, x: pa.Table) -> pa.Table:
        found = ([], [], [])
        if q.num_rows and x.num_rows:
            found = nearest(_matrix(q.column("q")), q.column("query_id").to_numpy(), _matrix(x.column("v")), x.column("vec_id").to_numpy(), k, x.column("leaf").to_numpy(), q.column("reached").to_pylist())
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    found = asked.groupBy("group", "part").cogroup(rows.groupBy("group", "part")).applyInArrow(rank, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
