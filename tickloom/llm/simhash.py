"""SimHash near-duplicates: 64-bit fingerprints linked at two or fewer differing bits.

A fingerprint is cut into two segments of 32 bits. Of two fingerprints that differ in two bits or fewer, one segment
differs in at most one; so the two share a variant of that segment in which one bit is deleted (a wildcard). All 32
variants of either segment are indexed, and equal variants are joined and verified.

Documents of one fingerprint are one class from the start. Index buckets of up to ``small`` fingerprints are compared
by numpy, which emits a spanning forest of the links instead of all pairs. Larger buckets are never gathered: their
fingerprints are expanded into all variants with two of the 64 bits deleted, where equality alone is a link and a
group holds four fingerprints at most; each is tied to the least of its group by a plain aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrow import bound_batches, id_and_text, ragged, slices
from ._shared import drop, looked_up, release, uses, written
from .components import connected_components, contracted

#: Fingerprints of a bucket up to which all its pairs are compared in one place.
SMALL = 512
SEED = 42


def fingerprint(text: str, words: int = 3, seed: int = SEED) -> int:
    """The fingerprint of a whole text, as an unsigned integer; 0 without words."""
    return int(wide_fingerprint(text, words, 1, seed)[0])


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes for the k-th 64 bits of a wide fingerprint; the first are the hashes themselves."""
    if not k:
        return h
    h = (h ^ np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(text: str, words: int, seed: int) -> Iterator[np.ndarray]:
    """The hashes of all word shingles of a whole text in order, some at a time; of fewer words, that of the whole sequence."""
    import xxhash

    # bytes.lower() folds A-Z alone; bytes.split() parts at space and U+0009 to U+000D
    own = text.encode().lower().split()
    if not own:
        return
    joined = b" ".join(own)
    lengths = np.fromiter(map(len, own), np.int64, len(own))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(own) - words + 1)
    starts, ends = (starts[:n], ends[words - 1 :]) if len(own) >= words else (starts[:1], ends[-1:])
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 16):  # bounded memory, whatever the length
        pairs = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        yield np.array([digest(joined[s:e], seed) for s, e in pairs], "<u8")


def _majority(hashes: Iterator[np.ndarray], parts: int) -> np.ndarray:
    """``parts`` times 64 bits: those that over half of the hashes have; zeros without hashes."""
    counts, n = np.zeros((parts, 64), np.int64), 0
    for h in hashes:
        n += len(h)
        for k in range(parts):
            counts[k] += _bit_counts(_mixed(h, k))
    return np.packbits(counts * 2 > n, axis=1, bitorder="little").view("<u8")[:, 0]


def wide_fingerprint(text: str, words: int, parts: int, seed: int = SEED) -> np.ndarray:
    """``parts`` times 64 bits of a whole text, repeated shingles as often as they occur; zeros without words."""
    return _majority(_hashes(text, words, seed), parts)


def set_fingerprint(shingles: np.ndarray, parts: int) -> np.ndarray:
    """``parts`` times 64 bits of a set of shingles, each counted once, as the similarity does that is verified."""
    h = shingles.view("<u8")
    return _majority((h[at : at + (1 << 16)] for at in range(0, len(h), 1 << 16)), parts)


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, the lowest first."""
    # eight bits at a time: each byte's bits are spread over the bytes of a word, which are summed before they overflow
    spread = _SPREAD[h.view(np.uint8).reshape(-1, 8)]
    out = np.zeros((8, 8), np.int64)
    for k in range(0, len(spread), 255):
        out += spread[k : k + 255].sum(axis=0, dtype=np.uint64).view(np.uint8).reshape(8, 8)
    return out.reshape(64)


#: Byte value to a word whose byte j is bit j of the value.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").reshape(256)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of each row: the bits of the unsigned fingerprint as a signed long; null texts count as empty."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = np.array([fingerprint(t, words) for t in part.column("text").to_pylist()], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def _segment(which: int):
    return F.shiftrightunsigned("fp", 32) if which else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard variants. A key holds the segment, the place of the wildcard and the other bits."""
    place = F.col("w") % 32
    value = F.when(F.col("w") >= 32, _segment(1)).otherwise(_segment(0))
    cleared = F.expr("value & ~shiftleft(1L, cast(w % 32 as int))")
    return (
        fps.select("fp", F.explode(F.expr("sequence(0L, 63L)")).alias("w"))
        .select("fp", "w", value.alias("value"))
        .select((F.shiftleft(F.col("w"), 32)).bitwiseOR(cleared).alias("key"), "fp")
    )


def _hot_keys(fps: DataFrame, small: int) -> DataFrame:
    """Keys whose buckets may hold over ``small`` fingerprints: such a bucket is made of two segment values, of which
    one alone has over half as many. Counts are taken before the rows are multiplied, and combined before the shuffle."""
    halves = fps.select(F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("s"), _segment(s).alias("value")) for s in (0, 1)])).alias("h")).select("h.*")
    heavy = halves.groupBy("s", "value").count().filter(F.col("count") > small // 2)
    return (
        heavy.select("value", F.explode(F.expr("sequence(s * 32, s * 32 + 31)")).alias("w"))
        .select(F.shiftleft(F.col("w"), 32).bitwiseOR(F.expr("value & ~shiftleft(1L, cast(w % 32 as int))")).alias("key"))
        .distinct()
    )


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a bucket."""
    n = len(fps)
    left, out = np.arange(n), []
    group = np.arange(n)
    for k in range(n - 1):
        rest = left[k + 1 :]
        for m in rest[np.bitwise_count(fps[rest] ^ fps[k]) <= distance].tolist():
            a, b = group[k], group[m]
            if a != b:
                group[group == b] = a
                out.append((k, m))
    return out


def _cold_links(variants: DataFrame, distance: int) -> DataFrame:
    """(a, b) of buckets that are small by construction: rows come sorted by key, a run of one key is a bucket."""

    def links(keys: np.ndarray, fps: np.ndarray) -> list[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        x, y = fps[two], fps[two + 1]
        near = np.bitwise_count(x ^ y) <= distance
        found = [(x[near], y[near])]
        for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = fps[at : at + n]
            if pairs := _forest(own, distance):
                p = np.array(pairs)
                found.append((own[p[:, 0]], own[p[:, 1]]))
        a, b = (np.concatenate([f[k] for f in found]).view("<i8") for k in (0, 1))
        return [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])] if len(a) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, "<u8")
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view("<u8")])
            if len(keys) and keys[0] != keys[-1] and len(keys) >= 1 << 16:
                to = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
                yield from links(keys[:to], fps[:to])
                keys, fps = keys[to:], fps[to:]
        if len(keys):
            yield from links(keys, fps)

    return variants.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def _hot_links(fps: DataFrame) -> DataFrame:
    """(a, b) by variants with two of 64 bits deleted: all of a group are within two bits, so the least stands for it."""
    bit = lambda c: f"shiftleft(1L, cast({c} as int))"
    two = (
        fps.select("fp", F.explode(F.expr("sequence(0, 62)")).alias("i"))
        .select("fp", "i", F.explode(F.expr("sequence(i + 1, 63)")).alias("j"))
        .select("fp", (F.col("i") * 64 + F.col("j")).cast("short").alias("p"), F.expr(f"fp & ~({bit('i')} | {bit('j')})").alias("rest"))
    )
    tied = two.groupBy("p", "rest").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_set("fp").alias("all")).filter("a <> z")
    return tied.select("a", F.explode("all").alias("b")).filter("a <> b").distinct()


def links(fps: DataFrame, distance: int = 2, small: int = SMALL) -> DataFrame:
    """(a, b) of distinct fingerprints: links that join all fingerprints within ``distance`` bits transitively."""
    if distance not in (0, 1, 2):
        raise ValueError("two segments with one wildcard cover distances up to 2")
    hot = written(_hot_keys(fps, small), "hot-keys")
    variants = _variants(fps)
    if hot.isEmpty():
        return uses(_cold_links(variants, distance), hot)
    cold = _cold_links(variants.join(hot, "key", "left_anti"), distance)
    members = written(variants.join(hot, "key", "left_semi").select("fp").distinct(), "hot-fingerprints")
    found = _hot_links(members)
    if distance < 2:
        found = found.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return uses(cold.unionAll(found), hot, members)


def classes(docs: DataFrame, words: int = 3, distance: int = 2, small: int = SMALL) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row.

    fingerprint: 16 lower-case hexadecimal digits. component_id: the least doc_id that is reachable through links,
    the row's own included. A null or empty text has fingerprint zero, and is linked like any other. Rows of a null
    doc_id take part in links, their own id counts for no component; if a component has no other, its id is null.
    Repeated rows give repeated rows. An empty table gives none.
    """
    own = written(fingerprints(docs, words), "fingerprints")
    by_fp = written(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")), "classes")
    reached = connected_components(links(by_fp.select("fp"), distance, small))
    # the least doc_id of each component, then back to the fingerprints that are in one
    member = by_fp.join(reached.withColumnRenamed("node", "fp"), "fp")
    least = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = member.select("fp", "component").join(least, "component").select("fp", "component_id")
    ids = by_fp.join(linked.withColumnRenamed("component_id", "linked_id"), "fp", "left").select("fp", "n", F.coalesce("linked_id", "first_id").alias("component_id"))
    ids = written(ids, "components-of-classes")
    release(reached)
    drop(by_fp)
    return looked_up(own, ids, ["fp"], "n").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicates of a given similarity: wide fingerprints, samples of their bits as keys, exact verification.

#: Bits of a key, keys of each fingerprint, 64-bit parts of a wide fingerprint, and how many of these go with each key to
#: be compared.
SAMPLED, KEYS, PARTS, COMPARED = 21, 300, 6, 3
WIDE = [f"f{k}" for k in range(PARTS)]
#: Columns of the digest of a set of shingles.
DIGEST = ["s0", "s1"]
#: Slots of the filter of candidates' ids: its size is fixed, once it is full it lets all rows pass.
SLOTS = 1 << 20
#: Documents and shingles that a block of candidates holds, about.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 19


def distance_of(similarity: float, bits: int = 64 * COMPARED, deviations: float = 3.0) -> int:
    """Differing bits that pairs of a Jaccard similarity rarely exceed: by more than ``deviations``.

    Sets of one size have the cosine 2J / (1 + J); each bit differs by the angle's share of a half turn."""
    p = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity)))) / np.pi
    return round(bits * p + deviations * (bits * p * (1 - p)) ** 0.5)


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, s0, s1, and the parts f0, f1 ..) of each row, all of its set of shingles. s0, s1: a digest of the set of shingles, null without words;
    null texts count as empty."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [(set_digest(x), set_fingerprint(x, PARTS)) for t in part.column("text").to_pylist() for x in (shingle_set(t, words),)]
            fps = np.array([f for _, f in found], "<u8").reshape(-1, PARTS).view("<i8")
            own = [pa.array([d[k] for d, _ in found], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *own, *[pa.array(np.ascontiguousarray(fps[:, k])) for k in range(PARTS)]], names=["doc_id", *DIGEST, *WIDE])

    return id_and_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in (*DIGEST, *WIDE)))


def _sampled_keys(fps: np.ndarray) -> np.ndarray:
    """(fingerprints, KEYS): each key is its own number and the values of ``SAMPLED`` bits, drawn once for all fingerprints."""
    rng = np.random.default_rng(SEED)
    weights = np.zeros((fps.shape[1] * 64, KEYS), np.float32)  # sums stay below 2 ** 24: exact
    for k in range(KEYS):
        weights[rng.choice(len(weights), SAMPLED, replace=False), k] = 2.0 ** np.arange(SAMPLED)
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
    return (bits @ weights).astype(np.int64) + (np.arange(KEYS, dtype=np.int64) << SAMPLED)


def wide_links(fps: DataFrame, limit: int, small: int = 8 * SMALL) -> DataFrame:
    """(a, b) of ids that differ in at most ``limit`` of the compared bits, transitively. fps: id, and the parts of a fingerprint.

    A pair is found if the bits of any key are equal in both; the fewer bits differ, the surer that is. Buckets that may
    hold over ``small``, by a sample of the ids, are dealt to blocks, and each two blocks of a bucket meet in a task: all
    pairs are compared, none is gathered or emitted beyond a spanning forest.
    """
    parts = [c for c in fps.columns if c != "id"]
    compared = parts[:COMPARED]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _sampled_keys(np.stack([batch.column(c).to_numpy() for c in parts], axis=1).view("<u8"))
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * KEYS, pa.int32()), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), *[batch.column(c) for c in compared], held], names=["id", *compared, "keys"])

    def keyed(some: DataFrame) -> DataFrame:
        held = some.mapInArrow(index, "id long, " + ", ".join(f"{c} long" for c in compared) + ", keys array<long>")
        return held.select(F.explode("keys").alias("key"), "id", *compared)

    every = max(1, small // 32)
    heavy = keyed(fps.filter(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(every)) == 0)).groupBy("key").count().filter(F.col("count") > small // (2 * every))
    hot = written(heavy.select("key", F.ceil(F.col("count") * every / max(1, small // 2) + 1).alias("blocks")), "hot-keys")
    rows = keyed(fps)
    if not hot.isEmpty():
        mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
        rows = rows.join(hot, "key", "left").withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
        pair = F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least(mine, "other"), F.greatest(mine, "other")))
        rows = rows.select(pair.alias("key"), "id", *compared)

    def links(keys: np.ndarray, ids: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        size = np.diff(edge)
        two = edge[:-1][size == 2]
        near = np.bitwise_count(fps[two] ^ fps[two + 1]).sum(axis=1) <= limit
        a, b = [ids[two][near]], [ids[two + 1][near]]
        for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            for k, m in _wide_forest(fps[at : at + n], limit):
                a.append(ids[at + k : at + k + 1])
                b.append(ids[at + m : at + m + 1])
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, COMPARED), "<u8")]
        for batch in batches:
            new = [batch.column("key").to_numpy(), batch.column("id").to_numpy(), np.stack([batch.column(c).to_numpy() for c in compared], axis=1).view("<u8")]
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            keys = held[0]
            if len(keys) >= 1 << 16 and keys[0] != keys[-1]:
                to = int(np.searchsorted(keys, keys[-1]))  # the last run may go on
                yield from links(*[x[:to] for x in held])
                held = [x[to:] for x in held]
        if len(held[0]):
            yield from links(*held)

    # in order of ids, so that forests of different buckets share their edges
    return uses(rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a long, b long").distinct(), hot)


def _wide_forest(fps: np.ndarray, limit: int) -> list[tuple[int, int]]:
    n, out = len(fps), []
    group = np.arange(n)
    for k in range(n - 1):
        if not len(rest := k + 1 + np.flatnonzero(group[k + 1 :] != group[k])):
            continue
        for m in rest[np.bitwise_count(fps[rest] ^ fps[k]).sum(axis=1) <= limit].tolist():
            a, b = group[k], group[m]
            if a != b:
                group[group == b] = a
                out.append((k, m))
    return out


def shingle_set(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """The sorted hashes of the distinct word shingles of a whole text; of fewer words, that of the whole sequence."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *_hashes(text, words, seed)])).view(np.int64)


def set_digest(shingles: np.ndarray) -> tuple[int, int] | tuple[None, None]:
    """128 bits that stand for a whole set of shingles; nulls for an empty one."""
    import xxhash

    if not len(shingles):
        return None, None
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), "<i8").tolist())


def _id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """Marks of the slots that ids fall in; at most ``SLOTS`` numbers reach the driver, whatever the number of ids."""
    taken = ids.select(F.pmod(F.xxhash64(column), F.lit(SLOTS)).cast("int").alias("slot")).distinct().toArrow()
    marks = np.zeros(SLOTS, bool)
    marks[taken.column("slot").to_numpy()] = True
    return marks


def exact_links(docs: DataFrame, candidates: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links that join, transitively, all candidates of one component whose shingle sets reach ``similarity``.

    candidates: (node, component). Only their texts are shuffled, as sets of hashes. A component is dealt to blocks of
    bounded size and each two blocks of it meet in a task, which compares all their pairs and emits a spanning forest.
    Rows that share an id are one document, linked through any of its texts.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(np.packbits(_id_filter(candidates, "node")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.unpackbits(shared.value).view(bool)
        for batch in batches:
            for part in slices([batch.filter(pa.array(marks[batch.column("slot").to_numpy()]))]):
                found = [shingle_set(t, words) for t in part.column("text").to_pylist()]
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.concatenate([np.empty(0, np.int64), *found])
                held = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lengths), held], names=["node", "n", "shingles"])

    texts = id_and_text(docs.filter("doc_id is not null")).withColumn("slot", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int"))
    own = written(texts.mapInArrow(sets, "node long, n long, shingles array<long>").filter("n > 0").join(candidates, "node"), "candidate-shingles")
    of = own.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("all")).select("component", F.expr(f"cast(ceil(greatest(docs / {BLOCK_DOCS}, all / {BLOCK_SHINGLES})) as long)").alias("blocks"))
    mine = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks"))
    rows = own.join(of, "component").withColumn("mine", mine).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.select("component", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "node", "shingles")

    def meet(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        lists = group.column("shingles").combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        pairs = np.array(_jaccard_forest(lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()), similarity), np.int64).reshape(-1, 2)
        return pa.table([pa.array(nodes[pairs[:, 0]]), pa.array(nodes[pairs[:, 1]])], names=["a", "b"])

    # dealt by all three: else a join may leave a whole component in one task
    return uses(rows.repartition("component", "low", "high").groupBy("component", "low", "high").applyInArrow(meet, "a long, b long").distinct(), own)


def _jaccard_forest(flat: np.ndarray, sizes: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that reach ``similarity``; ``flat`` holds all sets, one after another."""
    order = np.argsort(sizes, kind="stable")
    flat, lengths = flat[ragged(np.cumsum(sizes)[order] - sizes[order], sizes[order])], sizes[order]
    known, code = np.unique(flat, return_inverse=True)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    marked = np.zeros(len(known), np.int64)
    group, out = np.arange(len(lengths)), []
    for k in range(len(lengths) - 1):
        # sets of similar sizes alone can be similar, and these follow in order
        to = int(np.searchsorted(lengths, lengths[k] / similarity + 1e-9, side="right")) if similarity > 0 else len(lengths)
        if to <= k + 1:
            continue
        own = code[starts[k] : ends[k]]
        marked[own] = 1
        common = np.add.reduceat(marked[code[starts[k + 1] : ends[to - 1]]], starts[k + 1 : to] - starts[k + 1])
        marked[own] = 0
        near = common >= similarity * (lengths[k] + lengths[k + 1 : to] - common) - 1e-9
        for m in (k + 1 + np.flatnonzero(near)).tolist():
            a, b = group[k], group[m]
            if a != b:
                group[group == b] = a
                out.append((int(order[k]), int(order[m])))
    return out


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group_id) of each row: the least doc_id of its group of near-duplicates.

    Documents of equal shingle sets are one from the start. Of all others, candidates are found by samples of the
    bits of wide fingerprints, and those are joined whose sets of word shingles reach ``similarity`` exactly.
    Rows without an id and texts without words are left alone, each a group of its own.
    """
    own = written(signatures(docs, words), "signatures")
    full = own.filter("doc_id is not null and s0 is not null").select("doc_id", *DIGEST, *WIDE)
    lead = F.min(F.struct("doc_id", *WIDE)).alias("lead")
    sets = full.groupBy(*DIGEST).agg(lead, F.count("*").alias("n")).select(*DIGEST, "n", F.col("lead.doc_id").alias("id"), *[F.col(f"lead.{c}").alias(c) for c in WIDE])
    sets = written(sets, "distinct-sets")
    near = connected_components(contracted(wide_links(sets.select("id", *WIDE), distance_of(similarity))))
    candidates = written(near, "candidates")
    release(near)
    far = connected_components(contracted(exact_links(docs, candidates, words, similarity)))
    last = sets.join(far.withColumnRenamed("node", "id"), "id", "left").select(*DIGEST, "n", F.coalesce("component", "id").alias("group_id"))
    last = written(last, "groups-of-sets")
    release(far)
    drop(sets, candidates)
    alone = own.filter("doc_id is null or s0 is null").select("doc_id", F.col("doc_id").alias("group_id"))
    return uses(looked_up(full.select("doc_id", *DIGEST), last, DIGEST, "n").select("doc_id", "group_id").unionAll(alone), own, last)


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows, with all their columns, of one document of each group of near-duplicates: that of the least id.

    Of rows that share an id one is kept, that of the least text. Rows without an id and texts without words stay.
    """
    groups = near_groups(docs, words, similarity)
    goes = groups.filter("doc_id <> group_id").select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(goes, docs["doc_id"] == goes["_gone"], "left_anti")
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return left
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    twice = repeated.select(F.col("doc_id").alias("_twice"))
    once = left.join(twice, left["doc_id"] == twice["_twice"], "left_semi").withColumn("_place", place).filter("_place = 1").drop("_place")
    return left.join(twice, left["doc_id"] == twice["_twice"], "left_anti").unionAll(once)
