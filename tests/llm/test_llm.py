"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tickloom.llm import ann, byte_bpe, components, langid, licenses, media, packing, simhash, token_files, toxicity, url_rules
from tickloom.llm._kk import differencing, windows

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [None, "", " ", "\n\t", "a", "Hello, world! it's 12", "İstanbul ΣΑΣ é 日本語 \x1c\x85\xa0", "x" * 5000, "the cat sat on the mat. " * 400, "<|endoftext|> y", "\U0001f600 🙂!!", "a", "a"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 3 else None, t, "en", "s", 1, "clash", 2.0) for k, t in enumerate(ODD)] + [(5, ODD[5], "en", "s", 1, "clash", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, score double")


@pytest.fixture(scope="module")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def reference_ids(text, end):
    from tokenizers import Tokenizer

    reference_ids.t = getattr(reference_ids, "t", None) or Tokenizer.from_file(WORDS)
    return [*reference_ids.t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(docs, rows, capacity):
    by = {}
    for r in rows:
        by.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    sequences = {}
    for r in rows:
        assert r["length"] > 0
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    assert total == sum(len(reference_ids(d["text"], 1)) for d in docs)
    texts = {d["doc_id"]: reference_ids(d["text"], 1) for d in docs}
    for r in rows:
        if r["doc_id"] is not None:
            assert r["ids_crc32"] == crc(texts[r["doc_id"]][r["start"] : r["start"] + r["length"]])
    return total, len(sequences)


def test_packing(spark, odd, sample):
    rows = packing.pack(sample, WORDS).collect()
    total, n = check_packing(sample.collect(), rows, 2048)
    assert n * 2048 - total < 0.02 * total + 2048
    check_packing(odd.collect(), packing.pack(odd, WORDS, capacity=64).collect(), 64)
    assert packing.pack(odd.limit(0), WORDS).count() == 0


def test_differencing():
    rng = random.Random(1)
    for _ in range(50):
        sizes = [rng.randint(1, 100) for _ in range(rng.randint(1, 60))]
        k = rng.randint(1, 12)
        found = differencing(sizes, k)
        assert sorted(i for _, m in found for i in m) == list(range(len(sizes))) and len(found) <= k
        assert all(s == sum(sizes[i] for i in m) for s, m in found)
        assert all(s <= 100 for s, _ in windows(sizes, 100))
    assert windows([], 5) == [] and max(s for s, _ in differencing([4, 5, 6, 7, 8], 2)) <= 16
    with pytest.raises(ValueError):
        windows([6], 5)


def test_byte_bpe(spark, odd, sample):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})
    for docs in (odd, sample):
        want = sorted((d["doc_id"] if d["doc_id"] is not None else -1, len(i := enc.encode_ordinary(d["text"] or "")), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest()) for d in docs.collect())
        got = sorted((r[0] if r[0] is not None else -1, r[1], r[2], r[3]) for r in byte_bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN).collect())
        assert got == want
    assert byte_bpe.encode_digests(odd.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    tree = byte_bpe.TreeBpe(byte_bpe.load_ranks(RANKS))
    rng = random.Random(2)
    for _ in range(200):
        raw = "".join(rng.choice("abcdeinorst!é") for _ in range(rng.randint(0, 300))).encode()
        assert tree.encode(raw) == enc._core_bpe.encode_single_piece(raw) if raw else tree.encode(raw) == []
        assert tree.decode(tree.encode(raw)) == raw


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_token_files(spark, odd, sample, mode):
    for docs in (odd, sample):
        rows = token_files.read_token_files(token_files.write_token_files(docs, WORDS, mode=mode, block=1000)).orderBy("start").collect()
        known = sorted(docs.collect(), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, d["text"] or ""))
        at = 0
        for r, d in zip(rows, known, strict=True):
            ids = reference_ids(d["text"], 2)
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], at, len(ids), crc(ids))
            at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(odd.limit(0), WORDS)).count() == 0


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes(mode):
    for ids in ([], [0], [0, 0], [1, 65535, 70000, 2**32 - 1], list(range(1000))):
        assert token_files.from_planes(token_files.to_planes(np.array(ids, "<u4"), mode), len(ids), mode).tolist() == ids


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    left, out = set(nodes), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            a = todo.pop()
            seen.add(a)
            near = {b for b in left if linked(a, b)}
            left -= near
            todo += near
        for a in seen:
            out[a] = min(seen)
    return out


@pytest.mark.parametrize("small", [512, 2])
def test_simhash(spark, odd, sample, small):
    for docs in (odd.filter("doc_id is not null"), sample):
        rows = {r["doc_id"]: r for r in simhash.classes(docs, small=small).collect()}
        fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs.collect()}
        want = brute_components(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
        assert {k: (r["fingerprint"], r["component_id"]) for k, r in rows.items()} == {k: (f"{fps[k]:016x}", want[k]) for k in fps}


@pytest.mark.parametrize("small", [512, 4])
def test_links_of_planted_fingerprints(spark, small):
    rng = random.Random(small)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            for b in rng.sample(range(64), rng.randint(0, 3)):
                base ^= 1 << b
            fps.add(base - (1 << 64) if base >> 63 else base)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r["node"]: r["component"] for r in components.connected_components(simhash.links(df, small=small)).collect()}
    want = brute_components(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {x: got.get(x, x) for x in fps} == want


def test_components_of_a_chain(spark):
    edges = [(k, k + 1) for k in range(200)] + [(7, 7), (500, 501)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_contracted_keeps_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(g * 100, g * 100 + 30), rng.randrange(g * 100, g * 100 + 30)) for g in range(5) for _ in range(60)] + [(k, k + 1) for k in range(900, 920)] + [(7, 7), (None, 3), (3, None)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {tuple(r) for r in components.connected_components(df).collect()}
    assert {tuple(r) for r in components.connected_components(components.contracted(df)).collect()} == want
    assert components.contracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("small", [512, 4])
def test_near_duplicates(spark, small, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, lead = [], {}
    for g in range(20):
        base = [word() for _ in range(300)]
        for c in range(4):
            own = list(base)
            for _ in range(c):
                own[rng.randrange(300)] = word()
            rows.append((len(rows), " ".join(own)))
            lead[len(rows) - 1] = 4 * g
    rows += [(100, None), (101, ""), (None, "some words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash.near_groups(docs).collect() if r["doc_id"] is not None}
    assert got == {**lead, 100: 100, 101: 101}
    assert simhash.one_of_each(docs.unionAll(docs)).count() == 20 + 2 + 2
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_clean_documents_with_repeats_stay(spark):
    rng = random.Random(6)
    body = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    texts = [body(100) + " again" * 60, body(100) + " again" * 60, body(100) + " a common line" * 60, body(100) + " a common line" * 60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.one_of_each(docs).count() == 4


def test_near_copies_that_repeat_differently(spark):
    rng = random.Random(7)
    body = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    rows, want = [], {}
    for _ in range(6):
        base, footer, first = body(200), " " + body(8), len(rows)
        for times in (1, 5, 20, 60):
            want[len(rows)] = first
            rows.append((len(rows), base + footer * times))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["group_id"] for r in simhash.near_groups(docs).collect()} == want


def test_near_copies_of_another_than_the_least(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    own = [word() for _ in range(400)]
    cut = lambda n: " ".join(own[:n])
    while (simhash.fingerprint(cut(400), 5) ^ simhash.fingerprint(cut(390), 5)).bit_count() > 2:
        own = [word() for _ in range(400)]
    # 386 of 396 shingles, 312 of 386, 312 of 396
    docs = spark.createDataFrame([(0, cut(400)), (1, cut(390)), (2, cut(316))], "doc_id long, text string")
    assert {r["group_id"] for r in simhash.near_groups(docs).collect()} == {0}


def test_pairs_just_above_the_similarity(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(100):
        own = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(390)]
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(own[:316]))]  # 312 of 386 shingles: 0.808
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r["doc_id"] % 2 == 1 and r["group_id"] != r["doc_id"] for r in simhash.near_groups(docs).collect()) >= 99


@pytest.mark.parametrize("block", [256, 4])
def test_exact_links(spark, block, monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(simhash, "BLOCK_DOCS", block)
    texts = {}
    for g in range(6):
        base = [f"w{rng.randrange(50)}" for _ in range(60)]
        for c in range(6):
            own = list(base)
            for _ in range(c):
                own[rng.randrange(60)] = f"x{rng.randrange(1000)}"
            texts[len(texts)] = " ".join(own)
    texts |= {90: "one", 91: "one", 92: "ONE", 93: "two words", 94: ""}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for k, t in texts.items()}
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {k: k for k in texts}
    for _ in texts:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    docs = spark.createDataFrame([*texts.items(), (None, "one"), (95, None)], "doc_id long, text string").withColumn("slot", F.lit("clash"))
    together = spark.createDataFrame([(k, 7) for k in texts], "node long, component long")
    found = components.connected_components(simhash.exact_links(docs, together, 5, 0.8)).collect()
    assert {k: k for k in texts} | {r["node"]: r["component"] for r in found} == want
    assert len(set(want.values())) < len(texts) - 6
    assert simhash.exact_links(docs.limit(0), together, 5, 0.8).count() == 0
    assert simhash.exact_links(docs, together.limit(0), 5, 0.8).count() == 0


def test_wide_links_in_blocks(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    rows = []
    for k in range(40):
        own = [x ^ (1 << rng.randrange(64)) for x in base]
        rows.append((k, *[x - (1 << 64) if x >> 63 else x for x in own]))
    df = spark.createDataFrame(rows, "id long, f0 long, f1 long, f2 long, f3 long")
    for small in (4, 512):
        got = components.connected_components(simhash.wide_links(df, 30, small)).collect()
        assert {r["component"] for r in got} == {0} and len(got) == 40


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[20:40] = x[20]  # copies: ties go to smaller ids
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [None] * 16), (None, [1.0] * 16), (7, x[7].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10].tolist()
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in own] == list(range(1, 11))
        assert all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(want))
    assert hits >= 0.9 * 150 and {r["query_id"] for r in got} == set(range(0, 1500, 100))
    few = ann.search(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (200, [1.0, 1.0])], "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in few] == [(0, 1 if False else 200), (0, 1), (200, 0), (200, 1)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_neighbours_of_repeated_rows(spark):
    x = np.random.default_rng(4).normal(size=(12, 4))
    rows = [(100 * k, v.tolist()) for k, v in enumerate(x) for _ in range(10)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for q in range(12):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == 100 * q)
        assert own == [(n + 1, 100 * v) for n, v in enumerate(np.argsort(d)[:10].tolist())]


def test_neighbours_far_from_the_origin(spark):
    x = 1e5 + np.random.default_rng(14).normal(size=(3000, 8)) * 1e-3
    got = ann.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.95 * 300


def test_neighbours_of_several_lengths_and_repeated_queries(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [3.0]), (2, [5.0]), (3, [4.0]), (100, [2.0])]
    got = sorted(tuple(r) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 1, pytest.approx(2**0.5)), (100, 1, 3, 2.0), (100, 2, 2, 3.0)]
    with pytest.raises(ValueError):
        ann.search(spark.createDataFrame([(k, [1.0] * k) for k in range(1, 70)], "vec_id long, embedding array<double>"))


def test_url_rules_edge_cases(spark):
    urls = [None, "", "no scheme", "http://NET/", "http://a.net", "https://x.EXAMPLE.net/en/1?q#f", "http://notnet/", "http://b.org/fr/2", "http://c.org/fr", "ftp://d.example.com/de/#x", "a://b://c.net/", "http://e.org?x/fr/", "http://x.net/" + "y" * 9000]
    pages = spark.createDataFrame([(k, u, "h", "x") for k, u in enumerate(urls)] + [(None, urls[5], "h", "x"), (5, urls[5], "h", "x")], "page_id long, url string, html string, rule string")
    rows = url_rules.judge(pages).collect()
    assert len(rows) == len(urls) + 2
    by = {r["page_id"]: r for r in rows if r["page_id"] is not None}
    assert [by[k]["rule"] for k in range(len(urls))] == [None, None, None, "net/", None, "example.net/en/", None, "org/fr/", None, "example.com/de/", None, None, "net/"]
    assert (by[5]["host"], by[5]["path"]) == ("x.example.net", "/en/1") and (by[10]["host"], by[11]["path"]) == ("b:", "")
    assert {by[k]["verdict"] for k in (0, 1, 2)} == {"allow"} and by[3]["verdict"] == "block"
    assert url_rules.judge(pages.limit(0)).count() == 0 and url_rules.judge(pages.limit(2)).count() == 2


def test_url_rules_of_three_tokens(spark):
    urls = ["http://x.y.net/z", "http://x.y.org/fr/", "http://x.org/fr/z", "http://y.org/fr/z"] * 10 + ["http://x.y.com/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_rules.judge(pages).collect()}[40] == "block"


def test_media(spark, odd):
    rows = media.describe(media.store_pcm(media.encode_media(odd))).collect()
    assert len(rows) == len(ODD) + 1
    seen = {}
    for r in rows:
        if r["doc_id"] is None:
            continue
        raw = (ODD[r["doc_id"]] or "").encode()
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert seen.setdefault(raw, tuple(r)[1:]) == tuple(r)[1:]
    assert media.describe(media.store_pcm(media.encode_media(odd.limit(0)))).count() == 0


def scalar_law(code, law):
    if law == "mulaw":
        code ^= 0xFF
        value = (((code & 15) * 2 + 33) << (code >> 4 & 7)) - 33
        return -4 * value if code & 128 else 4 * value
    code ^= 0x55
    part, low = code >> 4 & 7, code & 15
    value = (2 * low + 1) * 8 if part == 0 else (2 * low + 33) * 8 << (part - 1)
    return value if code & 128 else -value


def test_stored_media_against_brute_force(spark, odd):
    got = media.store_pcm(media.encode_media(odd)).filter("doc_id is not null").collect()
    described = {r["doc_id"]: r for r in media.describe(media.store_pcm(media.encode_media(odd))).collect()}
    for r in got:
        raw = (ODD[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        head = b"fmt " + (18).to_bytes(4, "little") + b"\x07\0\x01\0" + (8000).to_bytes(4, "little") * 2 + b"\x01\0\x08\0\0\0"
        stored = b"WAVE" + head + b"data" + len(payload).to_bytes(4, "little") + payload
        assert r["media"] == b"RIFF" + len(stored).to_bytes(4, "little") + stored
        x = [scalar_law(c, "mulaw") for c in payload]
        wide = [v for a, b in zip(x, [*x[1:], x[-1]], strict=True) for v in (a, (a + b + 1) // 2)]
        assert media.read_wave(r["pcm"]) == (media.PCM, 16000, np.array(wide, "<i2").tobytes())
        d = described[r["doc_id"]]
        assert (d["media_bytes"], d["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        ima = [v for at in range(0, len(payload), 576) for v in scalar_ima(payload[at : at + 576])]
        peak = max(abs(scalar_law(c, "alaw")) for c in payload)
        crossings = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))
        want = f"mulaw_power={sum(v * v for v in x) // len(x)};mulaw_crossings={crossings};alaw_peak={peak};adpcm_crc32={zlib.crc32(np.array(ima, '<i2').tobytes())};pcm_16000_crc32={zlib.crc32(np.array(wide, '<i2').tobytes())}"
        assert d["feature"] == want
    assert media.store_pcm(spark.createDataFrame([(1, None, "x")], "doc_id long, media binary, pcm string")).first()["pcm"] is None


def scalar_ima(block):
    value, step, out = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            s = media.STEPS[step]
            d = (s >> 3) + (s if code & 4 else 0) + (s >> 1 if code & 2 else 0) + (s >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - d if code & 8 else value + d))
            step = max(0, min(88, step + media.STEP_MOVES[code & 7]))
            out.append(value)
    return out


def test_telephony_codecs():
    rng = np.random.default_rng(4)
    blocks = rng.integers(0, 256, (5, 64), dtype=np.uint8)
    assert media.decode_ima(blocks).tolist() == [scalar_ima(bytes(b)) for b in blocks]
    assert (media.MULAW_PCM[0xFF], media.MULAW_PCM[0x00], media.MULAW_PCM[0x80]) == (0, -32124, 32124)
    assert (media.ALAW_PCM[0xD5], media.ALAW_PCM[0x55], media.ALAW_PCM[0xAA], media.ALAW_PCM[0x2A]) == (8, -8, 32256, -32256)
    assert media.resample(np.array([0, 10, 20], np.int16)).tolist() == [0, 5, 10, 15, 20, 20]


def brute_license(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(spark, odd):
    texts = [*ODD, "CC-BY cc by CC BY-NC 4.0", "All Rights Reserved. all rights reserved", "GNU General Public License", "écc by", "cc by" * 3, "SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nnext"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in licenses.scan_licenses(docs).collect():
        assert tuple(r)[1:6] == brute_license(texts[r["doc_id"]]), texts[r["doc_id"]]
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    last = licenses.scan_licenses(docs).orderBy(F.desc("doc_id")).first()["labels"].split(",")
    assert {"spdx", "mit", "gpl-2.0-only", "apache-2.0", "permissive"} <= set(last)
    assert licenses.parse("mit or gpl-2.0 with x and bsd".split()) == ("or", "mit", ("and", ("with", "gpl-2.0", "x"), "bsd"))
    assert licenses.parse(["(", "mit"]) == "mit" and licenses.parse([]) is None and licenses.parse(["mit", "or"]) == "mit"
    assert not licenses.permissive(licenses.parse("mit and gpl-3.0".split()))
    assert licenses.scan_licenses(odd.limit(0)).count() == 0


def test_license_labels_against_brute_force():
    rng = random.Random(12)
    phrases = [p for p, _ in (*licenses.BASE, *licenses.NOTICES)]
    for _ in range(300):
        text = " ".join(rng.choice([*phrases, "of any", "license", "gnu", "mit-license", "CC", "by", "x"]) for _ in range(rng.randint(0, 12)))
        words = re.findall(r"[a-z0-9]+", text.lower())
        want = {label for phrase, label in (*licenses.BASE, *licenses.NOTICES) if f" {phrase} " in f" {' '.join(words)} "}
        got = licenses.scan(text)
        assert set(filter(None, got[5].split(","))) == want
        assert got[6] == pytest.approx(1 - 0.5 ** (got[1] + len({x for p, x in licenses.NOTICES if f" {p} " in f" {' '.join(words)} "})) if want else 0.0)


def brute_evaluation(tree):
    if isinstance(tree, str):
        return [tree], not tree.startswith(licenses.COPYLEFT)
    (a, x), (b, y) = brute_evaluation(tree[1]), brute_evaluation(tree[2])
    return (a, x) if tree[0] == "with" else (a + b, x or y if tree[0] == "or" else x and y)


def test_license_expressions():
    rng = random.Random(13)
    for _ in range(300):
        symbols = [rng.choice(["mit", "gpl-2.0", "bsd", "and", "or", "with", "(", ")"]) for _ in range(rng.randint(1, 15))]
        tree = licenses.parse(symbols)
        if tree is not None:
            assert licenses.evaluated(tree) == brute_evaluation(tree)
    many = "mit" + " or gpl-2.0" * 100_000
    assert licenses.scan(f"SPDX-License-Identifier: {many}")[5] == "gpl-2.0,mit,permissive,spdx"
    deep = "(" * 100_000 + "gpl-3.0" + " and mit)" * 100_000
    assert licenses.scan(f"SPDX-License-Identifier: {deep}")[5] == "gpl-3.0,mit,spdx"
    assert licenses.scan("SPDX-License-Identifier: mit " * 100_000)[5] == "mit,permissive,spdx"
    assert licenses.evaluated(licenses.parse("gpl-2.0 with classpath-exception".split())) == (["gpl-2.0"], False)


def test_language(spark, odd, sample):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    got = langid.identify(odd, model).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (0, 1, 2)} == {"und"} and all(0 <= r["score"] <= 1 for r in got)
    en, de = (docs.filter(f"lang = '{x}' and n_chars between 600 and 3000").orderBy("doc_id").first()["text"] for x in ("en", "de"))
    both = spark.createDataFrame([(1, en + " " + de)], "doc_id long, text string")
    assert [r["lang"] for r in langid.spans(both, model).orderBy("first_word").collect()][:1] == ["en"] and {r["lang"] for r in langid.spans(both, model).collect()} >= {"en", "de"}
    assert langid.identify(odd.limit(0), model).count() == 0 and langid.identify(odd, langid.train(odd.limit(0))).count() == len(ODD) + 1


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(6)
    scores = rng.normal(size=(12, 3)) * 2
    index, bounds = np.array([0, 5, 2, 7, 1, 3, 9, 11]), np.array([0, 5, 5, 8])
    got = langid.viterbi(scores, index, bounds, 1.5)
    import itertools

    for a, b in ((0, 5), (5, 8)):
        value = lambda p, a=a: sum(scores[index[a + t], s] for t, s in enumerate(p)) - 1.5 * sum(x != y for x, y in zip(p, p[1:], strict=False))
        best = max(itertools.product(range(3), repeat=b - a), key=value)
        assert tuple(got[a:b]) == best


def test_toxicity(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.classify(docs, model).join(labels, "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.05 * len(clean)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    # neither ids nor labels nor languages are inputs
    other = docs.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("xx").alias("lang"))
    a = {r["doc_id"] + 7: r["score"] for r in toxicity.classify(docs.limit(50), model).collect()}
    b = {r["doc_id"]: r["score"] for r in toxicity.classify(other, model).collect()}
    assert all(b[k] == v for k, v in a.items())
    got = toxicity.classify(odd, model).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(odd.limit(0), model).count() == 0
    assert toxicity.kept(odd, toxicity.train(odd, labels.limit(0))).columns == odd.columns


def test_convolution_against_positions():
    rng = np.random.default_rng(15)
    texts = ["", "a b c d e", "b", "c c a", " ".join(rng.choice(list("abcdefgh"), 300))]
    pairs, bounds, _ = toxicity._encoded(texts, 2)
    model = toxicity.ToxicityModel((1, 2, 3), rng.normal(size=(2 * toxicity.BUCKETS, 4)), [rng.normal(size=(w, 4, 3)) for w in (1, 2, 3)], [rng.normal(size=3) for _ in range(3)], rng.normal(size=9), 0.1)
    model.prepare()
    for block in (7, 1 << 16):
        got = toxicity._pooled(model, pairs, bounds, block)
        for k in range(len(texts)):
            x = [model.emb[a] + model.emb[b] for a, b in pairs[bounds[k] : bounds[k + 1]]]
            want = [max([0.0, *(b[c] + sum(x[t + j] @ f[j, :, c] for j in range(len(f)) if t + j < len(x)) for t in range(len(x)))]) for f, b in zip(model.filters, model.bias, strict=True) for c in range(3)]
            assert got[k] == pytest.approx(want, abs=1e-4)


def test_gradients_against_finite_differences():
    rng = np.random.default_rng(16)
    text = np.array([0, 0, 0, 1, 2, 2])
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([0.3, 1.0, 0.7])
    x, filters, bias = rng.normal(size=(6, 4)), [rng.normal(size=(w, 4, 3)) for w in (1, 2, 3)], [rng.normal(size=3) for _ in range(3)]
    params = [None, *filters, *bias, rng.normal(size=9), rng.normal(size=1)]

    def loss():
        z = np.full(3, params[-1][0])
        for d in range(3):
            own = x[text == d]
            act = [max([0.0, *(b[c] + sum(own[t + j] @ f[j, :, c] for j in range(len(f)) if t + j < len(own)) for t in range(len(own)))]) for f, b in zip(filters, bias, strict=True) for c in range(3)]
            z[d] += np.array(act) @ params[-2]
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum())

    found = toxicity.gradients(params, 3, x, text, y, weight, decay=0.0)
    wide = np.zeros_like(x)
    np.add.at(wide, found[0][0], found[0][1])
    for values, grads in [(x, wide), *zip(params[1:], found[1:], strict=True)]:
        for at in np.ndindex(values.shape):
            old, h = values[at], 1e-6
            values[at] = old + h
            more = loss()
            values[at] = old - h
            less = loss()
            values[at] = old
            assert (more - less) / (2 * h) == pytest.approx(grads[at], abs=1e-5)


def test_calibration_by_language():
    rng = np.random.default_rng(17)
    y = np.tile([0.0, 1.0], 400)
    langs = ["de"] * 400 + ["en"] * 400
    p = np.where(y == 1, 0.6, 0.3) + np.where(np.arange(800) < 400, 0.0, 0.25) + rng.normal(0, 0.02, 800)
    common, own = toxicity.calibrated(p, y, langs)
    assert set(own) == set(toxicity.FUNCTION_WORDS) and own["de"] < own["en"] and own["es"] == own["fr"] == pytest.approx(common)
    assert toxicity.calibrated(p[:4], np.zeros(4), langs[:4]) == (0.5, dict.fromkeys(toxicity.FUNCTION_WORDS, 0.5))


def test_stages_keep_columns_and_odd_rows(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    language = langid.kept(odd, langid.train(docs), 0.4).collect()
    want = [r for r in odd.collect() if any(map(str.isalpha, r["text"] or ""))]
    assert odd.columns == langid.kept(odd, langid.train(docs), 0.4).columns
    assert {r["doc_id"] for r in language} <= {r["doc_id"] for r in want} and sum(r["doc_id"] == 5 for r in language) == 2
    model = toxicity.train(docs, labels)
    clean = toxicity.kept(odd, model).collect()
    assert {r["doc_id"] for r in clean} >= {0, 1, 2} and sum(r["doc_id"] == 5 for r in clean) == 2
    assert langid.kept(odd.limit(0), langid.train(docs)).count() == toxicity.kept(odd.limit(0), model).count() == 0


def test_pipeline_keeps_one_of_each_group_by_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()) else set() for k, t in rows.items()}
    by_shingle = {}
    for k, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    near = {(a, b) for x in by_shingle.values() if len(x) < 300 for a in x for b in x if a < b}
    edges = [(a, b) for a, b in near if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    least = {k: k for k in rows}
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert kept == {k for k, m in least.items() if k == m}


def test_pipeline(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), now.schema)
    kept = now.collect()
    assert 0 < len(kept) < docs.count()
    total = sum(len(reference_ids(d["text"], 1)) for d in kept)
    got = corpus_pipeline.run(spark, sf_dir).agg(F.sum("length")).first()[0]
    assert got == total
