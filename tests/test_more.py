import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import text
from tickloom.operators import fields, generators, metadata, pixels, spectra
from tickloom.plans import inspector
from tickloom.sources import containers, images, paths, streams


def sizes(codec, raw):
    return [(at, n) for at, n, _, _ in streams.PARSERS[codec](raw)]


def test_parsers_find_frames_among_rubbish():
    adts = bytes([0xFF, 0xF1, 0x50, 0x80, 0x01, 0x7F, 0xFC]) + b"data"
    assert sizes("aac", b"xx" + adts * 2 + b"y") == [(2, 11), (13, 11)] and sizes("aac", adts[:5]) == []
    mp3 = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    assert sizes("mp3", b"ID3\3\0\0\0\0\0\2ab" + mp3 * 3) == [(12, 417), (429, 417), (846, 417)]
    assert streams.mpeg_audio_header(b"\xff\xf3\x40\xc0", 0) == (104, {"layer": "3", "rate": "22050", "bit_rate": "32000", "channels": "1"})
    ac3 = b"\x0b\x77\0\0\x16\x40" + bytes(890)  # 224 kbit/s
    assert sizes("ac3", b"z" + ac3 * 2) == [(1, 896), (897, 896)]
    eac3 = b"\x0b\x77\x00\x0f\x00\x80" + bytes(26)
    assert sizes("eac3", eac3 * 2) == [(0, 32), (32, 32)]
    h264 = b"\0\0\0\1\x67\x42\0\0\0\1\x65\xff\xaa\0\0\1\x41\xff\xbb\0\0\1\x41\x00\xcc"
    assert [(a, n, k) for a, n, k, _ in streams.parse_h264(h264)] == [(0, 13, True), (13, 12, False)]  # the last slice goes on a picture
    video = b"\0\0\1\xb3ab\0\0\1\0\0\x08c\0\0\1\0\0\x10d"
    assert [(a, n, h["picture"]) for a, n, _, h in streams.parse_mpeg_video(video)] == [(0, 13, "I"), (13, 7, "P")]
    jpeg = b"\xff\xd8\xff\xc0\0\x0b\x08\0\x02\0\x03\x01\x01\x11\0\xff\xda\0\x02zz\xff\xd9"
    assert [(a, n, h) for a, n, _, h in streams.parse_mjpeg(b"q" + jpeg * 2)] == [(1, len(jpeg), {"width": "3", "height": "2"}), (1 + len(jpeg), len(jpeg), {"width": "3", "height": "2"})]
    assert [h for *_, h in streams.parse_opus(bytes([0x0C, 0]))] == [{"config": "1", "channels": "2", "samples": "960"}]
    assert [(n, k, h) for _, n, k, h in streams.parse_vp8(b"\x10\0\0\x9d\x01\x2a\x40\0\x30\0")] == [(10, True, {"shown": "1", "width": "64", "height": "48"})]
    for codec in streams.PARSERS:
        assert sizes(codec, b"") == [] and isinstance(sizes(codec, bytes(range(256)) * 4), list)


def test_flac_frames():
    def frame(number):
        head = bytes([0xFF, 0xF8, 0xC9, 0x18, number])
        crc = 0
        for b in head:
            crc ^= b
            for _ in range(8):
                crc = (crc << 1 ^ 0x07 if crc & 128 else crc << 1) & 255
        return head + bytes([crc]) + b"\xff\xf8 no frame"

    info = bytes(10) + (44_100 << 44 | 1 << 41 | 15 << 36).to_bytes(8, "big") + bytes(16)
    raw = b"fLaC\x80" + len(info).to_bytes(3, "big") + info + frame(0) + frame(1)
    got = list(streams.parse_flac(raw))
    assert [(a, n) for a, n, _, _ in got] == [(42, 17), (59, 17)] and got[0][3] == {"rate": "44100", "channels": "2", "bits": "16"}


def test_files_of_frames():
    frames = [bytes([k]) * 6 for k in range(3)]
    raw = streams.write_y4m(frames, 2, 2)
    assert [raw[a : a + n] for a, n in sizes("yuv4mpegpipe", raw)] == frames
    raw = streams.write_ivf([(k, f) for k, f in enumerate(frames)], "VP80", 2, 2)
    assert [raw[a : a + n] for a, n in sizes("ivf", raw)] == frames
    tags, sections = {"title": "a=b;c#\\d\ne"}, [{"_section": "CHAPTER", "START": "0"}]
    assert streams.read_ffmetadata(streams.write_ffmetadata(tags, sections)) == (tags, sections)
    assert streams.concat_script("# x\nfile 'a b.wav'\nduration 2.5\nfile c\n") == [{"file": "a b.wav", "duration": "2.5"}, {"file": "c"}]
    assert streams.sequence("f%03d.png", ["f002.png", "f003.png", "f005.png"]) == ["f002.png", "f003.png"] and streams.sequence("f%d", []) == []


def test_transforms_go_back():
    rng = np.random.default_rng(5)
    x = rng.normal(size=24)
    assert spectra.dct(spectra.dct(x), 3) * 2 / 24 == pytest.approx(x) and spectra.dst(spectra.dst(x)) * 2 / 25 == pytest.approx(x)
    long = rng.normal(size=40)
    window = np.sin(np.pi / 16 * (np.arange(16) + 0.5))
    out = np.zeros(40)
    for at in range(0, 32, 8):
        out[at : at + 16] += window * spectra.imdct(spectra.mdct(window * long[at : at + 16]))
    assert out[8:32] == pytest.approx(long[8:32])


def test_resampling():
    t = np.arange(400)
    for target in (4000, 8000, 12_000, 11_025):
        y = spectra.resample(np.sin(2 * np.pi * 300 * t / 8000), 8000, target)
        assert len(y) == math.ceil(400 * target / 8000)
        want = np.sin(2 * np.pi * 300 * np.arange(len(y)) / target)
        assert np.abs(y - want)[60:-60].max() < 0.01
    assert len(spectra.resample(np.array([]), 8000, 4000)) == 0


def test_spectral_measures_of_a_tone(spark):
    x = np.sin(2 * np.pi * 1000 * np.arange(512) / 8000)
    found = dict(zip(spectra.MEASURES, spectra.spectral_measures(x, 8000.0), strict=True))
    assert found["centroid"] == pytest.approx(1000, abs=20) and found["flatness"] < 0.05 and found["crest"] > 50 and found["rolloff"] == pytest.approx(1015, abs=20)
    s = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "k int, pts long, v double")
    got = spectra.aspectralstats(s, "k", 8000.0, 128).orderBy("block").collect()
    assert len(got) == 7 and got[0]["flux"] == 0 and max(r["flux"] for r in got) < 1e-3


def test_plane_filters():
    rng = np.random.default_rng(6)
    p = rng.integers(0, 256, (13, 11), dtype=np.uint8)
    assert (spectra.dctdnoiz(p, 0.0) == p).all() and (spectra.owdenoise(p, 0.0) == p).all() and np.abs(spectra.fftdnoiz(p, 0.0).astype(int) - p).max() == 0
    flat = np.full((16, 16), 99, np.uint8)
    noisy = np.clip(flat + rng.normal(0, 5, flat.shape), 0, 255).astype(np.uint8)
    for f in (lambda x: spectra.dctdnoiz(x, 8.0), lambda x: spectra.fftdnoiz(x, 8.0), lambda x: spectra.owdenoise(x, 10.0), lambda x: spectra.nlmeans(x, 3.0)):
        assert (f(flat) == 99).all() and f(noisy).std() < noisy.std() * 0.8
    assert spectra.ssim(p, p) == pytest.approx(1) and spectra.ssim(p, 255 - p) < 0


def test_life_and_automata(spark):
    glider = [(1, 0), (2, 1), (0, 2), (1, 2), (2, 2)]
    rows = generators.life(spark, 5, 8, 8, glider).orderBy("n").collect()
    alive = [{(i % 8, i // 8) for i, v in enumerate(r["p0"]) if v} for r in rows]
    assert alive[0] == set(glider) and alive[4] == {(x + 1, y + 1) for x, y in glider}
    rows = np.array(generators.cellauto(spark, 17, 8, 90).first()["p0"]).reshape(8, 17) // 255
    for y in range(8):
        assert rows[y].tolist() == [math.comb(y, (y + x - 8) // 2) % 2 if abs(x - 8) <= y and (y + x - 8) % 2 == 0 else 0 for x in range(17)]
    smooth = np.array(generators.perlin(spark, 1, 32, 32).first()["p0"]).reshape(32, 32).astype(int)
    assert np.abs(np.diff(smooth, axis=1)).max() < 80 and smooth.std() > 10
    escape = np.array(generators.mandelbrot(spark, 1, 9, 9, 32, x0=0.0).first()["p0"]).reshape(9, 9)
    assert escape[4, 4] == 255 and escape[0, 0] < 32


def test_fields_of_a_moving_edge(spark):
    def frames(top_first):
        rows = []
        for n in range(6):
            y, x = np.mgrid[0:8, 0:24]
            late = (y % 2 == 1) if top_first else (y % 2 == 0)
            rows.append((1, n, 24, 8, np.where(x < 4 * n + 2 * late, 200, 20).reshape(-1).tolist()))
        return spark.createDataFrame(rows, "k int, n long, w int, h int, p0 array<int>")

    kinds = lambda df: [r["kind"] for r in fields.idet(df, "k").orderBy("n").collect()][1:]
    assert set(kinds(frames(True))) == {"tff"} and set(kinds(frames(False))) == {"bff"}
    whole = frames(True)
    again = fields.weave(pixels.separatefields(whole).withColumn("n", 2 * F.col("n") + F.col("field")).drop("field"), "k")
    assert sorted(map(str, again.collect())) == sorted(map(str, whole.select(*again.columns).collect()))
    still = spark.createDataFrame([(1, n, 4, 4, list(range(16))) for n in range(3)], "k int, n long, w int, h int, p0 array<int>")
    assert all(r["p0"] == list(range(16)) for r in fields.deinterlaced(still, "k").collect())


def test_scripts_of_commands():
    got = metadata.commands("1.0-2 [enter] a b 1, [leave] a b 2; 3 c d 'x;y,z' # rest")
    assert got == [(1.0, 2.0, "enter", "a", "b", "1"), (1.0, 2.0, "leave", "a", "b", "2"), (3.0, None, "enter", "c", "d", "x;y,z")]
    for bad in ("x a b", "1 a", "1 [never] a b"):
        with pytest.raises(ValueError):
            metadata.commands(bad)


def test_metadata_of_odd_rows(spark):
    df = spark.createDataFrame([(1, {"a": "x"}), (2, {}), (3, None), (4, {"a": "1.5"})], "k int, metadata map<string,string>")
    assert [r["k"] for r in metadata.metadata(df, "select", "a").collect()] == [1, 4] and [r["k"] for r in metadata.metadata(df, "select", "a", "1", "greater").collect()] == [4]
    assert [r["metadata"] for r in metadata.metadata(df, "add", "a", "y").orderBy("k").collect()] == [{"a": "x"}, {"a": "y"}, {"a": "y"}, {"a": "1.5"}]
    with pytest.raises(ValueError):
        metadata.metadata(df, "select")


def test_scalar_text(spark):
    row = spark.range(1).select(
        text.duration_micros(F.lit("-1:02:03.5")), text.duration_micros(F.lit("1.5s")), text.duration_micros(F.lit("20us")), text.duration_micros(F.lit("soon")), text.sexagesimal(F.lit(-61.25)),
        text.prefixed(F.lit(1500), "bit/s"), text.prefixed(F.lit(2048), "byte", True), text.prefixed(F.lit(12)), text.hex_dump(F.lit(b"ab\x00")), text.language(F.lit("deu")), text.language(F.lit("xx")),
    ).first()
    assert tuple(row) == (-3_723_500_000, 1_500_000, 20, None, "-0:01:01.250000", "1.500000 Kbit/s", "2.000000 Kibyte", "12", "00000000: 6162 00" + " " * 34 + "ab.\n", "ger", None)
    bits = text.BitReader(bytes([0b10100110, 0b01000010]))
    assert [bits.golomb() for _ in range(4)] == [0, 1, 2, 3] and text.option_map("a=1:b='x:y':c=z\\:w") == {"a": "1", "b": "x:y", "c": "z:w"}


def test_paths(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello")
    (tmp_path / "list").write_text(f"{tmp_path}/a.bin\ndata:,%21\n")
    read = lambda name: bytes(paths.open_source(spark, name).first()["content"])
    assert read(f"{tmp_path}/a.bin") == b"hello" and read(f"subfile,,start,1,end,3,,:{tmp_path}/a.bin") == b"el" and read(f"concatf:{tmp_path}/list") == b"hello!" and read(f"cache:{tmp_path}/a.bin") == b"hello"
    paths.write_tee(spark.range(3), [str(tmp_path / "x"), str(tmp_path / "y")])
    assert spark.read.parquet(str(tmp_path / "y")).count() == 3


def test_inspector(spark):
    wave = containers.write_wav(containers.Audio("s16le", 8000, 2, bytes(40_000)))
    png = images.write_png(images.Picture(np.zeros((3, 5, 3), np.uint8)))
    files = spark.createDataFrame([("a", wave), ("b", png), ("c", b"rubbish")], "path string, content binary")
    show = lambda *argv: {(r["path"], r["section"], r["order"]): r["text"] for r in inspector.inspect(files, list(argv)).collect()}
    got = show("-show_streams", "-show_entries", "stream=codec_name,channels,width,duration", "-of", "compact", "-sexagesimal")
    assert got == {("a", "stream", 0): "stream|codec_name=pcm_s16le|channels=2|width=N/A|duration=0:00:01.250000", ("b", "stream", 0): "stream|codec_name=png|channels=N/A|width=5|duration=N/A"}
    assert sorted(show("-show_packets", "-read_intervals", "0.5%+0.6")) == [("a", "packet", 1), ("a", "packet", 2)]
    assert show("-show_error", "-of", "json") == {("c", "error", 0): '{ "string": "no known format" }'}
    assert show("-show_format", "-show_entries", "format=size", "-pretty", "-of", "csv")[("a", "format", 0)] == "format,39.105469 Kibyte"
    assert show("-show_streams", "-select_streams", "v", "-show_entries", "stream=index", "-of", "default=nw=1") == {("b", "stream", 0): "index=0\n"}
    assert show("-show_packets", "-show_data_hash", "MD5", "-show_entries", "packet=data_hash", "-select_streams", "v", "-of", "default=nk=1:nw=1")[("b", "packet", 0)].startswith("MD5:")
    for bad in (["-nothing"], ["-of"], ["-show_entries", "planet=x"], []):
        with pytest.raises(inspector.OptionError):
            inspector.inspect(files, bad)
    for option in ("-formats", "-muxers", "-demuxers", "-codecs", "-decoders", "-encoders", "-bsfs", "-protocols", "-filters", "-pix_fmts", "-layouts", "-sample_fmts", "-dispositions", "-colors", "-sections", "-version", "-h", "-L"):
        assert inspector.listing(spark, option).count() > 0


def test_every_graph_operator_builds(spark):
    """With options that suit it, each operator gives a plan that Spark can resolve."""
    from tickloom.plans import graph

    s = spark.createDataFrame([(1, 10 * n, float(n % 7), {"a": "b"}, [{"kind": "x"}]) for n in range(40)], "k int, pts long, v double, metadata map<string,string>, side_data array<struct<kind:string>>")
    more = {
        "settb": "1/1000", "asettb": "1/1000", "metadata": "key=a", "ametadata": "key=a", "sidedata": "type=x", "asidedata": "type=x", "aecho": "delays=2:decays=0.5", "loop": "1:3", "aloop": "1:3", "shuffleframes": "1 0", "adelay": "2", "fps": "1000", "framerate": "1000",
        "aresample": "1000", "ebur128": "rate=20", "replaygain": "rate=20", "drmeter": "rate=2", "silenceremove": "window=4", "segment": "50|100", "asegment": "50|100", "compensationdelay": "m=0.01", "biquad": "b0=0.5",
    }
    for name in graph.OPERATORS:
        assert graph.build(name + ("=" + more[name] if name in more else ""), {"in": s}, "k")["out"].schema.fields, name
    two = {"a": s.select("k", "pts", "v"), "b": s.select("k", "pts", (7 - F.col("v")).alias("v"))}
    for name in graph.JOINS:
        assert graph.build(f"[a][b]{name}[x]", dict(two), "k")["x"].schema.fields, name
