import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import bitstream
from tickloom.sources import containers, images, packets, pcm, subtitles


@pytest.mark.parametrize("name", [k for k, (_, _, w) in images.FORMATS.items() if w])
@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 1), (7, 5, 3), (6, 8, 4)])
def test_pictures_come_back(name, shape):
    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 2, shape, dtype=np.uint8) * 255 if name in ("pbm", "xbm") else rng.integers(0, 256, shape, dtype=np.uint8)
    if name in ("pbm", "xbm") or name == "gif" and shape[2] > 1:
        pixels = np.repeat(pixels[..., :1], shape[2], axis=2)
    p = images.Picture(pixels)
    raw = images.FORMATS[name][2](p)
    got = images.FORMATS[name][1](raw).pixels
    want = {1: images._luma(p)[..., None], 3: images._rgb(p), 4: images._rgba(p)}[got.shape[2]]
    assert np.abs(got.astype(int) - want).max() <= (255 // 3 if name == "gif" and shape[2] > 1 else 0)
    assert name == "targa" or images.detect(raw) == name


def test_runs_and_text_of_pictures():
    flat = images.Picture(np.zeros((4, 300, 3), np.uint8))
    for name in ("qoi", "pcx", "png", "gif"):
        assert (images.FORMATS[name][1](images.FORMATS[name][2](flat)).pixels == 0).all()
    assert images.read_pnm(b"P2\n# a comment\n2 1\n15\n0 15\n").pixels.tolist() == [[[0], [255]]]
    assert images.read_pnm(b"P1 3 1 101").pixels.tolist() == [[[0], [255], [0]]]
    noisy = bytes(np.random.default_rng(2).integers(0, 256, 20_000, dtype=np.uint8))
    assert images.unpack_lzw(images.pack_lzw(noisy, 8), 8) == noisy


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    import zlib

    rng = np.random.default_rng(kind)
    pixels = rng.integers(0, 256, (5, 4, 3), dtype=np.uint8)
    rows, body = pixels.reshape(5, 12).astype(int), b""
    for y in range(5):
        line = [kind]
        for x in range(12):
            a, b = (rows[y, x - 3] if x >= 3 else 0), (rows[y - 1, x] if y else 0)
            c = rows[y - 1, x - 3] if y and x >= 3 else 0
            p = a + b - c
            guess = {1: a, 2: b, 3: (a + b) // 2, 4: a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c}[kind]
            line.append(int(rows[y, x] - guess) & 255)
        body += bytes(line)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + bytes(4)
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    assert (images.read_png(raw).pixels == pixels).all()


@pytest.mark.parametrize("name", [k for k, (m, _, _) in containers.FORMATS.items() if m])
def test_containers_come_back(name):
    tried = 0
    for codec in pcm.KINDS:
        for data in (b"", bytes(range(24)), bytes(range(240)) * 3):
            a = containers.Audio(codec, 8000, 1, data)
            try:
                raw = containers.FORMATS[name][2](a)
            except (StopIteration, containers.FormatError):
                continue
            tried += 1
            assert containers.FORMATS[name][1](raw) == a and containers.detect(raw) == name
    assert tried


def test_broken_files_say_so(spark):
    wave = containers.write_wav(containers.Audio("s16le", 8000, 2, bytes(8)))
    files = spark.createDataFrame([(1, wave), (2, wave[:30]), (3, b"nothing"), (4, None), (5, b"")], "k int, content binary")
    got = {r["k"]: r for r in containers.demux(files).collect()}
    assert got[1]["error"] is None and (got[1]["codec"], got[1]["channels"]) == ("s16le", 2) and all(got[k]["error"] for k in (2, 3, 5)) and got[4]["format"] is None
    assert containers.samples(containers.demux(files)).first()["samples"] == [[0.0, 0.0], [0.0, 0.0]]
    pictures = {r["k"]: r for r in images.demux(files).collect()}
    assert all(pictures[k]["error"] for k in (1, 2, 3, 5))


def test_sample_formats():
    x = np.array([0.0, 0.5, -0.5, 1.0, -1.0, 2.0, float("nan")])
    for kind in pcm.WHOLE:
        back = pcm.decode(pcm.encode(x, kind), kind)
        assert np.abs(back - [0, 0.5, -0.5, 1, -1, 1, 0]).max() <= 1 / 128
    assert pcm.decode(b"\x00\x80\xff\x7f\x01", "s16le").tolist() == [-1.0, 32767 / 32768]
    for kind in pcm.COMPANDED:
        codes = bytes(range(256))
        again = pcm.encode(pcm.decode(codes, kind), kind)
        assert (pcm.decode(again, kind) == pcm.decode(codes, kind)).all()
    slow = (np.sin(np.arange(505) / 40) * 8000).astype(int).tolist()
    assert np.abs(np.array(pcm.decode_ima_wav(pcm.encode_ima_wav(slow))) - slow)[60:].max() < 400
    assert np.abs(np.array(pcm.decode_ima_qt(pcm.encode_ima_qt(slow[:64], 0, 40))) - slow[:64])[20:].max() < 800
    assert np.abs(np.array(pcm.decode_ms(pcm.encode_ms(slow[:500], 0, 300))) - slow[:500]).max() < 800


def test_subtitles():
    cues = [(1000, 2500, "one\ntwo"), (3000, 4000, "three"), (3_700_000, 3_701_000, "x")]
    for name in ("srt", "webvtt", "ass", "jacosub", "ttml"):
        text = subtitles.WRITERS[name](cues)
        assert list(subtitles.READERS[name](text)) == cues and subtitles.detect(text) == name
    texts = {
        "mpl2": "[10][20]/a|b\n", "mpsub": "FORMAT=TIME\n\n1 1\na\nb\n\n", "subviewer": "00:00:01.00,00:00:02.00\na[br]b\n", "vplayer": "00:00:01:a|b\n00:00:02:\n", "pjs": '10, 20, "a|b"\n',
        "stl": "00:00:01:00 , 00:00:02:00 , a|b\n", "realtext": '<window>\n<time begin="1" end="2"/>a<br/>b\n', "sami": "<SAMI><SYNC Start=1000>a<br>b<SYNC Start=2000>&nbsp;", "microdvd": "{1}{1}10\n{10}{20}a|b\n",
        "subviewer1": "[00:00:01]\na|b\n\n[00:00:02]\n\n", "jacosub": "@30 @60 a\\nb\n", "lrc": "[00:01.00]a\n[00:02.00]b\n",
    }
    for name, text in texts.items():
        first = next(iter(subtitles.READERS[name](text)))
        assert first == (1000, 2000, "a" if name == "lrc" else "a\nb"), name
        assert subtitles.detect(text) == name
        assert list(subtitles.READERS[name]("")) == [] and list(subtitles.READERS[name]("nothing\nto read")) == []


def test_adler_of_streams(spark):
    import zlib

    rows = [(1, k, bytes([k % 251]) * (k * 37 % 900)) for k in range(300)] + [(2, 0, None), (2, 1, b"")]
    df = spark.createDataFrame(rows, "s int, k int, payload binary")
    got = {r["s"]: r["hash"] for r in packets.stream_hash(df, "s", ["k"], "adler32").collect()}
    assert got == {1: f"{zlib.adler32(b''.join(r[2] for r in rows[:300])):08x}", 2: "00000001"}


def test_frame_lines(spark):
    df = spark.createDataFrame([(0, None, 5, 1, b"ab", 1), (0, 1, 6, 1, None, 0)], "stream int, dts long, pts long, duration long, payload binary, flags int")
    assert [r["line"] for r in packets.frame_lines(df).orderBy("pts").collect()] == ["0, -9223372036854775808,          5,        1,        2, 0x012400c3", None]
    assert packets.frame_lines(df, "md5").orderBy("pts").first()["line"].endswith(", 187ef4436122d1cc2f40dc2b92f0eba0")


def test_bitstream_units(spark):
    data = b"\0\0\0\1\x67\x42\0\0\1\x68\x01\0\0\0\1\x65\xaa\xbb"
    assert bitstream.split_annexb(data) == [b"\x67\x42", b"\x68\x01", b"\x65\xaa\xbb"]
    assert bitstream.to_annexb(b"\0\0\0\2\x65\xaa", "h264", [b"\x67\x42"]) == b"\0\0\0\1\x67\x42\0\0\0\1\x65\xaa"
    assert bitstream.split_lengths(b"\0\0\0\2ab\0\0\0\x09c") == [b"ab"]
    frames = [b"a" * 3, b"b" * 300, b""]
    assert bitstream.split_superframe(bitstream.join_superframe(frames)) == frames and bitstream.split_superframe(b"x") == [b"x"]
    assert bitstream.split_obus(b"\x12\x00\x0a\x01\xaa\x30\xbb") == [(2, b"\x12\x00"), (1, b"\x0a\x01\xaa"), (6, b"\x30\xbb")]
    body, asc = bitstream.adts_to_asc(bytes([0xFF, 0xF1, 0x50, 0x80, 0x01, 0x3F, 0xFC]) + b"data")
    assert body == b"data" and asc == bytes([0x12, 0x10])
    df = spark.createDataFrame([(b"a\0\0",), (b"\0",), (b"",), (None,), (b"\x10\0",)], "payload binary")
    assert [r[0] if r[0] is None else bytes(r[0]) for r in df.select(bitstream.chomp(F.col("payload"))).collect()] == [b"a", b"", b"", None, b"\x10"]
    head = spark.createDataFrame([(b"OpusHead" + bytes(11),)], "e binary").select(bitstream.opus_metadata(F.col("e"), -256)).first()[0]
    assert bytes(head)[16:18] == b"\x00\xff" and len(head) == 19


def test_text_sinks(spark):
    df = spark.createDataFrame([(1, 'a"b\\c\n<&>')], "n long, t string")
    row = df.select(packets.json_object(["n", "t"]), packets.xml_element(["n", "t"]), packets.ini_section(["n", "t"], F.lit("x.y")), packets.flat_section(["n", "t"], F.lit("x.y")), packets.default_section(["n", "t"])).first()
    import json
    import xml.etree.ElementTree as ET

    assert json.loads(row[0]) == {"n": 1, "t": 'a"b\\c\n<&>'} and ET.fromstring(row[1].replace("\n", " ")).get("t") == 'a"b\\c <&>'
    assert row[2] == '[x.y]\nn=1\nt=a"b\\\\c\\n<&>\n' and row[3] == 'x.y.n=1\nx.y.t="a\\"b\\\\c\\n<&>"' and row[4].startswith("[PACKET]\nn=1\n")
