"""Simple audio containers, read and written whole: a header that says what the bytes are, and the bytes."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import payload, pcm


class FormatError(ValueError):
    """Bytes that aren't what the format asks for."""


@dataclass(frozen=True)
class Audio:
    codec: str
    rate: int
    channels: int
    data: bytes


def _width(codec: str) -> int:
    return pcm._bytes_of(codec) if codec in pcm.KINDS else 1


def _chunks(raw: bytes, at: int, order: str, size: str = "I", pad: int = 2) -> Iterator[tuple[bytes, bytes]]:
    """(name, body) of chunks with a length after each name; a body that is cut short ends the file."""
    head = 4 + struct.calcsize(order + size)
    while at + head <= len(raw):
        n = struct.unpack_from(order + size, raw, at + 4)[0]
        if n < 0 or n == (1 << 32) - 1 and size == "I":
            n = len(raw) - at - head
        yield raw[at : at + 4], raw[at + head : at + head + n]
        at += head + n + -n % pad


#: WAVE format tags.
TAGS = {1: {8: "u8", 16: "s16le", 24: "s24le", 32: "s32le"}, 3: {32: "f32le", 64: "f64le"}, 6: {8: "alaw"}, 7: {8: "mulaw"}, 0x11: {4: "adpcm_ima_wav"}, 2: {4: "adpcm_ms"}}


def _wave_format(body: bytes) -> tuple[str, int, int]:
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
    if tag == 0xFFFE and len(body) >= 26:  # the tag proper is in the extension
        tag = struct.unpack_from("<H", body, 24)[0]
    try:
        return TAGS[tag][bits], rate, channels
    except KeyError:
        raise FormatError(f"WAVE tag {tag} with {bits} bits") from None


def _wave_head(a: Audio) -> bytes:
    tag, bits = next((t, b) for t, kinds in TAGS.items() for b, k in kinds.items() if k == a.codec)
    align = _width(a.codec) * a.channels
    return struct.pack("<HHIIHH", tag, a.channels, a.rate, a.rate * align, align, bits) + (b"" if tag == 1 else b"\0\0")


def read_wav(raw: bytes) -> Audio:
    if raw[:4] not in (b"RIFF", b"RF64") or raw[8:12] != b"WAVE":
        raise FormatError("no RIFF/WAVE")
    form = None
    for name, body in _chunks(raw, 12, "<"):
        if name == b"fmt ":
            form = _wave_format(body)
        elif name == b"data":
            if form is None:
                raise FormatError("data before format")
            return Audio(*form, body)
    raise FormatError("no data chunk")


def write_wav(a: Audio) -> bytes:
    head = _wave_head(a)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(a.data)) + a.data + b"\0" * (len(a.data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


#: The last twelve bytes of Wave64's chunk names, and of the first one's.
W64_TAIL, W64_RIFF = bytes.fromhex("f3acd3118cd100c04f8edb8a"), bytes.fromhex("2e91cf11a5d628db04c10000")


def read_w64(raw: bytes) -> Audio:
    if raw[:16] != b"riff" + W64_RIFF or raw[24:40] != b"wave" + W64_TAIL:
        raise FormatError("no Wave64")
    at, form = 40, None
    while at + 24 <= len(raw):
        n = struct.unpack_from("<Q", raw, at + 16)[0]
        body = raw[at + 24 : at + n]
        if raw[at : at + 4] == b"fmt ":
            form = _wave_format(body)
        elif raw[at : at + 4] == b"data" and form:
            return Audio(*form, body)
        if n < 24:
            break
        at += n + -n % 8
    raise FormatError("no data chunk")


def write_w64(a: Audio) -> bytes:
    chunk = lambda name, body: name + W64_TAIL + struct.pack("<Q", 24 + len(body)) + body + b"\0" * (-len(body) % 8)
    rest = b"wave" + W64_TAIL + chunk(b"fmt ", _wave_head(a)) + chunk(b"data", a.data)
    return b"riff" + W64_RIFF + struct.pack("<Q", 24 + len(rest)) + rest


def _extended(x: float) -> bytes:
    """A whole number as an 80-bit float."""
    m, e = math.frexp(x)
    return struct.pack(">HQ", e + 16382, int(m * (1 << 64))) if x else bytes(10)


def _from_extended(raw: bytes) -> float:
    e, m = struct.unpack(">HQ", raw)
    return math.ldexp(m, (e & 0x7FFF) - 16383 - 63)


#: Compression types of AIFF-C.
AIFC = {b"fl32": "f32be", b"FL32": "f32be", b"fl64": "f64be", b"FL64": "f64be", b"alaw": "alaw", b"ALAW": "alaw", b"ulaw": "mulaw", b"ULAW": "mulaw", b"sowt": "s16le", b"in24": "s24be", b"in32": "s32be"}
BIG = {8: "s8", 16: "s16be", 24: "s24be", 32: "s32be"}


def read_aiff(raw: bytes) -> Audio:
    if raw[:4] != b"FORM" or raw[8:12] not in (b"AIFF", b"AIFC"):
        raise FormatError("no AIFF")
    form = None
    for name, body in _chunks(raw, 12, ">"):
        if name == b"COMM":
            channels, _, bits = struct.unpack_from(">HIH", body)
            kind = body[18:22] if raw[8:12] == b"AIFC" else b"NONE"
            codec = AIFC.get(kind) or BIG.get(-(-bits // 8) * 8)
            if codec is None:
                raise FormatError(f"AIFF type {kind!r}")
            form = (codec, round(_from_extended(body[8:18])), channels)
        elif name == b"SSND" and form:
            return Audio(*form, body[8 + struct.unpack_from(">I", body)[0] :])
    raise FormatError("no sound chunk")


def write_aiff(a: Audio) -> bytes:
    bits = next((b for b, k in BIG.items() if k == a.codec), None)
    kind = b"NONE" if bits else next(k for k, c in AIFC.items() if c == a.codec)
    frames = len(a.data) // (_width(a.codec) * a.channels)
    comm = struct.pack(">HIH", a.channels, frames, bits or 8 * _width(a.codec)) + _extended(a.rate)
    if not bits:
        comm += kind + b"\0\0"
    chunk = lambda name, body: name + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)
    rest = (b"AIFF" if bits else b"AIFC" + chunk(b"FVER", bytes.fromhex("a2805140"))) + chunk(b"COMM", comm) + chunk(b"SSND", bytes(8) + a.data)
    return b"FORM" + struct.pack(">I", len(rest)) + rest


#: Encodings of Sun's format.
AU = {1: "mulaw", 2: "s8", 3: "s16be", 4: "s24be", 5: "s32be", 6: "f32be", 7: "f64be", 27: "alaw"}


def read_au(raw: bytes) -> Audio:
    if raw[:4] != b".snd" or len(raw) < 24:
        raise FormatError("no .snd")
    start, size, kind, rate, channels = struct.unpack_from(">5I", raw, 4)
    if kind not in AU:
        raise FormatError(f"encoding {kind}")
    return Audio(AU[kind], rate, channels, raw[start : None if size == 0xFFFFFFFF else start + size])


def write_au(a: Audio) -> bytes:
    kind = next(k for k, c in AU.items() if c == a.codec)
    return b".snd" + struct.pack(">5I", 32, len(a.data), kind, a.rate, a.channels) + bytes(8) + a.data


def read_caf(raw: bytes) -> Audio:
    if raw[:4] != b"caff":
        raise FormatError("no caff")
    form = None
    for name, body in _chunks(raw, 8, ">", "q", 1):
        if name == b"desc":
            rate, kind, flags, _, _, channels, bits = struct.unpack_from(">d4sIIIII", body)
            codec = {b"alaw": "alaw", b"ulaw": "mulaw"}.get(kind) or (f"{'f' if flags & 1 else 's'}{bits}" + ("" if bits == 8 else "le" if flags & 2 else "be"))
            if codec not in pcm.KINDS:
                raise FormatError(f"CAF type {kind!r}")
            form = (codec, round(rate), channels)
        elif name == b"data" and form:
            return Audio(*form, body[4:])
    raise FormatError("no data chunk")


def write_caf(a: Audio) -> bytes:
    if a.codec[0] == "u":
        raise FormatError("no unsigned samples")
    width = _width(a.codec)
    kind = {"alaw": b"alaw", "mulaw": b"ulaw"}.get(a.codec, b"lpcm")
    flags = (1 if a.codec[0] == "f" else 0) | (2 if a.codec.endswith("le") else 0) if kind == b"lpcm" else 0
    desc = struct.pack(">d4sIIIII", a.rate, kind, flags, width * a.channels, 1, a.channels, 8 * width)
    return b"caff" + struct.pack(">HH", 1, 0) + b"desc" + struct.pack(">q", len(desc)) + desc + b"data" + struct.pack(">q", len(a.data) + 4) + bytes(4) + a.data


#: Codecs of Creative's format.
VOC = {0: "u8", 4: "s16le", 6: "alaw", 7: "mulaw"}


def read_voc(raw: bytes) -> Audio:
    if raw[:20] != b"Creative Voice File\x1a":
        raise FormatError("no Creative Voice File")
    at, form, data = struct.unpack_from("<H", raw, 20)[0], None, b""
    while at + 4 <= len(raw) and raw[at]:
        kind, n = raw[at], int.from_bytes(raw[at + 1 : at + 4], "little")
        body = raw[at + 4 : at + 4 + n]
        if kind == 1:
            form = form or (VOC.get(body[1], "u8"), 1_000_000 // (256 - body[0]), 1)
            data += body[2:]
        elif kind == 9:
            rate, _, channels, codec = struct.unpack_from("<IBBH", body)
            form = (VOC.get(codec, "u8"), rate, channels)
            data += body[12:]
        elif kind == 2:
            data += body
        at += 4 + n
    if form is None:
        raise FormatError("no sound block")
    return Audio(*form, data)


def write_voc(a: Audio) -> bytes:
    codec = next(k for k, c in VOC.items() if c == a.codec)
    out, step = b"Creative Voice File\x1a" + struct.pack("<HHH", 26, 0x0114, 0x1234 + (~0x0114 & 0xFFFF) & 0xFFFF), (1 << 24) - 16
    head = struct.pack("<IBBHI", a.rate, 8 * _width(a.codec), a.channels, codec, 0)
    for at in range(0, max(1, len(a.data)), step):  # a block's length has 24 bits
        body = (head if not at else b"") + a.data[at : at + step]
        out += bytes([2 if at else 9]) + len(body).to_bytes(3, "little") + body
    return out + b"\0"


def read_sox(raw: bytes) -> Audio:
    order = {b".SoX": "<", b"XoS.": ">"}.get(raw[:4])
    if order is None:
        raise FormatError("no .SoX")
    size, _, rate, channels, _ = struct.unpack_from(order + "IQdII", raw, 4)
    return Audio("s32le" if order == "<" else "s32be", round(rate), channels, raw[4 + size :])


def write_sox(a: Audio) -> bytes:
    if a.codec not in ("s32le", "s32be"):
        raise FormatError("32-bit samples only")
    order = "<" if a.codec == "s32le" else ">"
    head = struct.pack(order + "IQdII", 28, len(a.data) // 4, a.rate, a.channels, 0)
    return (b".SoX" if order == "<" else b"XoS.") + head + a.data


#: Encodings of IRCAM's format.
IRCAM = {2: "s16", 4: "f32", 0x40004: "s32", 8: "f64", 0x10001: "alaw", 0x20001: "mulaw", 1: "s8", 3: "s24"}


def read_ircam(raw: bytes) -> Audio:
    order = {b"\x64\xa3\x01\x00": "<", b"\x64\xa3\x03\x00": "<", b"\0\x01\xa3\x64": "<", b"\x64\xa3\x02\x00": ">", b"\x64\xa3\x04\x00": ">", b"\0\x02\xa3\x64": ">"}.get(raw[:4])
    if order is None:
        raise FormatError("no IRCAM")
    rate, channels, kind = struct.unpack_from(order + "fII", raw, 4)
    if kind not in IRCAM:
        raise FormatError(f"encoding {kind}")
    name = IRCAM[kind]
    return Audio(name + (("le" if order == "<" else "be") if name[-2:] in ("16", "24", "32", "64") else ""), round(rate), channels, raw[1024:])


def write_ircam(a: Audio) -> bytes:
    order = ">" if a.codec.endswith("be") else "<"
    kind = next(k for k, c in IRCAM.items() if c == a.codec.removesuffix("le").removesuffix("be"))
    return ((b"\x64\xa3\x03\x00" if order == "<" else b"\x64\xa3\x02\x00") + struct.pack(order + "fII", a.rate, a.channels, kind)).ljust(1024, b"\0") + a.data


def read_rso(raw: bytes) -> Audio:
    kind, size, rate, _ = struct.unpack_from(">4H", raw)
    if kind != 0x0100:
        raise FormatError("no RSO of 8-bit samples")
    return Audio("u8", rate, 1, raw[8 : 8 + size] if size else raw[8:])


def write_rso(a: Audio) -> bytes:
    if a.codec != "u8" or a.channels != 1:
        raise FormatError("8-bit samples of one channel only")
    return struct.pack(">4H", 0x0100, min(0xFFFF, len(a.data)) if len(a.data) <= 0xFFFF else 0, a.rate, 0) + a.data


#: name: (what a file starts with, reader, writer). Raw samples have no start.
FORMATS: dict[str, tuple[tuple[bytes, ...], Callable[[bytes], Audio], Callable[[Audio], bytes]]] = {
    "wav": ((b"RIFF", b"RF64"), read_wav, write_wav), "w64": ((b"riff" + W64_RIFF,), read_w64, write_w64), "aiff": ((b"FORM",), read_aiff, write_aiff), "au": ((b".snd",), read_au, write_au),
    "caf": ((b"caff",), read_caf, write_caf), "voc": ((b"Creative Voice File\x1a",), read_voc, write_voc), "sox": ((b".SoX", b"XoS."), read_sox, write_sox),
    "ircam": ((b"\x64\xa3", b"\0\x01\xa3\x64", b"\0\x02\xa3\x64"), read_ircam, write_ircam), "rso": ((b"\x01\0",), read_rso, write_rso),
}
for _kind in pcm.KINDS:  # raw samples: one channel at 44.1 kHz, if nothing else is said
    FORMATS[_kind] = ((), lambda raw, k=_kind: Audio(k, 44_100, 1, raw), lambda a: a.data)
FORMATS["sln"] = ((), lambda raw: Audio("s16le", 8000, 1, raw), lambda a: a.data)


def detect(raw: bytes) -> str | None:
    """The format whose start a file has; the longest one if several fit."""
    found = [(len(m), name) for name, (magics, _, _) in FORMATS.items() for m in magics if raw.startswith(m)]
    return max(found)[1] if found else None


SCHEMA = "format string, codec string, rate int, channels int, payload binary, error string"


def demux(files: DataFrame, format: str = "auto", column: str = "content") -> DataFrame:
    """Adds format, codec, rate, channels and payload of each file's bytes; ``error`` says what is wrong with one that can't be read."""

    def one(raw: bytes) -> tuple:
        raw = bytes(raw)
        name = detect(raw) if format == "auto" else format
        if name is None:
            return (None, None, None, None, None, "no known format")
        try:
            a = FORMATS[name][1](raw)
            return (name, a.codec, a.rate, a.channels, a.data, None)
        except (FormatError, struct.error, IndexError) as e:
            return (name, None, None, None, None, str(e))

    return payload.each(files, one, [column], SCHEMA)


def mux(frames: DataFrame, format: str) -> DataFrame:
    """Adds ``content``, the file of each row's codec, rate, channels and payload."""
    return payload.each(frames, lambda data, codec, rate, channels: (FORMATS[format][2](Audio(codec, rate, channels, bytes(data))),), ["payload", "codec", "rate", "channels"], "content binary")


def read(spark: SparkSession, path: str, format: str = "auto") -> DataFrame:
    """(path, format, codec, rate, channels, payload, error): a row for each file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return demux(files, format).drop("content")


def samples(streams: DataFrame) -> DataFrame:
    """Adds ``samples``: an array for each channel, of the payload of any codec that is handled."""

    def one(data: bytes, codec: str, channels: int) -> tuple:
        if codec in pcm.ADPCM:
            return ([[x / 32768 for x in pcm.ADPCM[codec](bytes(data))]],)
        x = pcm.decode(bytes(data), codec)
        return (x[: len(x) // channels * channels].reshape(-1, channels).T.tolist(),)

    return payload.each(streams.filter(F.col("codec").isNotNull()), one, ["payload", "codec", "channels"], "samples array<array<double>>")
