"""Elementary streams: bytes of a whole file framed into packets, with what each frame's header says.

A parser takes the bytes and yields (offset, size, key, header): ``header`` maps names to text. Bytes before the first frame, and what can't be
read, are passed over; a frame that is cut short at the end is left out.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bitstream import nal_type, split_obus
from . import images, payload

Unit = tuple[int, int, bool, dict[str, str]]

#: Sample rates by index of AAC; bit rates (kbit/s) and sample rates of MPEG audio, the latter halved for each later version.
AAC_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
MPEG_BITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_RATES = (44100, 48000, 32000)
#: Bit rates (kbit/s) of AC-3, two codes each.
AC3_BITS = (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640)


def parse_aac(raw: bytes) -> Iterator[Unit]:
    """ADTS frames."""
    at = 0
    while at + 7 <= len(raw):
        if raw[at] != 0xFF or raw[at + 1] & 0xF6 != 0xF0:
            at += 1
            continue
        n = (raw[at + 3] & 3) << 11 | raw[at + 4] << 3 | raw[at + 5] >> 5
        rate = raw[at + 2] >> 2 & 15
        if n < 7 or rate >= len(AAC_RATES):
            at += 1
            continue
        if at + n > len(raw):
            break
        yield at, n, True, {"rate": str(AAC_RATES[rate]), "channels": str((raw[at + 2] & 1) << 2 | raw[at + 3] >> 6), "profile": str(raw[at + 2] >> 6)}
        at += n


def parse_latm(raw: bytes) -> Iterator[Unit]:
    """LOAS: eleven bits of sync, thirteen of length."""
    at = 0
    while at + 3 <= len(raw):
        if raw[at] != 0x56 or raw[at + 1] & 0xE0 != 0xE0:
            at += 1
            continue
        n = 3 + ((raw[at + 1] & 31) << 8 | raw[at + 2])
        if at + n > len(raw):
            break
        yield at, n, True, {}
        at += n


def mpeg_audio_header(raw: bytes, at: int) -> tuple[int, dict[str, str]] | None:
    """(frame size, header) of layers 1 to 3, or None."""
    if at + 4 > len(raw) or raw[at] != 0xFF or raw[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer = {3: 1, 2: 2, 0: 3}.get(raw[at + 1] >> 3 & 3), 4 - (raw[at + 1] >> 1 & 3)
    bits, rate, pad = raw[at + 2] >> 4, raw[at + 2] >> 2 & 3, raw[at + 2] >> 1 & 1
    if version is None or layer == 4 or rate == 3 or bits in (0, 15):
        return None
    kbits = MPEG_BITS[(1, layer) if version == 1 else (2, 1 if layer == 1 else 2)][bits]
    hz = MPEG_RATES[rate] >> version - 1
    size = (12 * kbits * 1000 // hz + pad) * 4 if layer == 1 else (72 if layer == 3 and version > 1 else 144) * kbits * 1000 // hz + pad
    return size, {"layer": str(layer), "rate": str(hz), "bit_rate": str(kbits * 1000), "channels": "1" if raw[at + 3] >> 6 == 3 else "2"}


def parse_mp3(raw: bytes) -> Iterator[Unit]:
    """Frames of MPEG audio; an ID3 tag in front is passed over, and a header counts only if another one follows its frame, or the end."""
    at = 0
    if raw[:3] == b"ID3" and len(raw) >= 10:
        at = 10 + sum((raw[6 + k] & 127) << 7 * (3 - k) for k in range(4))
    while at + 4 <= len(raw):
        found = mpeg_audio_header(raw, at)
        if not found or at + found[0] > len(raw) or at + found[0] + 4 <= len(raw) and not mpeg_audio_header(raw, at + found[0]) and raw[at + found[0] : at + found[0] + 3] != b"TAG":
            at += 1
            continue
        yield at, found[0], True, found[1]
        at += found[0]


def parse_ac3(raw: bytes) -> Iterator[Unit]:
    """Frames of AC-3 (stream ids up to 10) and E-AC-3 (11 to 16)."""
    at = 0
    while at + 6 <= len(raw):
        if raw[at : at + 2] != b"\x0b\x77":
            at += 1
            continue
        kind = raw[at + 5] >> 3
        if kind > 10:
            n, rate = (((raw[at + 2] & 7) << 8 | raw[at + 3]) + 1) * 2, raw[at + 4] >> 6
            head = {"codec": "eac3"}
        else:
            rate, code = raw[at + 4] >> 6, raw[at + 4] & 63
            if rate == 3 or code >= 2 * len(AC3_BITS):
                at += 1
                continue
            kbits = AC3_BITS[code >> 1]
            n = 2 * (kbits * 1536 // (8 * 2 * (48, 44.1, 32)[rate]) if rate != 1 else kbits * 96_000 // 44_100 + (code & 1))
            head = {"codec": "ac3", "bit_rate": str(kbits * 1000)}
        n = int(n)
        if at + n > len(raw):
            break
        yield at, n, True, head | ({"rate": str((48000, 44100, 32000)[rate])} if rate < 3 else {})
        at += n


def _starts(raw: bytes) -> list[int]:
    """Where units behind start codes begin."""
    return [m.end() for m in re.finditer(rb"\x00\x00\x01", raw)]


def _pictures(raw: bytes, first: Callable[[int, bytes], bool], opens: Callable[[int], bool], key: Callable[[int], bool], kind: Callable[[bytes], int]) -> Iterator[Unit]:
    """Access units: a new one begins at a unit that opens one, or at a picture's first unit after another picture."""
    marks = _starts(raw)
    start, seen, is_key, kinds = None, False, False, []
    for at in marks:
        unit = raw[at : at + 8]
        if not unit:
            continue
        k = kind(unit)
        picture = first(k, unit)
        if start is not None and seen and (picture or opens(k)):
            end = _code(raw, at)
            yield start, end - start, is_key, {"units": " ".join(map(str, kinds))}
            start, seen, is_key, kinds = end, False, False, []
        start = _code(raw, at) if start is None else start
        seen, is_key = seen or picture, is_key or key(k)
        kinds.append(k)
    if start is not None and seen:
        yield start, len(raw) - start, is_key, {"units": " ".join(map(str, kinds))}


def _code(raw: bytes, at: int) -> int:
    """Where the start code of the unit at ``at`` begins; a fourth byte of zero belongs to it."""
    return at - 4 if at >= 4 and raw[at - 4] == 0 else at - 3


def parse_h264(raw: bytes) -> Iterator[Unit]:
    return _pictures(raw, lambda k, u: k in (1, 5) and len(u) > 1 and bool(u[1] & 0x80), lambda k: k in (6, 7, 8, 9), lambda k: k == 5, lambda u: nal_type(u, "h264"))


def parse_hevc(raw: bytes) -> Iterator[Unit]:
    return _pictures(raw, lambda k, u: k < 32 and len(u) > 2 and bool(u[2] & 0x80), lambda k: k in (32, 33, 34, 35, 39), lambda k: 16 <= k <= 23, lambda u: nal_type(u, "hevc"))


def parse_mpeg_video(raw: bytes) -> Iterator[Unit]:
    """MPEG-1 and 2: a picture (0), with the sequence (0xB3) and group (0xB8) headers before it; intra pictures are key."""
    for at, n, _, head in _pictures(raw, lambda k, u: k == 0, lambda k: k in (0xB3, 0xB8), lambda k: False, lambda u: u[0]):
        p = raw.find(b"\0\0\1\0", at, at + n)
        kind = raw[p + 5] >> 3 & 7 if p >= 0 and p + 5 < len(raw) else 0
        yield at, n, kind == 1, head | {"picture": {1: "I", 2: "P", 3: "B"}.get(kind, "?")}


def parse_mpeg4(raw: bytes) -> Iterator[Unit]:
    """Part 2: a video object plane (0xB6), with the headers before it."""
    for at, n, _, head in _pictures(raw, lambda k, u: k == 0xB6, lambda k: k in (0xB0, 0xB3) or k < 0x30, lambda k: False, lambda u: u[0]):
        p = raw.find(b"\0\0\1\xb6", at, at + n)
        kind = raw[p + 4] >> 6 if p >= 0 and p + 4 < len(raw) else 3
        yield at, n, kind == 0, head | {"picture": "IPBS"[kind]}


def parse_av1(raw: bytes) -> Iterator[Unit]:
    """Temporal units: from one delimiter (type 2) to the next; key with a sequence header (type 1)."""
    at, start, kinds = 0, None, []
    for kind, unit in split_obus(raw):
        if kind == 2:
            if start is not None:
                yield start, at - start, 1 in kinds, {"units": " ".join(map(str, kinds))}
            start, kinds = at, []
        if start is not None:
            kinds.append(kind)
        at += len(unit)
    if start is not None:
        yield start, at - start, 1 in kinds, {"units": " ".join(map(str, kinds))}


def parse_flac(raw: bytes) -> Iterator[Unit]:
    """Frames, by their sync code and the checksum of their header; the blocks before the first one give the rate and channels."""
    head, at = {}, 0
    if raw[:4] == b"fLaC":
        at, last = 4, False
        while not last and at + 4 <= len(raw):
            last, kind, n = bool(raw[at] & 128), raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
            if kind == 0 and n >= 18:
                bits = int.from_bytes(raw[at + 14 : at + 22], "big")
                head = {"rate": str(bits >> 44), "channels": str((bits >> 41 & 7) + 1), "bits": str((bits >> 36 & 31) + 1)}
            at += 4 + n
    marks = [m.start() for m in re.finditer(rb"\xff[\xf8\xf9]", raw[at:]) if _flac_header(raw, at + m.start())]
    for a, b in zip(marks, [*marks[1:], len(raw) - at], strict=False):
        yield at + a, b - a, True, head


def _flac_header(raw: bytes, at: int) -> bool:
    if at + 6 > len(raw) or raw[at + 2] >> 4 == 0 or raw[at + 2] & 15 == 15 or raw[at + 3] >> 4 > 10 or raw[at + 3] & 1:
        return False
    n = 5
    lead = raw[at + 4]
    while lead & 0x80 and n < 12:
        lead = lead << 1 & 255
        n += 1 if lead & 0x80 else 0
    n += {6: 1, 7: 2}.get(raw[at + 2] >> 4, 0) + {12: 1, 13: 2, 14: 2}.get(raw[at + 2] & 15, 0)
    if at + n >= len(raw):
        return False
    crc = 0
    for b in raw[at : at + n]:
        crc ^= b
        for _ in range(8):
            crc = crc << 1 ^ 0x07 if crc & 128 else crc << 1
        crc &= 255
    return crc == raw[at + n]


def parse_mjpeg(raw: bytes) -> Iterator[Unit]:
    """Pictures from start to end marker; the frame header gives the size."""
    at = raw.find(b"\xff\xd8\xff")
    while at >= 0:
        p, head = at + 2, {}
        while p + 4 <= len(raw) and raw[p] == 0xFF and raw[p + 1] != 0xDA:
            n = struct.unpack_from(">H", raw, p + 2)[0]
            if raw[p + 1] in (0xC0, 0xC1, 0xC2, 0xF7) and p + 9 <= len(raw):
                h, w = struct.unpack_from(">HH", raw, p + 5)
                head = {"width": str(w), "height": str(h)}
            p += 2 + n
        end = raw.find(b"\xff\xd9", p)
        if end < 0:
            break
        yield at, end + 2 - at, True, head
        at = raw.find(b"\xff\xd8\xff", end + 2)


def parse_vp8(raw: bytes) -> Iterator[Unit]:
    """One frame: a packet of a container."""
    if len(raw) >= 3:
        key = not raw[0] & 1
        size = {"width": str(struct.unpack_from("<H", raw, 6)[0] & 0x3FFF), "height": str(struct.unpack_from("<H", raw, 8)[0] & 0x3FFF)} if key and len(raw) >= 10 and raw[3:6] == b"\x9d\x01\x2a" else {}
        yield 0, len(raw), key, {"shown": str(raw[0] >> 4 & 1)} | size


def parse_opus(raw: bytes) -> Iterator[Unit]:
    """One packet: its configuration, channels and length in samples at 48 kHz."""
    if raw:
        config, count = raw[0] >> 3, {0: 1, 1: 2, 2: 2}.get(raw[0] & 3, raw[1] & 63 if len(raw) > 1 else 0)
        size = (480, 960, 1920, 2880)[config & 3] if config < 12 else (480, 960)[config & 1] if config < 16 else (120, 240, 480, 960)[config & 3]
        yield 0, len(raw), True, {"config": str(config), "channels": str(1 + (raw[0] >> 2 & 1)), "samples": str(size * count)}


def _sized(name: str, mark: bytes, read: Callable[[bytes], dict[str, str] | None]) -> Callable[[bytes], Iterator[Unit]]:
    """Whole files that start with ``mark``; headers give the size."""

    def run(raw: bytes) -> Iterator[Unit]:
        if raw.startswith(mark) and (head := read(raw)) is not None:
            yield 0, len(raw), True, head

    return run


def _picture_parser(name: str) -> Callable[[bytes], Iterator[Unit]]:
    def run(raw: bytes) -> Iterator[Unit]:
        try:
            w, h = images.FORMATS[name][1](raw).size
        except Exception:  # noqa: BLE001 - whatever a broken picture makes of its reader
            return
        yield 0, len(raw), True, {"width": str(w), "height": str(h)}

    return run


def _tiff(raw: bytes) -> dict[str, str] | None:
    """The first directory's width, height and compression."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(raw[:4])
    if order is None:
        return None
    at = struct.unpack_from(order + "I", raw, 4)[0]
    out = {}
    for k in range(struct.unpack_from(order + "H", raw, at)[0] if at + 2 <= len(raw) else 0):
        if at + 14 + 12 * k > len(raw):
            break
        tag, kind, _ = struct.unpack_from(order + "HHI", raw, at + 2 + 12 * k)
        value = struct.unpack_from(order + ("H" if kind == 3 else "I"), raw, at + 10 + 12 * k)[0]
        if tag in (256, 257, 259):
            out[{256: "width", 257: "height", 259: "compression"}[tag]] = str(value)
    return out


def parse_tiff(raw: bytes) -> Iterator[Unit]:
    head = _tiff(raw) if len(raw) >= 8 else None
    if head is not None:
        yield 0, len(raw), True, head


def parse_webp(raw: bytes) -> Iterator[Unit]:
    if raw[:4] == b"RIFF" and raw[8:12] == b"WEBP" and len(raw) >= 30:
        n, kind = struct.unpack_from("<I", raw, 4)[0] + 8, raw[12:16]
        if kind == b"VP8X":
            size = (int.from_bytes(raw[24:27], "little") + 1, int.from_bytes(raw[27:30], "little") + 1)
        elif kind == b"VP8L":
            bits = int.from_bytes(raw[21:25], "little")
            size = ((bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
        else:
            size = tuple(x & 0x3FFF for x in struct.unpack_from("<HH", raw, 26))
        yield 0, min(n, len(raw)), True, {"width": str(size[0]), "height": str(size[1])}


def parse_prores(raw: bytes) -> Iterator[Unit]:
    """One frame: its size, ``icpf``, and the header."""
    if raw[4:8] == b"icpf" and len(raw) >= 20:
        yield 0, min(len(raw), struct.unpack_from(">I", raw)[0]), True, {"width": str(struct.unpack_from(">H", raw, 16)[0]), "height": str(struct.unpack_from(">H", raw, 18)[0]), "creator": raw[12:16].decode("latin-1")}


def parse_vp9(raw: bytes) -> Iterator[Unit]:
    """The frames of a superframe, or one frame; key by its type bit."""
    from ..operators.bitstream import split_superframe, vp9_visible

    at = 0
    for f in split_superframe(raw):
        if f:
            profile3 = f[0] >> 4 & 3 == 3
            yield at, len(f), f[0] >> 6 == 2 and not f[0] >> (1 if profile3 else 2) & 1, {"shown": str(int(vp9_visible(f)))}
        at += len(f)


PARSERS: dict[str, Callable[[bytes], Iterator[Unit]]] = {
    "aac": parse_aac, "aac_latm": parse_latm, "mp3": parse_mp3, "ac3": parse_ac3, "eac3": parse_ac3, "h264": parse_h264, "hevc": parse_hevc, "mpeg1video": parse_mpeg_video, "mpeg2video": parse_mpeg_video,
    "mpeg4": parse_mpeg4, "av1": parse_av1, "flac": parse_flac, "mjpeg": parse_mjpeg, "jpegls": parse_mjpeg, "vp8": parse_vp8, "vp9": parse_vp9, "opus": parse_opus, "tiff": parse_tiff, "webp": parse_webp,
    "prores": parse_prores, "exr": _sized("exr", b"\x76\x2f\x31\x01", lambda raw: {"version": str(raw[4])}),
} | {k: _picture_parser(k) for k in images.FORMATS}


def frame(files: DataFrame, codec: str, column: str = "content") -> DataFrame:
    """A row for each frame: n, pos, key, header (a map) and payload."""

    def units(raw: bytes) -> Iterator[tuple]:
        raw = bytes(raw)
        for n, (at, size, key, head) in enumerate(PARSERS[codec](raw)):
            yield n, at, key, list(head.items()), raw[at : at + size]

    return payload.rows(files, units, [column], "n int, pos long, key boolean, header map<string,string>, payload binary").drop(column)


# Files of frames


def read_y4m(raw: bytes) -> Iterator[Unit]:
    """A header line, then ``FRAME`` lines, each before the planes of a picture."""
    end = raw.find(b"\n")
    if not raw.startswith(b"YUV4MPEG2") or end < 0:
        return
    values = {x[:1]: x[1:] for x in raw[:end].decode("ascii", "replace").split()[1:]}
    w, h, form = int(values.get("W", 0)), int(values.get("H", 0)), values.get("C", "420")
    half = lambda x: -(-x // 2)
    chroma = {"420": half(w) * half(h), "422": half(w) * h, "444": w * h, "mono": 0, "411": -(-w // 4) * h}.get(re.match(r"mono|\d{3}", form)[0], half(w) * half(h))
    size, at = w * h + 2 * chroma, end + 1
    while raw.startswith(b"FRAME", at):
        at = raw.find(b"\n", at) + 1
        if not at or at + size > len(raw):
            return
        yield at, size, True, {"width": str(w), "height": str(h), "format": form, "rate": values.get("F", "25:1")}
        at += size


def write_y4m(frames: list[bytes], w: int, h: int, rate: str = "25:1", form: str = "420") -> bytes:
    return f"YUV4MPEG2 W{w} H{h} F{rate} Ip A1:1 C{form}\n".encode() + b"".join(b"FRAME\n" + f for f in frames)


def read_ivf(raw: bytes) -> Iterator[Unit]:
    if raw[:4] != b"DKIF":
        return
    at = struct.unpack_from("<H", raw, 6)[0]
    head = {"codec": raw[8:12].decode("latin-1"), "width": str(struct.unpack_from("<H", raw, 12)[0]), "height": str(struct.unpack_from("<H", raw, 14)[0])}
    while at + 12 <= len(raw):
        n, pts = struct.unpack_from("<IQ", raw, at)
        if at + 12 + n > len(raw):
            return
        yield at + 12, n, True, head | {"pts": str(pts)}
        at += 12 + n


def write_ivf(frames: list[tuple[int, bytes]], codec: str, w: int, h: int, rate: int = 25) -> bytes:
    head = b"DKIF" + struct.pack("<HH4sHHIIII", 0, 32, codec.encode(), w, h, rate, 1, len(frames), 0)
    return head + b"".join(struct.pack("<IQ", len(f), pts) + f for pts, f in frames)


def rawvideo(files: DataFrame, w: int, h: int, bytes_per_frame: int, column: str = "content") -> DataFrame:
    """Pictures of a fixed size without any header; an incomplete one at the end is left out."""

    def units(raw: bytes) -> Iterator[tuple]:
        for n, at in enumerate(range(0, len(raw) - bytes_per_frame + 1, bytes_per_frame)):
            yield n, at, bytes(raw[at : at + bytes_per_frame])

    return payload.rows(files, units, [column], "n int, pos long, payload binary").drop(column).withColumns({"w": F.lit(w), "h": F.lit(h)})


PARSERS |= {"yuv4mpegpipe": read_y4m, "ivf": read_ivf}


def read_mpjpeg(raw: bytes) -> Iterator[Unit]:
    """Parts of a multipart body; a length in a part's head counts, else the next boundary."""
    for m in re.finditer(rb"--[^\r\n]+\r?\n((?:[^\r\n]+\r?\n)*)\r?\n", raw):
        n = re.search(rb"(?i)content-length:\s*(\d+)", m[1])
        end = m.end() + int(n[1]) if n else (raw.find(b"\r\n--", m.end()) if raw.find(b"\r\n--", m.end()) >= 0 else len(raw))
        yield m.end(), end - m.end(), True, {}


PARSERS["mpjpeg"] = read_mpjpeg


def read_ffmetadata(text: str) -> tuple[dict[str, str], list[dict[str, str]]]:
    """(tags, sections): ``key=value`` lines, with backslashes before ``=;#\\`` and line ends; sections carry their name as ``_section``."""
    joined = re.sub(r"\\\n", "\\\\n", text.replace("\r\n", "\n"))
    tags: dict[str, str] = {}
    sections: list[dict[str, str]] = []
    now = tags
    plain = lambda x: re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], x)
    for line in joined.split("\n")[1 if joined.startswith(";FFMETADATA") else 0 :]:
        if not line or line[0] in ";#":
            continue
        if m := re.fullmatch(r"\[(\w+)\]\s*", line):
            now = {"_section": m[1]}
            sections.append(now)
        elif m := re.match(r"((?:[^\\=]|\\.)*)=(.*)", line):
            now[plain(m[1])] = plain(m[2])
    return tags, sections


def write_ffmetadata(tags: dict[str, str], sections: list[dict[str, str]] = ()) -> str:
    safe = lambda x: re.sub(r"([=;#\\\n])", lambda m: "\\" + m[1], x)
    lines = lambda d: "".join(f"{safe(k)}={safe(v)}\n" for k, v in d.items() if k != "_section")
    return ";FFMETADATA1\n" + lines(tags) + "".join(f"[{s['_section']}]\n" + lines(s) for s in sections)


def concat_script(text: str) -> list[dict[str, str]]:
    """Entries of a list of files: ``file`` and what follows it (duration, inpoint, outpoint, metadata)."""
    import shlex

    out: list[dict[str, str]] = []
    for line in text.splitlines():
        parts = shlex.split(line, comments=True)
        if not parts:
            continue
        if parts[0] == "file":
            out.append({"file": " ".join(parts[1:])})
        elif out:
            out[-1][parts[0]] = " ".join(parts[1:])
    return out


def sequence(pattern: str, names: list[str], start: int = 0, gap: int = 5) -> list[str]:
    """Files that a pattern with ``%d`` or ``%0Nd`` stands for, from the first number that is there within ``gap`` of ``start``, as long as they follow."""
    known = set(names)
    at = next((k for k in range(start, start + gap) if pattern % k in known), None)
    out: list[str] = []
    while at is not None and pattern % at in known:
        out.append(pattern % at)
        at += 1
    return out


def read(spark: SparkSession, path: str, codec: str) -> DataFrame:
    """(path, n, pos, key, header, payload): the frames of each file, a file being one task's."""
    return frame(spark.read.format("binaryFile").load(path).select("path", "content"), codec)
