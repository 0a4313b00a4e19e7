"""Containers of several streams, framed into packets: AVI, FLV, Ogg, MP4, Matroska and MPEG-TS; the first four and Matroska are also written.

A reader takes the bytes of a file and yields packets; time stamps are milliseconds, or None. What is cut short at the end is left out. Payloads stay
as they are: nothing is decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import payload


@dataclass(frozen=True)
class Track:
    """kind: video, audio or subtitle. codec: what the container calls it. rate: of audio samples or pictures, a second."""

    kind: str
    codec: str
    rate: float = 0.0
    width: int = 0
    height: int = 0
    channels: int = 0


@dataclass(frozen=True)
class Packet:
    stream: int
    pts: int | None
    key: bool
    data: bytes
    track: Track | None = None


# AVI


def _riff(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of chunks."""
    while at + 8 <= end:
        n = struct.unpack_from("<I", raw, at + 4)[0]
        yield raw[at : at + 4], at + 8, min(end, at + 8 + n)
        at += 8 + n + n % 2


def read_avi(raw: bytes) -> Iterator[Packet]:
    """The index says which packets are key; without one all are."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        return
    tracks: list[Track] = []
    scales: list[tuple[int, int, int]] = []  # ticks: scale, rate, and bytes of a sample
    movi, flags = None, {}
    for name, a, b in _riff(raw, 12, len(raw)):
        if name == b"LIST" and raw[a : a + 4] == b"hdrl":
            for inner, c, d in _riff(raw, a + 4, b):
                if inner == b"LIST" and raw[c : c + 4] == b"strl":
                    parts = {n: (e, f) for n, e, f in _riff(raw, c + 4, d)}
                    e = parts[b"strh"][0]
                    kind, codec = raw[e : e + 4], raw[e + 4 : e + 8].decode("latin-1")
                    scale, rate = struct.unpack_from("<II", raw, e + 20)
                    size = struct.unpack_from("<I", raw, e + 44)[0]
                    g = parts[b"strf"][0]
                    if kind == b"vids":
                        w, h = struct.unpack_from("<ii", raw, g + 4)
                        tracks.append(Track("video", codec.strip("\0 ") or raw[g + 16 : g + 20].decode("latin-1"), rate / max(1, scale), w, abs(h)))
                    else:
                        tag, channels, hz = struct.unpack_from("<HHI", raw, g)
                        tracks.append(Track("audio" if kind == b"auds" else "subtitle", f"{tag:#06x}", hz, channels=channels))
                    scales.append((max(1, scale), max(1, rate), size))
        elif name == b"LIST" and raw[a : a + 4] == b"movi":
            movi = (a, b)
        elif name == b"idx1" and movi:
            for k in range((b - a) // 16):
                _, flag, offset, _ = struct.unpack_from("<4sIII", raw, a + 16 * k)
                flags[movi[0] + offset] = bool(flag & 16)
    if not movi:
        return
    done = [0] * len(tracks)
    for name, a, b in _riff(raw, movi[0] + 4, movi[1]):
        if not name[:2].isdigit() or int(name[:2]) >= len(tracks):
            continue
        k = int(name[:2])
        scale, rate, size = scales[k]
        yield Packet(k, done[k] * scale * 1000 // rate, flags.get(a - 8, not flags), raw[a:b], tracks[k])
        done[k] += (b - a) // size if size else 1


def write_avi(tracks: list[Track], packets: Iterable[Packet]) -> bytes:
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    held = list(packets)
    lists = b""
    for k, t in enumerate(tracks):
        video = t.kind == "video"
        size = 0 if video else 1
        rate, scale = (round(t.rate * 1000), 1000) if video else (round(t.rate), 1)
        count = sum(1 if video else len(p.data) for p in held if p.stream == k)
        head = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids" if video else b"auds", t.codec.encode("latin-1")[:4].ljust(4, b"\0") if video else bytes(4), 0, 0, 0, 0, scale, rate, 0, count, 0, 0xFFFFFFFF, size, 0, 0, t.width, t.height)
        form = struct.pack("<IiiHH4sIiiII", 40, t.width, t.height, 1, 24, t.codec.encode("latin-1")[:4].ljust(4, b"\0"), 0, 0, 0, 0, 0) if video else struct.pack("<HHIIHH", int(t.codec, 16), t.channels, round(t.rate), round(t.rate), 1, 8)
        lists += chunk(b"LIST", b"strl" + chunk(b"strh", head) + chunk(b"strf", form))
    main = struct.pack("<14I", 0, 0, 0, 16, 0, 0, len(tracks), 0, max((t.width for t in tracks), default=0), max((t.height for t in tracks), default=0), 0, 0, 0, 0)
    body, index = b"movi", b""
    for p in held:
        name = f"{p.stream:02d}".encode() + (b"dc" if tracks[p.stream].kind == "video" else b"wb")
        index += struct.pack("<4sIII", name, 16 if p.key else 0, len(body), len(p.data))
        body += chunk(name, p.data)
    rest = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + lists) + chunk(b"LIST", body) + chunk(b"idx1", index)
    return b"RIFF" + struct.pack("<I", len(rest)) + rest


# FLV

#: Codec numbers.
FLV_VIDEO = {2: "flv1", 3: "screen", 4: "vp6f", 5: "vp6a", 7: "h264", 12: "hevc"}
FLV_AUDIO = {0: "pcm", 1: "adpcm_swf", 2: "mp3", 3: "pcm_s16le", 5: "nellymoser", 7: "alaw", 8: "mulaw", 10: "aac", 11: "speex"}


def read_flv(raw: bytes) -> Iterator[Packet]:
    """Stream 0 is video, 1 audio, 2 data. Heads of AVC and AAC packets (configuration or frame) are taken off, configurations left out."""
    if raw[:3] != b"FLV" or len(raw) < 9:
        return
    at = struct.unpack_from(">I", raw, 5)[0] + 4
    while at + 11 <= len(raw):
        kind, n = raw[at] & 31, int.from_bytes(raw[at + 1 : at + 4], "big")
        pts = int.from_bytes(raw[at + 4 : at + 7], "big") | raw[at + 7] << 24
        body = raw[at + 11 : at + 11 + n]
        at += 15 + n
        if len(body) < n:
            return
        if kind == 9 and body:
            codec, key, skip = FLV_VIDEO.get(body[0] & 15, str(body[0] & 15)), body[0] >> 4 == 1, 1
            if codec in ("h264", "hevc"):
                if len(body) < 5 or body[1] != 1:
                    continue
                pts += int.from_bytes(body[2:5], "big", signed=True)
                skip = 5
            yield Packet(0, pts, key, body[skip:], Track("video", codec))
        elif kind == 8 and body:
            codec, skip = FLV_AUDIO.get(body[0] >> 4, str(body[0] >> 4)), 1
            if codec == "aac":
                if len(body) < 2 or body[1] != 1:
                    continue
                skip = 2
            yield Packet(1, pts, True, body[skip:], Track("audio", codec, 5512.5 * 2 ** (body[0] >> 2 & 3), channels=1 + (body[0] & 1)))
        elif kind == 18:
            yield Packet(2, pts, True, body, Track("subtitle", "script"))


def write_flv(tracks: list[Track], packets: Iterable[Packet]) -> bytes:
    kinds = {t.kind for t in tracks}
    out = bytearray(b"FLV\1" + bytes([("audio" in kinds) * 4 | ("video" in kinds)]) + struct.pack(">II", 9, 0))
    for p in packets:
        t = tracks[p.stream]
        if t.kind == "video":
            code = next(k for k, c in FLV_VIDEO.items() if c == t.codec)
            head, kind = bytes([(1 if p.key else 2) << 4 | code]) + (b"\1\0\0\0" if t.codec in ("h264", "hevc") else b""), 9
        else:
            code = next(k for k, c in FLV_AUDIO.items() if c == t.codec)
            rate = max(0, min(3, round(t.rate / 5512.5).bit_length() - 1))
            head, kind = bytes([code << 4 | rate << 2 | 2 | (t.channels > 1)]) + (b"\1" if t.codec == "aac" else b""), 8
        body, pts = head + p.data, p.pts or 0
        out += bytes([kind]) + len(body).to_bytes(3, "big") + (pts & 0xFFFFFF).to_bytes(3, "big") + bytes([pts >> 24 & 255, 0, 0, 0]) + body + struct.pack(">I", 11 + len(body))
    return bytes(out)


# Ogg


def _ogg_crc(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = (crc << 8 ^ _OGG[crc >> 24 & 255 ^ b]) & 0xFFFFFFFF
    return crc


def _ogg_table() -> list[int]:
    out = []
    for k in range(256):
        x = k << 24
        for _ in range(8):
            x = (x << 1 ^ 0x04C11DB7 if x & 0x80000000 else x << 1) & 0xFFFFFFFF
        out.append(x)
    return out


_OGG = _ogg_table()
#: How a stream's first packet starts, and what it holds.
OGG_STARTS = ((b"\x01vorbis", "vorbis"), (b"OpusHead", "opus"), (b"\x7fFLAC", "flac"), (b"Speex   ", "speex"), (b"\x80theora", "theora"), (b"BBCD\0", "dirac"))


def read_ogg(raw: bytes) -> Iterator[Packet]:
    """Packets over pages, by serial numbers; pts is the granule (as it is) where a page ends with the packet. A page that doesn't fit its checksum is passed over."""
    at, held, order, codec = 0, {}, {}, {}
    while (at := raw.find(b"OggS", at)) >= 0 and at + 27 <= len(raw):
        flags, granule, serial, crc, count = raw[at + 5], *struct.unpack_from("<qI", raw, at + 6), struct.unpack_from("<I", raw, at + 22)[0], raw[at + 26]
        table = raw[at + 27 : at + 27 + count]
        start = at + 27 + count
        end = start + sum(table)
        if end > len(raw):
            return
        if _ogg_crc(raw[at : at + 22] + bytes(4) + raw[at + 26 : end]) != crc:
            at += 4
            continue
        stream = order.setdefault(serial, len(order))
        if not flags & 1:
            held[serial] = b""
        last = max((k for k, n in enumerate(table) if n < 255), default=-1)
        for k, n in enumerate(table):
            held[serial] = held.get(serial, b"") + raw[start : start + n]
            start += n
            if n < 255:
                data, held[serial] = held[serial], b""
                codec.setdefault(serial, next((c for s, c in OGG_STARTS if data.startswith(s)), "unknown"))
                yield Packet(stream, granule if k == last and granule >= 0 else None, True, data, Track("video" if codec[serial] in ("theora", "dirac") else "audio", codec[serial]))
        at = end


def write_ogg(packets: Iterable[Packet], serial: int = 1) -> bytes:
    """One stream, a page for each packet or more."""
    out, held, number = bytearray(), list(packets), 0
    for index, p in enumerate(held):
        table = [255] * (len(p.data) // 255) + [len(p.data) % 255]
        for at in range(0, len(table), 255):
            part = bytes(table[at : at + 255])
            body = p.data[255 * at : 255 * at + sum(part)]
            final = at + 255 >= len(table)
            flags = (1 if at else 0) | (2 if not number else 0) | (4 if final and index + 1 == len(held) else 0)
            head = b"OggS\0" + bytes([flags]) + struct.pack("<qII", (p.pts or 0) if final else -1, serial, number)
            tail = bytes([len(part)]) + part + body
            out += head + struct.pack("<I", _ogg_crc(head + bytes(4) + tail)) + tail
            number += 1
    return bytes(out)


# MP4


def _boxes(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        n, head = struct.unpack_from(">I", raw, at)[0], 8
        if n == 1 and at + 16 <= end:
            n, head = struct.unpack_from(">Q", raw, at + 8)[0], 16
        elif n == 0:
            n = end - at
        if n < head:
            return
        yield raw[at + 4 : at + 8], at + head, min(end, at + n)
        at += n


def _inside(raw: bytes, a: int, b: int, *names: bytes) -> tuple[int, int] | None:
    for name in names:
        found = next(((c, d) for n, c, d in _boxes(raw, a, b) if n == name), None)
        if found is None:
            return None
        a, b = found
    return a, b


def _table(raw: bytes, span: tuple[int, int] | None, form: str) -> list[tuple]:
    if span is None:
        return []
    n, size = struct.unpack_from(">I", raw, span[0] + 4)[0], struct.calcsize(form)
    return [struct.unpack_from(form, raw, span[0] + 8 + size * k) for k in range(min(n, (span[1] - span[0] - 8) // size))]


def read_mp4(raw: bytes) -> Iterator[Packet]:
    """The samples that the tables of each track name, track by track in order of their places in the file."""
    moov = _inside(raw, 0, len(raw), b"moov")
    if moov is None:
        return
    found = []
    for number, (a, b) in enumerate((a, b) for n, a, b in _boxes(raw, *moov) if n == b"trak"):
        mdhd, hdlr, stbl = (_inside(raw, a, b, b"mdia", *rest) for rest in ((b"mdhd",), (b"hdlr",), (b"minf", b"stbl")))
        if mdhd is None or stbl is None:
            continue
        scale = struct.unpack_from(">I", raw, mdhd[0] + (20 if raw[mdhd[0]] else 12))[0] or 1
        kind = {b"vide": "video", b"soun": "audio"}.get(raw[hdlr[0] + 8 : hdlr[0] + 12], "subtitle") if hdlr else "subtitle"
        at = _inside(raw, *stbl, b"stsd")[0] + 8
        codec, body = raw[at + 4 : at + 8].decode("latin-1"), at + 8
        track = Track(kind, codec, 0.0, *struct.unpack_from(">HH", raw, body + 24)) if kind == "video" else Track(kind, codec, struct.unpack_from(">I", raw, body + 24)[0] / 65536, channels=struct.unpack_from(">H", raw, body + 16)[0]) if kind == "audio" else Track(kind, codec)
        stsz = _inside(raw, *stbl, b"stsz")
        fixed, count = struct.unpack_from(">II", raw, stsz[0] + 4)
        sizes = [fixed] * count if fixed else [x for (x,) in (struct.unpack_from(">I", raw, stsz[0] + 12 + 4 * k) for k in range(min(count, (stsz[1] - stsz[0] - 12) // 4)))]
        chunks = [x for (x,) in _table(raw, _inside(raw, *stbl, b"stco"), ">I")] or [x for (x,) in _table(raw, _inside(raw, *stbl, b"co64"), ">Q")]
        runs = _table(raw, _inside(raw, *stbl, b"stsc"), ">III")
        times = [d for n, d in _table(raw, _inside(raw, *stbl, b"stts"), ">II") for _ in range(min(n, len(sizes)))]
        shifts = [d for n, d in _table(raw, _inside(raw, *stbl, b"ctts"), ">Ii") for _ in range(min(n, len(sizes)))]
        sync = _inside(raw, *stbl, b"stss")
        keys = {x for (x,) in _table(raw, sync, ">I")}
        sample, dts = 0, 0
        for k, (first, per, _) in enumerate(runs):
            last = runs[k + 1][0] if k + 1 < len(runs) else len(chunks) + 1
            for place in chunks[first - 1 : last - 1]:
                for _ in range(per):
                    if sample >= len(sizes):
                        break
                    pts = dts + (shifts[sample] if sample < len(shifts) else 0)
                    found.append((place, Packet(number, pts * 1000 // scale, sync is None or sample + 1 in keys, raw[place : place + sizes[sample]], track)))
                    place += sizes[sample]
                    dts += times[sample] if sample < len(times) else 0
                    sample += 1
    yield from (p for _, p in sorted(found, key=lambda x: x[0]))


def write_mp4(tracks: list[Track], packets: Iterable[Packet]) -> bytes:
    """Milliseconds as the time scale, a chunk for each sample, tables after the data."""
    box = lambda name, *parts: struct.pack(">I", 8 + sum(map(len, parts))) + name + b"".join(parts)
    held = list(packets)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    places, data = [], b""
    for p in held:
        places.append(len(head) + 8 + len(data))
        data += p.data
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    traks = b""
    for k, t in enumerate(tracks):
        own = [(p, place) for p, place in zip(held, places, strict=True) if p.stream == k]
        steps = [b.pts - a.pts for (a, _), (b, _) in zip(own, own[1:], strict=False)] + [0] * bool(own)
        name = t.codec.encode("latin-1")[:4].ljust(4)
        if t.kind == "video":
            entry, media, kind = box(name, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", t.width, t.height, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 24, -1)), box(b"vmhd", struct.pack(">IQ", 1, 0)), b"vide"
        else:
            entry, media, kind = box(name, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHII", t.channels, 16, 0, round(t.rate) << 16)), box(b"smhd", bytes(8)), b"soun"
        list_ = lambda form, rows: struct.pack(">II", 0, len(rows)) + b"".join(struct.pack(form, *r) for r in rows)
        keys = [(n,) for n, (p, _) in enumerate(own, 1) if p.key]
        tables = [box(b"stsd", struct.pack(">II", 0, 1), entry), box(b"stts", list_(">II", [(1, s) for s in steps])), box(b"stsc", list_(">III", [(1, 1, 1)])), box(b"stsz", struct.pack(">III", 0, 0, len(own)) + b"".join(struct.pack(">I", len(p.data)) for p, _ in own)), box(b"stco", list_(">I", [(place,) for _, place in own]))]
        if len(keys) < len(own):
            tables.append(box(b"stss", list_(">I", keys)))
        length = own[-1][0].pts if own else 0
        mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIIIHH", 0, 0, 0, 1000, length, 0x55C4, 0)), box(b"hdlr", struct.pack(">II4s", 0, 0, kind), bytes(13)), box(b"minf", media, box(b"dinf", box(b"dref", struct.pack(">II", 0, 1), box(b"url ", struct.pack(">I", 1)))), box(b"stbl", *tables)))
        traks += box(b"trak", box(b"tkhd", struct.pack(">IIIIII", 3, 0, 0, k + 1, 0, length), bytes(16), matrix, struct.pack(">II", t.width << 16, t.height << 16)), mdia)
    moov = box(b"moov", box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 1000, max((p.pts or 0 for p in held), default=0)), struct.pack(">IHHQ", 0x10000, 0x100, 0, 0), matrix, bytes(24), struct.pack(">I", len(tracks) + 1)), traks)
    return head + box(b"mdat", data) + moov


# Matroska


def _ebml_number(raw: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, where it ends) of a number whose leading zeros say how long it is; ``keep``: with the mark, as in names."""
    n = 9 - raw[at].bit_length()
    value = int.from_bytes(raw[at : at + n], "big")
    return (value if keep else value & (1 << 7 * n) - 1), at + n


def _elements(raw: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end and raw[at]:
        name, p = _ebml_number(raw, at, True)
        if p >= end or not raw[p]:
            return
        width = 9 - raw[p].bit_length()
        size, p = _ebml_number(raw, p)
        stop = end if size == (1 << 7 * width) - 1 else min(end, p + size)
        yield name, p, stop
        at = stop


_SEGMENT, _CLUSTER, _GROUP, _SIMPLE, _BLOCK, _TIME = 0x18538067, 0x1F43B675, 0xA0, 0xA3, 0xA1, 0xE7


def read_matroska(raw: bytes) -> Iterator[Packet]:
    """Simple blocks and blocks in groups, without lacing; a block in a group is key unless it refers to another one."""
    if raw[:4] != b"\x1a\x45\xdf\xa3":
        return
    tracks: dict[int, tuple[int, Track]] = {}
    scale = 1_000_000
    whole = lambda a, b: int.from_bytes(raw[a:b], "big")

    def real(a: int, b: int) -> float:
        return struct.unpack(">f" if b - a == 4 else ">d", raw[a:b])[0] if b - a in (4, 8) else 0.0

    for name, a, b in _elements(raw, 0, len(raw)):
        if name != _SEGMENT:
            continue
        for kind, c, d in _elements(raw, a, b):
            if kind == 0x1549A966:  # information
                scale = next((whole(e, f) for n, e, f in _elements(raw, c, d) if n == 0x2AD7B1), scale)
            elif kind == 0x1654AE6B:  # tracks
                for n, e, f in _elements(raw, c, d):
                    if n == 0xAE:
                        values = {m: (g, h) for m, g, h in _elements(raw, e, f)}
                        video = {m: whole(g, h) for m, g, h in _elements(raw, *values[0xE0])} if 0xE0 in values else {}
                        audio = {m: (g, h) for m, g, h in _elements(raw, *values[0xE1])} if 0xE1 in values else {}
                        which = {1: "video", 2: "audio"}.get(whole(*values[0x83]), "subtitle")
                        rate = real(*audio[0xB5]) if 0xB5 in audio else 0.0
                        channels = whole(*audio[0x9F]) if 0x9F in audio else 0
                        tracks[whole(*values[0xD7])] = (len(tracks), Track(which, raw[slice(*values[0x86])].decode("latin-1"), rate, video.get(0xB0, 0), video.get(0xBA, 0), channels))
            elif kind == _CLUSTER:
                base = 0
                for n, e, f in _elements(raw, c, d):
                    if n == _TIME:
                        base = whole(e, f)
                        continue
                    block, key = (e, f), None
                    if n == _GROUP:
                        inner = {m: (g, h) for m, g, h in _elements(raw, e, f)}
                        block, key = inner.get(_BLOCK), 0xFB not in inner
                    elif n != _SIMPLE:
                        continue
                    if block is None:
                        continue
                    number, p = _ebml_number(raw, block[0])
                    ticks, flags = struct.unpack_from(">hB", raw, p)
                    if number in tracks and not flags & 6:
                        stream, track = tracks[number]
                        yield Packet(stream, (base + ticks) * scale // 1_000_000, bool(flags & 128) if key is None else key, raw[p + 3 : block[1]], track)


def write_matroska(tracks: list[Track], packets: Iterable[Packet], doctype: str = "matroska") -> bytes:
    """Milliseconds; a cluster for each second."""

    def element(name: int, data: bytes | int | float | str) -> bytes:
        if isinstance(data, int):
            data = data.to_bytes(max(1, (data.bit_length() + 7) // 8), "big")
        elif isinstance(data, float):
            data = struct.pack(">d", data)
        elif isinstance(data, str):
            data = data.encode()
        return name.to_bytes((name.bit_length() + 7) // 8, "big") + (1 << 56 | len(data)).to_bytes(8, "big") + data

    entries = b""
    for k, t in enumerate(tracks):
        detail = element(0xE0, element(0xB0, t.width) + element(0xBA, t.height)) if t.kind == "video" else element(0xE1, element(0xB5, float(t.rate)) + element(0x9F, t.channels)) if t.kind == "audio" else b""
        entries += element(0xAE, element(0xD7, k + 1) + element(0x73C5, k + 1) + element(0x83, {"video": 1, "audio": 2}.get(t.kind, 17)) + element(0x86, t.codec) + detail)
    clusters, now, body = b"", None, b""
    for p in packets:
        second = (p.pts or 0) // 1000 * 1000
        if now is not None and second != now:
            clusters, body = clusters + element(_CLUSTER, element(_TIME, now) + body), b""
        now = second
        body += element(_SIMPLE, bytes([0x80 | p.stream + 1]) + struct.pack(">hB", (p.pts or 0) - now, 128 if p.key else 0) + p.data)
    if now is not None:
        clusters += element(_CLUSTER, element(_TIME, now) + body)
    head = element(0x1A45DFA3, element(0x4286, 1) + element(0x42F7, 1) + element(0x42F2, 4) + element(0x42F3, 8) + element(0x4282, doctype) + element(0x4287, 4) + element(0x4285, 2))
    return head + element(_SEGMENT, element(0x1549A966, element(0x2AD7B1, 1_000_000) + element(0x4D80, "tickloom") + element(0x5741, "tickloom")) + element(0x1654AE6B, entries) + clusters)


# MPEG-TS

#: Stream types.
TS_TYPES = {1: ("video", "mpeg1video"), 2: ("video", "mpeg2video"), 3: ("audio", "mp3"), 4: ("audio", "mp3"), 15: ("audio", "aac"), 16: ("video", "mpeg4"), 17: ("audio", "aac_latm"), 27: ("video", "h264"), 36: ("video", "hevc"), 129: ("audio", "ac3"), 135: ("audio", "eac3")}


def read_mpegts(raw: bytes) -> Iterator[Packet]:
    """Packets of elementary streams, put together by their process ids; the tables say which ones there are. Rubbish before a sync byte is passed over."""
    at = next((k for k in range(min(len(raw), 188)) if raw[k] == 0x47 and (k + 188 >= len(raw) or raw[k + 188] == 0x47)), None)
    if at is None:
        return
    maps: set[int] = set()
    tracks: dict[int, tuple[int, Track]] = {}
    held: dict[int, bytearray] = {}
    keys: dict[int, bool] = {}

    def finished(pid: int) -> Iterator[Packet]:
        data = bytes(held.pop(pid, b""))
        if len(data) >= 9 and data[:3] == b"\0\0\1":
            pts = None
            if data[7] & 128 and len(data) >= 14:
                p = data[9:14]
                pts = ((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1) // 90
            stream, track = tracks[pid]
            yield Packet(stream, pts, keys.get(pid, False), data[9 + data[8] :], track)

    while at + 188 <= len(raw):
        if raw[at] != 0x47:
            at += 1
            continue
        pid, starts, control = (raw[at + 1] & 31) << 8 | raw[at + 2], bool(raw[at + 1] & 64), raw[at + 3] >> 4 & 3
        body, random = at + 4, False
        if control & 2:
            random = bool(raw[at + 4] and raw[at + 5] & 64)
            body += 1 + raw[at + 4]
        data = raw[body : at + 188] if control & 1 else b""
        at += 188
        if pid == 0 and starts and data:
            section = data[1 + data[0] :]
            end = 3 + ((section[1] & 15) << 8 | section[2]) - 4
            maps |= {(section[k + 2] & 31) << 8 | section[k + 3] for k in range(8, end, 4) if section[k] << 8 | section[k + 1]}
        elif pid in maps and starts and data:
            section = data[1 + data[0] :]
            end = 3 + ((section[1] & 15) << 8 | section[2]) - 4
            k = 12 + ((section[10] & 15) << 8 | section[11])
            while k + 5 <= end:
                own = (section[k + 1] & 31) << 8 | section[k + 2]
                kind, codec = TS_TYPES.get(section[k], ("subtitle", f"{section[k]:#04x}"))
                tracks.setdefault(own, (len(tracks), Track(kind, codec)))
                k += 5 + ((section[k + 3] & 15) << 8 | section[k + 4])
        elif pid in tracks and data:
            if starts:
                yield from finished(pid)
                held[pid], keys[pid] = bytearray(data), random or tracks[pid][1].kind != "video"
            elif pid in held:
                held[pid] += data
    for pid in sorted(held):
        yield from finished(pid)


def _ts_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 ^ _OGG[crc >> 24 & 255 ^ b]) & 0xFFFFFFFF
    return crc


def write_mpegts(tracks: list[Track], packets: Iterable[Packet]) -> bytes:
    """The tables once, then each packet as one of its stream (process ids from 256)."""
    out, counts = bytearray(), {}

    def put(pid: int, data: bytes, key: bool = False) -> None:
        first = True
        while data or first:
            room = 184 - (2 if key and first else 0)
            stuff = max(0, room - len(data))
            field = b""
            if key and first or stuff:
                n = (1 if key and first else 0) + stuff if key and first else stuff - 1
                field = bytes([n]) + (bytes([64 if key and first else 0]) + b"\xff" * (n - 1) if n else b"")
            size = 184 - len(field)
            counts[pid] = (counts.get(pid, -1) + 1) & 15
            out.extend(bytes([0x47, (64 if first else 0) | pid >> 8, pid & 255, (0x30 if field else 0x10) | counts[pid]]) + field + data[:size])
            data, first = data[size:], False

    def section(pid: int, table: int, number: int, body: bytes) -> None:
        s = bytes([table]) + struct.pack(">H", 0xB000 | len(body) + 9) + struct.pack(">HBBB", number, 0xC1, 0, 0) + body
        put(pid, b"\0" + (s + struct.pack(">I", _ts_crc(s))).ljust(183, b"\xff"))

    section(0, 0, 1, struct.pack(">HH", 1, 0xE000 | 4096))
    kinds = {c: k for k, (_, c) in reversed(TS_TYPES.items())}
    section(4096, 2, 1, struct.pack(">HH", 0xE000 | 256, 0xF000) + b"".join(struct.pack(">BHH", kinds[t.codec], 0xE000 | 256 + k, 0xF000) for k, t in enumerate(tracks)))
    for p in packets:
        t, pts = tracks[p.stream], (p.pts or 0) * 90
        stamp = bytes([0x21 | pts >> 29 & 14, pts >> 22 & 255, 1 | pts >> 14 & 254, pts >> 7 & 255, 1 | pts << 1 & 254])
        length = len(p.data) + 8
        put(256 + p.stream, b"\0\0\1" + bytes([0xE0 if t.kind == "video" else 0xC0]) + struct.pack(">H", length if length < 65536 else 0) + b"\x80\x80\x05" + stamp + p.data, p.key and t.kind == "video")
    return bytes(out)


READERS: dict[str, Callable[[bytes], Iterator[Packet]]] = {"avi": read_avi, "flv": read_flv, "ogg": read_ogg, "mp4": read_mp4, "matroska": read_matroska, "mpegts": read_mpegts}
WRITERS: dict[str, Callable[[list[Track], Iterable[Packet]], bytes]] = {
    "avi": write_avi, "flv": write_flv, "mp4": write_mp4, "matroska": write_matroska, "webm": lambda t, p: write_matroska(t, p, "webm"), "mpegts": write_mpegts, "ogg": lambda t, p: write_ogg(p),
}


def detect(raw: bytes) -> str | None:
    if raw[:4] == b"RIFF" and raw[8:12] == b"AVI ":
        return "avi"
    if raw[4:8] in (b"ftyp", b"moov", b"mdat", b"free", b"wide"):
        return "mp4"
    for mark, name in ((b"FLV", "flv"), (b"OggS", "ogg"), (b"\x1a\x45\xdf\xa3", "matroska")):
        if raw.startswith(mark):
            return name
    return "mpegts" if raw[:1] == b"\x47" and (len(raw) <= 188 or raw[188] == 0x47) else None


SCHEMA = "format string, n int, stream int, kind string, codec string, rate double, width int, height int, channels int, pts long, key boolean, payload binary"


def demux(files: DataFrame, format: str = "auto", column: str = "content") -> DataFrame:
    """A row for each packet of each file's bytes. A file whose tables lie gives the packets before that shows."""

    def one(raw: bytes) -> Iterator[tuple]:
        raw = bytes(raw)
        name = detect(raw) if format == "auto" else format
        if name is None:
            return
        try:
            for n, p in enumerate(READERS[name](raw)):
                t = p.track
                yield name, n, p.stream, t.kind, t.codec, float(t.rate), t.width, t.height, t.channels, p.pts, p.key, p.data
        except (struct.error, IndexError, KeyError, TypeError, ValueError):
            return

    return payload.rows(files, one, [column], SCHEMA).drop(column)


def mux(packets: DataFrame, by: str, format: str) -> DataFrame:
    """(by, content): a file for each value of ``by``, of packets as ``demux`` gives them, in order of n. One file's packets are brought together, as it is one
    value."""
    names = ["n", "stream", "kind", "codec", "rate", "width", "height", "channels", "pts", "key", "payload"]
    held = packets.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*names)), lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).otherwise(0)).alias("_p"))

    def one(rows: list) -> tuple:
        tracks = {r["stream"]: Track(r["kind"], r["codec"], r["rate"], r["width"], r["height"], r["channels"]) for r in rows}
        order = sorted(tracks)
        return (WRITERS[format]([tracks[k] for k in order], [Packet(order.index(r["stream"]), r["pts"], r["key"], bytes(r["payload"])) for r in rows]),)

    return payload.each(held, one, ["_p"], "content binary").select(by, "content")


def read(spark: SparkSession, path: str, format: str = "auto") -> DataFrame:
    return demux(spark.read.format("binaryFile").load(path).select("path", "content"), format)
