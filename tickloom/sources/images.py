"""Still pictures: files to planes, and back. A picture has a width, a height and planes of 8-bit values (gray, RGB or RGBA)."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import payload


class PictureError(ValueError):
    """Bytes that aren't what the format asks for."""


@dataclass
class Picture:
    """pixels: (height, width, components)."""

    pixels: np.ndarray

    @property
    def size(self) -> tuple[int, int]:
        return self.pixels.shape[1], self.pixels.shape[0]


def _picture(flat: np.ndarray, w: int, h: int, n: int) -> Picture:
    if len(flat) < w * h * n:
        raise PictureError("too few pixels")
    return Picture(np.ascontiguousarray(flat[: w * h * n].reshape(h, w, n), np.uint8))


def _rgb(p: Picture) -> np.ndarray:
    n = p.pixels.shape[2]
    return np.repeat(p.pixels[..., :1], 3, axis=2) if n < 3 else p.pixels[..., :3]


def _rgba(p: Picture) -> np.ndarray:
    n = p.pixels.shape[2]
    alpha = p.pixels[..., 3:] if n == 4 else p.pixels[..., 1:] if n == 2 else np.full((*p.pixels.shape[:2], 1), 255, np.uint8)
    return np.concatenate([_rgb(p), alpha], axis=2)


def _luma(p: Picture) -> np.ndarray:
    return p.pixels[..., 0] if p.pixels.shape[2] < 3 else np.rint(p.pixels[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


# Netpbm


def _tokens(raw: bytes, count: int, at: int = 2) -> tuple[list[int], int]:
    """Numbers of a header, comments passed over, and where the pixels start."""
    found = []
    while len(found) < count:
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(raw, at)
        if not m:
            raise PictureError("a number is missing")
        found.append(int(m[1]))
        at = m.end()
    return found, at + 1


def read_pnm(raw: bytes) -> Picture:
    """P1 to P6; values up to 65535 are brought to 255."""
    kind = raw[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise PictureError("no portable map")
    bits, n = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    head, at = _tokens(raw, 2 if bits else 3)
    (w, h), top = head[:2], 1 if bits else head[2]
    if kind == b"P4":
        rows = np.frombuffer(raw, np.uint8, -(-w // 8) * h, at).reshape(h, -1)
        return Picture((1 - np.unpackbits(rows, axis=1)[:, :w, None]) * np.uint8(255))
    if kind == b"P1":
        flat = np.array([1 - int(c) for c in re.findall(rb"[01]", raw[at - 1 :])[: w * h]], np.float64)
    elif kind in (b"P2", b"P3"):
        flat = np.array([int(x) for x in re.sub(rb"#[^\n]*", b"", raw[at - 1 :]).split()[: w * h * n]], np.float64)
    else:
        flat = np.frombuffer(raw, ">u2" if top > 255 else "u1", w * h * n, at).astype(np.float64)
    return _picture(np.rint(flat * 255 / top), w, h, n)


def write_pgm(p: Picture) -> bytes:
    return b"P5\n%d %d\n255\n" % p.size + _luma(p).tobytes()


def write_ppm(p: Picture) -> bytes:
    return b"P6\n%d %d\n255\n" % p.size + _rgb(p).tobytes()


def write_pbm(p: Picture) -> bytes:
    """Values below 128 are black."""
    return b"P4\n%d %d\n" % p.size + np.packbits(_luma(p) < 128, axis=1).tobytes()


def read_pam(raw: bytes) -> Picture:
    if raw[:2] != b"P7":
        raise PictureError("no PAM")
    head, _, body = raw.partition(b"ENDHDR\n")
    values = dict(line.split(None, 1) for line in head.decode("ascii", "replace").split("\n")[1:] if len(line.split(None, 1)) == 2)
    w, h, n, top = (int(values[k]) for k in ("WIDTH", "HEIGHT", "DEPTH", "MAXVAL"))
    return _picture(np.rint(np.frombuffer(body, ">u2" if top > 255 else "u1", w * h * n).astype(np.float64) * 255 / top), w, h, n)


def write_pam(p: Picture) -> bytes:
    n = p.pixels.shape[2]
    kind = {1: "GRAYSCALE", 2: "GRAYSCALE_ALPHA", 3: "RGB", 4: "RGB_ALPHA"}[n]
    return b"P7\nWIDTH %d\nHEIGHT %d\n" % p.size + f"DEPTH {n}\nMAXVAL 255\nTUPLTYPE {kind}\nENDHDR\n".encode() + p.pixels.tobytes()


def read_pfm(raw: bytes) -> Picture:
    """Floats from 0 to 1, rows from the bottom up; also halves (Ph, PH)."""
    kind = raw[:2]
    if kind not in (b"Pf", b"PF", b"Ph", b"PH"):
        raise PictureError("no PFM")
    m = re.match(rb"P[fFhH]\s+(\d+)\s+(\d+)\s+(-?[\d.eE+]+)\s", raw)
    if not m:
        raise PictureError("no size")
    w, h, n = int(m[1]), int(m[2]), 3 if kind in (b"PF", b"PH") else 1
    dtype = ("<" if float(m[3]) < 0 else ">") + ("f2" if kind in (b"Ph", b"PH") else "f4")
    flat = np.frombuffer(raw, dtype, w * h * n, m.end()).astype(np.float64).reshape(h, w, n)[::-1]
    return Picture(np.clip(np.rint(flat * 255), 0, 255).astype(np.uint8))


def _write_floats(p: Picture, kinds: bytes, dtype: str) -> bytes:
    n = 1 if p.pixels.shape[2] < 3 else 3
    pixels = p.pixels[..., :1] if n == 1 else _rgb(p)
    return b"P" + kinds[n == 3 : (n == 3) + 1] + b"\n%d %d\n-1.0\n" % p.size + (pixels[::-1] / 255).astype(dtype).tobytes()


def write_pfm(p: Picture) -> bytes:
    return _write_floats(p, b"fF", "<f4")


def write_phm(p: Picture) -> bytes:
    return _write_floats(p, b"hH", "<f2")


# Headers and pixels


def read_bmp(raw: bytes) -> Picture:
    if raw[:2] != b"BM":
        raise PictureError("no BMP")
    start, size, w, h, _, depth, kind = struct.unpack_from("<IIiiHHI", raw, 10)
    if kind not in (0, 3) or depth not in (1, 4, 8, 24, 32):
        raise PictureError(f"BMP of {depth} bits, compression {kind}")
    line = -(-w * depth // 32) * 4
    rows = np.frombuffer(raw, np.uint8, line * abs(h), start).reshape(abs(h), line)
    rows = rows[::-1] if h > 0 else rows
    if depth <= 8:
        table = np.frombuffer(raw, np.uint8, (struct.unpack_from("<I", raw, 46)[0] or 1 << depth) * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        index = rows if depth == 8 else np.unpackbits(rows, axis=1) if depth == 1 else np.stack([rows >> 4, rows & 15], axis=2).reshape(len(rows), -1)
        return Picture(np.ascontiguousarray(table[index[:, :w]]))
    pixels = rows[:, : w * depth // 8].reshape(abs(h), w, depth // 8)
    return Picture(np.ascontiguousarray(pixels[..., [2, 1, 0, 3][: depth // 8]]))


def write_bmp(p: Picture) -> bytes:
    (w, h), n = p.size, 4 if p.pixels.shape[2] == 4 else 3
    pixels = (_rgba(p)[..., [2, 1, 0, 3]] if n == 4 else _rgb(p)[..., ::-1])[::-1].reshape(h, w * n)
    body = np.pad(pixels, ((0, 0), (0, -w * n % 4))).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 * n, 0, len(body), 0, 0, 0, 0) + body


def read_qoi(raw: bytes) -> Picture:
    if raw[:4] != b"qoif":
        raise PictureError("no QOI")
    w, h, n = struct.unpack_from(">IIB", raw, 4)
    seen, px, out, at = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), [], 14
    while len(out) < w * h:
        b = raw[at]
        at += 1
        run = 1
        if b == 0xFE:
            px, at = (*raw[at : at + 3], px[3]), at + 3
        elif b == 0xFF:
            px, at = tuple(raw[at : at + 4]), at + 4
        elif b >> 6 == 0:
            px = seen[b]
        elif b >> 6 == 1:
            px = (*(px[k] + (b >> s & 3) - 2 & 255 for k, s in enumerate((4, 2, 0))), px[3])
        elif b >> 6 == 2:
            g, c = (b & 63) - 32, raw[at]
            at += 1
            px = (px[0] + g - 8 + (c >> 4) & 255, px[1] + g & 255, px[2] + g - 8 + (c & 15) & 255, px[3])
        else:
            run = (b & 63) + 1
        seen[(px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) % 64] = px
        out += [px] * run
    return Picture(np.array(out[: w * h], np.uint8).reshape(h, w, 4)[..., :n])


def write_qoi(p: Picture) -> bytes:
    n = 4 if p.pixels.shape[2] == 4 else 3
    out = bytearray(b"qoif" + struct.pack(">IIBB", *p.size, n, 0))
    seen, last, run = [(0, 0, 0, 0)] * 64, (0, 0, 0, 255), 0
    for px in map(tuple, _rgba(p).reshape(-1, 4).tolist()):
        if px == last:
            run += 1
            if run == 62:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        k = (px[0] * 3 + px[1] * 5 + px[2] * 7 + px[3] * 11) % 64
        r, g, b = ((px[c] - last[c] + 128) % 256 - 128 for c in range(3))
        if seen[k] == px:
            out.append(k)
        elif px[3] != last[3]:
            out += bytes([0xFF, *px])
        elif all(-2 <= x <= 1 for x in (r, g, b)):
            out.append(0x40 | r + 2 << 4 | g + 2 << 2 | b + 2)
        elif -32 <= g <= 31 and -8 <= r - g <= 7 and -8 <= b - g <= 7:
            out += bytes([0x80 | g + 32, r - g + 8 << 4 | b - g + 8])
        else:
            out += bytes([0xFE, *px[:3]])
        seen[k], last = px, px
    if run:
        out.append(0xC0 | run - 1)
    return bytes(out) + bytes(7) + b"\1"


def read_targa(raw: bytes) -> Picture:
    """True colour, gray or a colour map, plain or in runs."""
    id_size, has_map, kind, first, length, map_bits, _, _, w, h, depth, flags = struct.unpack_from("<BBBHHBHHHHBB", raw)
    if kind & 7 not in (1, 2, 3) or depth not in (8, 24, 32):
        raise PictureError("no Targa that is handled")
    at, n = 18 + id_size, depth // 8
    table = np.frombuffer(raw, np.uint8, length * map_bits // 8, at).reshape(length, -1) if has_map else None
    at += length * (map_bits // 8) if has_map else 0
    if kind & 8:
        flat = bytearray()
        while len(flat) < w * h * n:
            c, at = raw[at], at + 1
            count = (c & 127) + 1
            flat += raw[at : at + n] * count if c & 128 else raw[at : at + n * count]
            at += n if c & 128 else n * count
        raw, at = bytes(flat), 0
    pixels = np.frombuffer(raw, np.uint8, w * h * n, at).reshape(h, w, n)
    if table is not None:
        pixels = table[pixels[..., 0].astype(int) - first]
    pixels = pixels if flags & 32 else pixels[::-1]
    return Picture(np.ascontiguousarray(pixels[..., [2, 1, 0, 3][: pixels.shape[2]]] if pixels.shape[2] >= 3 else pixels))


def write_targa(p: Picture) -> bytes:
    n = {1: 1, 2: 4, 3: 3, 4: 4}[p.pixels.shape[2]]
    pixels = p.pixels if n == 1 else _rgba(p)[..., [2, 1, 0, 3]] if n == 4 else _rgb(p)[..., ::-1]
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 3 if n == 1 else 2, 0, 0, 0, 0, 0, *p.size, 8 * n, 32 | (8 if n == 4 else 0)) + np.ascontiguousarray(pixels).tobytes()


def read_pcx(raw: bytes) -> Picture:
    """8 bits and one or three planes, in runs; one plane goes through the palette at the file's end, if there is one."""
    if raw[0] != 10 or raw[3] != 8:
        raise PictureError("no PCX of 8 bits")
    x0, y0, x1, y1 = struct.unpack_from("<4H", raw, 4)
    w, h, planes, line = x1 - x0 + 1, y1 - y0 + 1, raw[65], struct.unpack_from("<H", raw, 66)[0]
    flat, at = bytearray(), 128
    while len(flat) < planes * line * h and at < len(raw):
        if raw[at] >= 0xC0:
            flat += raw[at + 1 : at + 2] * (raw[at] & 63)
            at += 2
        else:
            flat.append(raw[at])
            at += 1
    pixels = np.frombuffer(bytes(flat), np.uint8, planes * line * h).reshape(h, planes, line)[:, :, :w].transpose(0, 2, 1)
    if planes == 1 and len(raw) >= 769 and raw[-769] == 12:
        return Picture(np.ascontiguousarray(np.frombuffer(raw[-768:], np.uint8).reshape(256, 3)[pixels[..., 0]]))
    return Picture(np.ascontiguousarray(pixels))


def write_pcx(p: Picture) -> bytes:
    (w, h), pixels = p.size, _rgb(p)
    head = struct.pack("<BBBB4H2H", 10, 5, 1, 8, 0, 0, w - 1, h - 1, w, h) + bytes(48) + struct.pack("<BBHH", 0, 3, w + w % 2, 1)
    out = bytearray(head.ljust(128, b"\0"))
    for row in pixels:
        for plane in row.T:
            line = plane.tolist() + [0] * (w % 2)
            at = 0
            while at < len(line):
                n = 1
                while at + n < len(line) and n < 63 and line[at + n] == line[at]:
                    n += 1
                out += bytes([0xC0 | n, line[at]]) if n > 1 or line[at] >= 0xC0 else bytes([line[at]])
                at += n
    return bytes(out)


def read_sgi(raw: bytes) -> Picture:
    magic, packed, depth, dims, w, h, n = struct.unpack_from(">HBBHHHH", raw)
    if magic != 474 or depth != 1:
        raise PictureError("no SGI of 8 bits")
    h, n = (1 if dims < 2 else h), (1 if dims < 3 else n)
    if not packed:
        return Picture(np.ascontiguousarray(np.frombuffer(raw, np.uint8, w * h * n, 512).reshape(n, h, w)[:, ::-1].transpose(1, 2, 0)))
    starts = np.frombuffer(raw, ">u4", h * n, 512)
    out = np.zeros((n, h, w), np.uint8)
    for k, at in enumerate(starts.tolist()):
        row = bytearray()
        while raw[at] & 127:
            count = raw[at] & 127
            row += raw[at + 1 : at + 1 + count] if raw[at] & 128 else raw[at + 1 : at + 2] * count
            at += 1 + (count if raw[at] & 128 else 1)
        out[k // h, k % h] = np.frombuffer(bytes(row[:w]), np.uint8)
    return Picture(np.ascontiguousarray(out[:, ::-1].transpose(1, 2, 0)))


def write_sgi(p: Picture) -> bytes:
    n = p.pixels.shape[2]
    head = struct.pack(">HBBHHHHII", 474, 0, 1, 3 if n > 1 else 2, *p.size, n, 0, 255)
    return head.ljust(512, b"\0") + np.ascontiguousarray(p.pixels.transpose(2, 0, 1)[:, ::-1]).tobytes()


def read_sunrast(raw: bytes) -> Picture:
    magic, w, h, depth, _, kind, map_kind, map_size = struct.unpack_from(">8I", raw)
    if magic != 0x59A66A95 or depth not in (8, 24, 32) or kind > 3:
        raise PictureError("no Sun raster that is handled")
    at, n = 32 + map_size, depth // 8
    body = raw[at:]
    if kind == 2:
        flat, k = bytearray(), 0
        while k < len(body):
            if body[k] != 0x80:
                flat.append(body[k])
                k += 1
            elif body[k + 1] == 0:
                flat.append(0x80)
                k += 2
            else:
                flat += body[k + 2 : k + 3] * (body[k + 1] + 1)
                k += 3
        body = bytes(flat)
    line = w * n + w * n % 2
    pixels = np.frombuffer(body, np.uint8, line * h).reshape(h, line)[:, : w * n].reshape(h, w, n)
    if map_kind == 1 and depth == 8:
        return Picture(np.ascontiguousarray(np.frombuffer(raw[32:at], np.uint8).reshape(3, -1).T[pixels[..., 0]]))
    if n == 4:
        pixels = pixels[..., 1:]
    return Picture(np.ascontiguousarray(pixels if kind == 3 or n == 1 else pixels[..., ::-1]))


def read_xbm(raw: bytes) -> Picture:
    """Set bits are black, the lowest bit first."""
    text = raw.decode("latin-1")
    size = {k: int(v) for k, v in re.findall(r"#define\s+\S*?(width|height)\s+(\d+)", text)}
    values = [int(x, 16) for x in re.findall(r"0x([0-9a-fA-F]+)", text.partition("{")[2])]
    if set(size) != {"width", "height"}:
        raise PictureError("no XBM")
    rows = np.array(values[: -(-size["width"] // 8) * size["height"]], np.uint8).reshape(size["height"], -1)
    return Picture((1 - np.unpackbits(rows, axis=1, bitorder="little")[:, : size["width"], None]) * np.uint8(255))


def write_xbm(p: Picture) -> bytes:
    w, h = p.size
    rows = np.packbits(_luma(p) < 128, axis=1, bitorder="little")
    body = ",\n".join(" " + ", ".join(f"0x{x:02X}" for x in row) for row in rows.tolist())
    return f"#define image_width {w}\n#define image_height {h}\nstatic unsigned char image_bits[] = {{\n{body} }};\n".encode()


def read_xwd(raw: bytes) -> Picture:
    head = struct.unpack_from(">25I", raw)
    size, version, form, _, w, h, _, order, _, _, _, bits, line = head[:13]
    if version != 7 or form != 2 or bits not in (24, 32):
        raise PictureError("no XWD that is handled")
    start = size + 12 * head[19]
    rows = np.frombuffer(raw, np.uint8, line * h, start).reshape(h, line)[:, : w * bits // 8].reshape(h, w, bits // 8)
    return Picture(np.ascontiguousarray(rows[..., 2::-1] if order == 0 else rows[..., -3:]))


def write_xwd(p: Picture) -> bytes:
    w, h = p.size
    head = [108, 7, 2, 24, w, h, 0, 0, 32, 0, 32, 32, 4 * w, 4, 0xFF0000, 0xFF00, 0xFF, 8, 256, 0, w, h, 0, 0, 0]
    pixels = np.concatenate([_rgb(p)[..., ::-1], np.zeros((h, w, 1), np.uint8)], axis=2)
    return struct.pack(">25I", *head) + b"picture\0" + pixels.tobytes()


# PNG, GIF


def read_png(raw: bytes) -> Picture:
    """Eight bits, or fewer or sixteen brought to eight; without interlacing. Palettes become RGB, or RGBA."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise PictureError("no PNG")
    at, body, table, alpha, head = 8, b"", None, None, None
    while at + 8 <= len(raw):
        n, name = struct.unpack_from(">I4s", raw, at)
        data = raw[at + 8 : at + 8 + n]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif name == b"PLTE":
            table = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            alpha = np.frombuffer(data, np.uint8)
        elif name == b"IDAT":
            body += data
        at += 12 + n
    if head is None or head[6]:
        raise PictureError("no PNG that is handled")
    w, h, depth, kind = head[:4]
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    line, step = -(-w * n * depth // 8), max(1, n * depth // 8)
    flat = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + line)
    rows, above = np.zeros((h, line), np.uint8), np.zeros(line, np.uint8)
    for y in range(h):
        above = rows[y] = _unfiltered(int(flat[y, 0]), flat[y, 1:], above, step)
    if depth == 16:
        pixels = rows.reshape(h, w, n, 2)[..., 0]
    elif depth == 8:
        pixels = rows.reshape(h, w, n)
    else:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        pixels = (bits @ (1 << np.arange(depth)[::-1])).astype(np.uint8)[:, :w, None]
        pixels = pixels if kind == 3 else pixels * np.uint8(255 // ((1 << depth) - 1))
    if kind == 3:
        rgb = table[pixels[..., 0]]
        if alpha is None:
            return Picture(np.ascontiguousarray(rgb))
        full = np.concatenate([alpha, np.full(256 - len(alpha), 255, np.uint8)])
        return Picture(np.concatenate([rgb, full[pixels]], axis=2))
    return Picture(np.ascontiguousarray(pixels))


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        padded = np.pad(row, (0, -len(row) % step)).reshape(-1, step)
        return np.cumsum(padded, axis=0, dtype=np.uint8).reshape(-1)[: len(row)]
    out = row.astype(int).tolist()
    up = above.astype(int).tolist()
    for x in range(len(out)):
        a, b = (out[x - step] if x >= step else 0), up[x]
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = up[x - step] if x >= step else 0
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[x] = out[x] + guess & 255
    return np.array(out, np.uint8)


def write_png(p: Picture) -> bytes:
    """Each row less the one above."""
    (w, h), n = p.size, p.pixels.shape[2]
    rows = p.pixels.reshape(h, w * n)
    less = rows - np.concatenate([np.zeros((1, w * n), np.uint8), rows[:-1]])
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    body = zlib.compress(np.concatenate([np.full((h, 1), 2, np.uint8), less], axis=1).tobytes())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def unpack_lzw(data: bytes, least: int) -> bytes:
    """GIF's codes, the lowest bit first."""
    clear, end = 1 << least, (1 << least) + 1
    table, width, last, out = [bytes([k]) for k in range(clear)] + [b"", b""], least + 1, None, bytearray()
    held = bits = 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & (1 << width) - 1
            held >>= width
            bits -= width
            if code == clear:
                del table[end + 1 :]
                width, last = least + 1, None
                continue
            if code == end:
                return bytes(out)
            if last is None:
                word = table[code]
            else:
                word = table[code] if code < len(table) else table[last] + table[last][:1]
                if len(table) < 4096:
                    table.append(table[last] + word[:1])
                    if len(table) == 1 << width and width < 12:
                        width += 1
            out += word
            last = code
    return bytes(out)


def pack_lzw(data: bytes, least: int) -> bytes:
    clear, end = 1 << least, (1 << least) + 1
    table, width, held, bits, out = {bytes([k]): k for k in range(clear)}, least + 1, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal held, bits
        held |= code << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    put(clear)
    word, size = b"", end + 1
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = size
        size += 1
        if size > 1 << width and width < 12:
            width += 1
        elif size > 4095:
            put(clear)
            table, width, size = {bytes([c]): c for c in range(clear)}, least + 1, end + 1
        word = data[k : k + 1]
    if word:
        put(table[word])
    put(end)
    if bits:
        out.append(held & 255)
    return bytes(out)


def read_gif(raw: bytes) -> Picture:
    """The first picture."""
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise PictureError("no GIF")
    w, h, flags = struct.unpack_from("<HHB", raw, 6)
    at, table = 13, None
    if flags & 128:
        n = 3 << (flags & 7) + 1
        table, at = np.frombuffer(raw, np.uint8, n, at).reshape(-1, 3), at + n
    while raw[at] != 0x2C:
        if raw[at] != 0x21:
            raise PictureError("no picture")
        at += 2
        while raw[at]:
            at += 1 + raw[at]
        at += 1
    left, top, pw, ph, flags = struct.unpack_from("<HHHHB", raw, at + 1)
    at += 10
    if flags & 128:
        n = 3 << (flags & 7) + 1
        table, at = np.frombuffer(raw, np.uint8, n, at).reshape(-1, 3), at + n
    least, at, data = raw[at], at + 1, bytearray()
    while raw[at]:
        data += raw[at + 1 : at + 1 + raw[at]]
        at += 1 + raw[at]
    index = np.frombuffer(unpack_lzw(bytes(data), least), np.uint8)[: pw * ph].reshape(ph, pw)
    if flags & 64:
        order = np.concatenate([np.arange(a, ph, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
        rows = np.empty_like(index)
        rows[order] = index
        index = rows
    out = np.zeros((h, w, 3), np.uint8)
    out[top : top + ph, left : left + pw] = table[index]
    return Picture(out)


def write_gif(p: Picture) -> bytes:
    """Colours of three bits of red and green and two of blue; gray values as they are."""
    w, h = p.size
    if p.pixels.shape[2] < 3:
        table, index = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1), p.pixels[..., 0]
    else:
        k = np.arange(256)
        table = np.stack([(k >> 5) * 255 // 7, (k >> 2 & 7) * 255 // 7, (k & 3) * 255 // 3], axis=1).astype(np.uint8)
        index = (p.pixels[..., 0] >> 5 << 5) | (p.pixels[..., 1] >> 5 << 2) | (p.pixels[..., 2] >> 6)
    body = pack_lzw(index.astype(np.uint8).tobytes(), 8)
    blocks = b"".join(bytes([len(body[at : at + 255])]) + body[at : at + 255] for at in range(0, len(body), 255))
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + table.tobytes() + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08" + blocks + b"\0;"


#: name: (what a file starts with, reader, writer or None).
FORMATS: dict[str, tuple[tuple[bytes, ...], Callable[[bytes], Picture], Callable[[Picture], bytes] | None]] = {
    "png": ((b"\x89PNG\r\n\x1a\n",), read_png, write_png), "gif": ((b"GIF87a", b"GIF89a"), read_gif, write_gif), "bmp": ((b"BM",), read_bmp, write_bmp), "qoi": ((b"qoif",), read_qoi, write_qoi),
    "pbm": ((b"P1", b"P4"), read_pnm, write_pbm), "pgm": ((b"P2", b"P5"), read_pnm, write_pgm), "ppm": ((b"P3", b"P6"), read_pnm, write_ppm), "pam": ((b"P7",), read_pam, write_pam),
    "pfm": ((b"Pf", b"PF"), read_pfm, write_pfm), "phm": ((b"Ph", b"PH"), read_pfm, write_phm), "sgi": ((b"\x01\xda",), read_sgi, write_sgi), "sunrast": ((b"\x59\xa6\x6a\x95",), read_sunrast, None),
    "pcx": ((b"\x0a\x05\x01",), read_pcx, write_pcx), "xbm": ((b"#define",), read_xbm, write_xbm), "xwd": ((b"\0\0\0\x6c\0\0\0\x07",), read_xwd, write_xwd), "targa": ((), read_targa, write_targa),
}


def detect(raw: bytes) -> str | None:
    found = [(len(m), name) for name, (magics, _, _) in FORMATS.items() for m in magics if raw.startswith(m)]
    return max(found)[1] if found else None


def demux(files: DataFrame, format: str = "auto", column: str = "content") -> DataFrame:
    """Adds format, w, h, planes (an array of arrays, row by row) of each file's bytes; ``error`` says what is wrong with one that can't be read."""

    def one(raw: bytes) -> tuple:
        raw = bytes(raw)
        name = detect(raw) if format == "auto" else format
        if name is None:
            return None, None, None, None, "no known format"
        try:
            p = FORMATS[name][1](raw)
            w, h = p.size
            return name, w, h, p.pixels.reshape(w * h, -1).T.tolist(), None
        except (PictureError, ValueError, IndexError, KeyError, TypeError, struct.error, zlib.error) as e:
            return name, None, None, None, str(e) or type(e).__name__

    return payload.each(files, one, [column], "format string, w int, h int, planes array<array<int>>, error string")


def frames(pictures: DataFrame, planes: int) -> DataFrame:
    """``planes`` as columns p0, p1 .., as ``operators.pixels`` takes them."""
    return pictures.withColumns({f"p{k}": F.get("planes", F.lit(k)) for k in range(planes)}).drop("planes")


def mux(pictures: DataFrame, format: str) -> DataFrame:
    """Adds ``content``, the file of each row's w, h and planes."""

    def one(planes: list, w: int, h: int) -> tuple:
        return (FORMATS[format][2](Picture(np.array(planes, np.uint8).T.reshape(h, w, -1))),)

    return payload.each(pictures, one, ["planes", "w", "h"], "content binary")


def read(spark: SparkSession, path: str, format: str = "auto") -> DataFrame:
    return demux(spark.read.format("binaryFile").load(path).select("path", "content"), format).drop("content")
