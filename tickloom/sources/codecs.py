"""Codecs that need no more than a payload at a time: FLAC, QOA and Flash ADPCM sound, and packed pictures."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import payload
from .pcm import STEPS


class CodecError(ValueError):
    """Bytes that a codec can't read."""


@dataclass
class Sound:
    """samples: (channels, samples), whole numbers of ``bits``."""

    samples: np.ndarray
    rate: int
    bits: int = 16


# FLAC


class _Bits:
    """The highest bit first; whole runs of the data are turned into numbers at once."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise CodecError("the data end too soon")
        first, last = self.at >> 3, self.at + n + 7 >> 3
        value = int.from_bytes(self.data[first:last], "big") >> (8 * last - self.at - n) & (1 << n) - 1
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value - (1 << n) if n and value >> n - 1 else value

    def unary(self) -> int:
        """Zeros before the next one."""
        start = self.at
        byte, bit = self.at >> 3, self.at & 7
        if byte >= len(self.data):
            raise CodecError("the data end too soon")
        low = self.data[byte] & 0xFF >> bit
        while not low:
            byte += 1
            if byte >= len(self.data):
                raise CodecError("the data end too soon")
            low = self.data[byte]
        self.at = 8 * byte + 9 - low.bit_length()
        return self.at - start - 1


#: Weights of the fixed predictors, the newest sample first; block sizes, rates and bits by code.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
FLAC_RATES = (0, 88200, 176400, 192000, 8000, 16000, 22050, 24000, 32000, 44100, 48000, 96000)
FLAC_BITS = (0, 8, 12, 0, 16, 20, 24, 32)


def _residual(bits: _Bits, size: int, order: int) -> list[int]:
    wide = bits.take(2)
    if wide > 1:
        raise CodecError("an unknown way to code residuals")
    parts = bits.take(4)
    out: list[int] = []
    for part in range(1 << parts):
        n = (size >> parts) - (order if part == 0 else 0)
        k = bits.take(5 if wide else 4)
        if k == (31 if wide else 15):
            width = bits.take(5)
            out += [bits.signed(width) for _ in range(n)]
            continue
        for _ in range(n):
            v = bits.unary() << k | bits.take(k)
            out.append(v >> 1 ^ -(v & 1))
    return out


def _subframe(bits: _Bits, size: int, depth: int) -> list[int]:
    bits.take(1)
    kind = bits.take(6)
    wasted = bits.unary() + 1 if bits.take(1) else 0
    depth -= wasted
    if kind == 0:
        out = [bits.signed(depth)] * size
    elif kind == 1:
        out = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(depth) for _ in range(order)]
        shift, weights = 0, FIXED[order] if kind < 32 else ()
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            weights = tuple(bits.signed(precision) for _ in range(order))
        for r in _residual(bits, size, order):
            out.append(r + (sum(w * out[-1 - k] for k, w in enumerate(weights)) >> shift))
    else:
        raise CodecError("a reserved kind of subframe")
    return [x << wasted for x in out] if wasted else out


def decode_flac(raw: bytes) -> Sound:
    if raw[:4] != b"fLaC":
        raise CodecError("no fLaC")
    at, last, rate, channels, depth = 4, False, 0, 0, 0
    while not last:
        last, kind, n = bool(raw[at] & 128), raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        if kind == 0:
            info = int.from_bytes(raw[at + 14 : at + 22], "big")
            rate, channels, depth = info >> 44, (info >> 41 & 7) + 1, (info >> 36 & 31) + 1
        at += 4 + n
    if at > len(raw) or not channels:
        raise CodecError("the head ends too soon")
    bits = _Bits(raw[at:])
    out: list[list[int]] = [[] for _ in range(channels)]
    while bits.at + 16 <= bits.end:
        if bits.take(15) != 0x7FFC:
            raise CodecError("no frame where one should start")
        bits.take(1)
        size, hz, layout, width = bits.take(4), bits.take(4), bits.take(4), FLAC_BITS[bits.take(3)] or depth
        bits.take(1)
        lead = bits.take(8)
        while lead & 0xC0 == 0xC0:
            bits.take(8)
            lead = lead << 1 & 0xFF
        size = 192 if size == 1 else 576 << size - 2 if size <= 5 else bits.take(8) + 1 if size == 6 else bits.take(16) + 1 if size == 7 else 256 << size - 8
        if hz >= 12:
            bits.take(8 if hz == 12 else 16)
        bits.take(8)
        n = layout + 1 if layout < 8 else 2
        parts = [_subframe(bits, size, width + (layout in (8, 10) and k == 1 or layout == 9 and k == 0)) for k in range(n)]
        if layout == 8:
            parts[1] = [a - b for a, b in zip(*parts, strict=True)]
        elif layout == 9:
            parts[0] = [a + b for a, b in zip(*parts, strict=True)]
        elif layout == 10:
            both = [((m << 1 | s & 1) + s >> 1, (m << 1 | s & 1) - s >> 1) for m, s in zip(*parts, strict=True)]
            parts = [[a for a, _ in both], [b for _, b in both]]
        bits.at += -bits.at % 8
        bits.take(16)
        for own, part in zip(out, parts, strict=False):
            own += part
    return Sound(np.array(out, np.int64).reshape(channels, -1), rate, depth)


def _crc(data: bytes, width: int, poly: int) -> int:
    crc, top = 0, 1 << width - 1
    for b in data:
        crc ^= b << width - 8
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc & top else crc << 1) & (1 << width) - 1
    return crc


def encode_flac(s: Sound, block: int = 4096) -> bytes:
    """Second differences of each channel, by the Rice code that suits a block; no stereo prediction."""
    channels, n = s.samples.shape
    info = struct.pack(">HH", block, block) + bytes(6) + (s.rate << 44 | channels - 1 << 41 | s.bits - 1 << 36 | n).to_bytes(8, "big") + bytes(16)
    out = bytearray(b"fLaC\x80" + len(info).to_bytes(3, "big") + info)
    for number, at in enumerate(range(0, n, block)):
        part = s.samples[:, at : at + block]
        size = part.shape[1]
        code = bytes([number]) if number < 128 else chr(number).encode("utf-8", "surrogatepass")
        head = bytes([0xFF, 0xF8, 0x70, channels - 1 << 4]) + code + struct.pack(">H", size - 1)
        head += bytes([_crc(head, 8, 0x07)])
        text = ""
        for x in part:
            if size <= 2:
                text += "00000010" + "".join(f"{int(v) & (1 << s.bits) - 1:0{s.bits}b}" for v in x)
                continue
            d = np.diff(x, 2)
            folded = np.where(d >= 0, 2 * d, -2 * d - 1)
            k = int(np.clip(np.floor(np.log2(folded.mean() + 1)), 0, 14))
            text += "00010100" + "".join(f"{int(v) & (1 << s.bits) - 1:0{s.bits}b}" for v in x[:2]) + "000000" + f"{k:04b}"
            text += "".join("0" * (int(v) >> k) + "1" + (f"{int(v) & (1 << k) - 1:0{k}b}" if k else "") for v in folded)
        text += "0" * (-len(text) % 8)
        frame = head + int(text, 2).to_bytes(len(text) // 8, "big")
        out += frame + struct.pack(">H", _crc(frame, 16, 0x8005))
    return bytes(out)


# QOA


def _qoa_table() -> np.ndarray:
    """Scale factors are the 2.75th powers of 1 to 16; residuals 0.75, 2.5, 4.5 and 7 of these, rounded away from zero at halves, and their negatives."""
    scales = [round((k + 1) ** 2.75) for k in range(16)]
    pick = lambda x: int(np.sign(x) * np.floor(abs(x) + 0.5))
    return np.array([[pick(sign * s * f) for f in (0.75, 2.5, 4.5, 7.0) for sign in (1, -1)] for s in scales])


QOA = _qoa_table()


def decode_qoa(raw: bytes) -> Sound:
    if raw[:4] != b"qoaf":
        raise CodecError("no qoaf")
    total, at = struct.unpack_from(">I", raw, 4)[0], 8
    out: list[list[int]] = []
    rate = 0
    while at + 8 <= len(raw):
        channels, rate, n, size = raw[at], int.from_bytes(raw[at + 1 : at + 4], "big"), *struct.unpack_from(">HH", raw, at + 4)
        out = out or [[] for _ in range(channels)]
        p = at + 8
        states = []
        for _ in range(channels):
            states.append([list(struct.unpack_from(">4h", raw, p)), list(struct.unpack_from(">4h", raw, p + 8))])
            p += 16
        for first in range(0, n, 20):
            for c in range(channels):
                word = struct.unpack_from(">Q", raw, p)[0]
                p += 8
                row, (history, weights) = QOA[word >> 60], states[c]
                for k in range(min(20, n - first)):
                    x, _ = _qoa_step(history, weights, int(row[word >> 57 - 3 * k & 7]))
                    out[c].append(x)
        at += size
    return Sound(np.array(out, np.int64).reshape(len(out), -1)[:, :total], rate)


def _qoa_step(history: list[int], weights: list[int], residual: int) -> tuple[int, int]:
    guess = sum(h * w for h, w in zip(history, weights, strict=True)) >> 13
    x = max(-32768, min(32767, guess + residual))
    delta = residual >> 4
    for k in range(4):
        weights[k] += -delta if history[k] < 0 else delta
    history[:] = [*history[1:], x]
    return x, guess


def encode_qoa(s: Sound) -> bytes:
    """Each slice of twenty samples by the scale that leaves the least squared error."""
    channels, n = s.samples.shape
    out = bytearray(b"qoaf" + struct.pack(">I", n))
    states = [[[0, 0, 0, 0], [0, 0, -(1 << 13), 1 << 14]] for _ in range(channels)]
    for at in range(0, n, 5120):
        part = s.samples[:, at : at + 5120]
        size, slices = part.shape[1], -(-part.shape[1] // 20)
        body = b"".join(struct.pack(">4h4h", *h, *[max(-32768, min(32767, x)) for x in w]) for h, w in states)
        for first in range(0, size, 20):
            for c in range(channels):
                best = None
                for scale in range(16):
                    h, w = [list(x) for x in states[c]]
                    word, error = scale, 0
                    for x in part[c, first : first + 20].tolist():
                        want = x - (sum(a * b for a, b in zip(h, w, strict=True)) >> 13)
                        k = int(np.abs(QOA[scale] - want).argmin())
                        got, _ = _qoa_step(h, w, int(QOA[scale][k]))
                        error += (got - x) ** 2
                        word = word << 3 | k
                        if best and error >= best[0]:
                            break
                    if not best or error < best[0]:
                        word <<= 3 * (20 - len(part[c, first : first + 20]))
                        best = (error, word, [h, w])
                states[c] = best[2]
                body += struct.pack(">Q", best[1])
        out += bytes([channels]) + s.rate.to_bytes(3, "big") + struct.pack(">HH", size, 8 + 16 * channels + 8 * slices * channels) + body
    return bytes(out)


# Flash ADPCM

#: How the step index moves, for codes of 2 to 5 bits.
SWF_MOVES = {2: (-1, 2), 3: (-1, -1, 2, 4), 4: (-1, -1, -1, -1, 2, 4, 6, 8), 5: (-1, -1, -1, -1, -1, -1, -1, -1, 1, 2, 4, 6, 8, 10, 13, 16)}


def decode_swf(raw: bytes, channels: int = 1) -> np.ndarray:
    """(channels, samples): the number of bits of a code, then runs of a first sample, a step index and up to 4095 codes for each channel."""
    bits = _Bits(raw)
    width = bits.take(2) + 2
    moves, top = SWF_MOVES[width], 1 << width - 1
    out: list[list[int]] = [[] for _ in range(channels)]
    while bits.at + 22 * channels <= bits.end:
        state = [[bits.signed(16), bits.take(6)] for _ in range(channels)]
        for c in range(channels):
            out[c].append(state[c][0])
        for _ in range(4095):
            if bits.at + width * channels > bits.end:
                break
            for c, s in enumerate(state):
                code = bits.take(width)
                step, change, bit = STEPS[min(88, s[1])], 0, top >> 1
                while bit:
                    if code & bit:
                        change += step
                    step >>= 1
                    bit >>= 1
                change += step
                s[0] = max(-32768, min(32767, s[0] - change if code & top else s[0] + change))
                s[1] = max(0, min(88, s[1] + moves[code & top - 1]))
                out[c].append(s[0])
    return np.array(out, np.int64)


# Packed pictures: planes of (rows, columns), values as they are stored


def decode_v210(raw: bytes, w: int, h: int) -> list[np.ndarray]:
    """Y, U, V of 10 bits, chroma of half the width: six pixels in four words, lines of a multiple of 128 bytes."""
    line = -(-w // 48) * 128
    words = np.frombuffer(raw, "<u4", line * h // 4).reshape(h, line // 4)
    parts = np.stack([words >> s & 0x3FF for s in (0, 10, 20)], axis=2).reshape(h, -1)
    return [parts[:, 1::2][:, :w].astype(np.uint16), parts[:, 0::4][:, : (w + 1) // 2].astype(np.uint16), parts[:, 2::4][:, : (w + 1) // 2].astype(np.uint16)]


def encode_v210(planes: list[np.ndarray]) -> bytes:
    y, u, v = (np.asarray(p, np.uint32) for p in planes)
    h, w = y.shape
    line = -(-w // 48) * 32
    parts = np.zeros((h, line * 3), np.uint32)
    parts[:, 1 : 2 * w : 2], parts[:, 0 : 4 * u.shape[1] : 4], parts[:, 2 : 2 + 4 * v.shape[1] : 4] = y, u, v
    t = parts.reshape(h, line, 3)
    return (t[..., 0] | t[..., 1] << 10 | t[..., 2] << 20).astype("<u4").tobytes()


def _rgb10(shift: int, order: str) -> tuple[Callable, Callable]:
    """Red, green and blue of 10 bits in a word; ``shift``: bits below blue. Lines of r210 have a multiple of 64 pixels."""

    def pad(w: int) -> int:
        return w + -w % 64 if not shift else w

    def decode(raw: bytes, w: int, h: int) -> list[np.ndarray]:
        words = np.frombuffer(raw, order + "u4", pad(w) * h).reshape(h, -1)[:, :w]
        return [(words >> shift + s & 0x3FF).astype(np.uint16) for s in (20, 10, 0)]

    def encode(planes: list[np.ndarray]) -> bytes:
        r, g, b = (np.asarray(p, np.uint32) for p in planes)
        words = r << shift + 20 | g << shift + 10 | b << shift
        return np.pad(words, ((0, 0), (0, pad(words.shape[1]) - words.shape[1]))).astype(order + "u4").tobytes()

    return decode, encode


def decode_y41p(raw: bytes, w: int, h: int) -> list[np.ndarray]:
    """Eight pixels in twelve bytes, chroma of a quarter of the width; rows from the bottom up."""
    t = np.frombuffer(raw, np.uint8, w // 8 * 12 * h).reshape(h, w // 8, 12)[::-1]
    return [t[..., [1, 3, 5, 7, 8, 9, 10, 11]].reshape(h, -1), t[..., [0, 4]].reshape(h, -1), t[..., [2, 6]].reshape(h, -1)]


def encode_y41p(planes: list[np.ndarray]) -> bytes:
    y, u, v = planes
    h, w = y.shape
    t = np.zeros((h, w // 8, 12), np.uint8)
    t[..., [1, 3, 5, 7, 8, 9, 10, 11]], t[..., [0, 4]], t[..., [2, 6]] = y.reshape(h, -1, 8), u.reshape(h, -1, 2), v.reshape(h, -1, 2)
    return t[::-1].tobytes()


PICTURES: dict[str, tuple[Callable[[bytes, int, int], list[np.ndarray]], Callable[[list[np.ndarray]], bytes]]] = {
    "v210": (decode_v210, encode_v210), "r210": _rgb10(0, ">"), "r10k": _rgb10(2, ">"), "y41p": (decode_y41p, encode_y41p),
}
SOUNDS: dict[str, tuple[Callable[[bytes], Sound], Callable[[Sound], bytes]]] = {"flac": (decode_flac, encode_flac), "qoa": (decode_qoa, encode_qoa)}


def decode_sounds(files: DataFrame, codec: str, column: str = "content") -> DataFrame:
    """Adds rate, bits and samples (an array for each channel, whole numbers); ``error`` says what is wrong with what can't be read."""

    def one(raw: bytes) -> tuple:
        try:
            s = SOUNDS[codec][0](bytes(raw))
            return s.rate, s.bits, s.samples.tolist(), None
        except (CodecError, IndexError, struct.error) as e:
            return None, None, None, str(e) or type(e).__name__

    return payload.each(files, one, [column], "rate int, bits int, samples array<array<long>>, error string")


def encode_sounds(sounds: DataFrame, codec: str) -> DataFrame:
    """Adds ``content`` of each row's samples, rate and bits."""
    return payload.each(sounds, lambda xs, rate, bits: (SOUNDS[codec][1](Sound(np.array(xs, np.int64).reshape(len(xs), -1), rate, bits)),), ["samples", "rate", "bits"], "content binary")


def decode_pictures(packets: DataFrame, codec: str, w: int, h: int) -> DataFrame:
    """Adds ``planes``: arrays row by row, of the sizes that the format has."""
    return payload.each(packets, lambda raw: ([p.reshape(-1).tolist() for p in PICTURES[codec][0](bytes(raw), w, h)],), ["payload"], "planes array<array<int>>")
