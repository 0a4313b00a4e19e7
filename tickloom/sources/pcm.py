"""PCM, companded and ADPCM sample formats: bytes to samples from -1 to 1, and back."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from . import payload

#: Whole numbers: name to (bytes, whether they are signed, byte order).
WHOLE = {"s8": (1, True, "<"), "u8": (1, False, "<")} | {f"{s}{bits}{e}": (bits // 8, s == "s", "<" if e == "le" else ">") for s in "su" for bits in (16, 24, 32) for e in ("le", "be")}
FLOAT = {f"f{bits}{e}": np.dtype(("<" if e == "le" else ">") + f"f{bits // 8}") for bits in (32, 64) for e in ("le", "be")}


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) * 8 + 132) << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.float64)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, low = code >> 4 & 7, (code & 15) * 16
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.float64)


COMPANDED = {"mulaw": _mulaw(), "alaw": _alaw()}


def _bytes_of(kind: str) -> int:
    return WHOLE[kind][0] if kind in WHOLE else FLOAT[kind].itemsize if kind in FLOAT else 1


def decode(data: bytes, kind: str) -> np.ndarray:
    """Samples as doubles; an incomplete one at the end is left out."""
    n = len(data) // _bytes_of(kind)
    if kind in FLOAT:
        return np.frombuffer(data, FLOAT[kind], n).astype(np.float64)
    if kind in COMPANDED:
        return COMPANDED[kind][np.frombuffer(data, np.uint8)] / 32768
    size, signed, order = WHOLE[kind]
    raw = np.frombuffer(data, np.uint8, n * size).reshape(n, size).astype(np.int64)
    if order == ">":
        raw = raw[:, ::-1]
    value = (raw << (8 * np.arange(size))).sum(axis=1)
    half = 1 << (8 * size - 1)
    value = np.where(value >= half, value - 2 * half, value) if signed else value - half
    return value / half


def encode(samples: np.ndarray, kind: str) -> bytes:
    """Rounded to the nearest step, halves to even, and cut at both ends; NaN becomes 0."""
    x = np.nan_to_num(np.asarray(samples, np.float64), posinf=1.0, neginf=-1.0)
    if kind in FLOAT:
        return x.astype(FLOAT[kind]).tobytes()
    if kind in COMPANDED:
        table = COMPANDED[kind]
        order = np.argsort(table, kind="stable")
        known = table[order]
        return order[np.searchsorted((known[1:] + known[:-1]) / 2, x * 32768)].astype(np.uint8).tobytes()
    size, signed, byteorder = WHOLE[kind]
    half = 1 << (8 * size - 1)
    value = np.clip(np.rint(x * half), -half, half - 1).astype(np.int64) + (0 if signed else half)
    raw = (value[:, None] >> (8 * np.arange(size)) & 255).astype(np.uint8)
    return (raw if byteorder == "<" else raw[:, ::-1]).tobytes()


#: How the IMA step index moves with the lower bits of a code, and the first step size.
MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)
#: The IMA step sizes.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350,
    22385, 24623, 27086, 29794, 32767,
)


def _moved(value: int, index: int, code: int) -> tuple[int, int]:
    step = STEPS[index]
    change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
    value = max(-32768, min(32767, value - change if code & 8 else value + change))
    return value, max(0, min(88, index + MOVES[code & 7]))


def _chosen(target: int, value: int, index: int) -> int:
    """The code that brings ``value`` nearest to ``target``."""
    return min(range(16), key=lambda c: (abs(_moved(value, index, c)[0] - target), c))


def decode_ima_wav(block: bytes) -> list[int]:
    """One channel's block: the first sample and the step index, then two codes a byte, the lower one first."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(88, block[2])
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            value, index = _moved(value, index, code)
            out.append(value)
    return out


def encode_ima_wav(samples: list[int], index: int = 0) -> bytes:
    """A block of an odd number of 16-bit samples."""
    value = samples[0]
    out = bytearray(value.to_bytes(2, "little", signed=True) + bytes([index, 0]))
    codes = []
    for s in samples[1:]:
        code = _chosen(s, value, index)
        value, index = _moved(value, index, code)
        codes.append(code)
    out += bytes(a | b << 4 for a, b in zip(codes[::2], codes[1::2], strict=True))
    return bytes(out)


def decode_ima_qt(block: bytes) -> list[int]:
    """A chunk of 34 bytes: nine bits of the first value and seven of the step index, then 64 codes."""
    head = int.from_bytes(block[:2], "big")
    value, index = head & 0xFF80, min(88, head & 0x7F)
    value -= 65536 if value >= 32768 else 0
    out = []
    for byte in block[2:34]:
        for code in (byte & 15, byte >> 4):
            value, index = _moved(value, index, code)
            out.append(value)
    return out


def encode_ima_qt(samples: list[int], value: int = 0, index: int = 0) -> bytes:
    """A chunk of 64 samples."""
    value = (value & 0xFF80) - (65536 if value & 0x8000 else 0)
    out = bytearray(((value & 0xFF80) | index).to_bytes(2, "big"))
    codes = []
    for s in samples[:64]:
        code = _chosen(s, value, index)
        value, index = _moved(value, index, code)
        codes.append(code)
    return bytes(out + bytes(a | b << 4 for a, b in zip(codes[::2], codes[1::2], strict=True)))


#: Fixed values of MS ADPCM: how the delta grows with a code, and the pairs of predictor weights.
MS_GROWTH = (230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230)
MS_WEIGHTS = ((256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232))


def decode_ms(block: bytes) -> list[int]:
    """One channel's block: predictor, delta, two samples (the newer first), then two codes a byte, the upper one first."""
    c1, c2 = MS_WEIGHTS[min(6, block[0])]
    delta, new, old = (int.from_bytes(block[k : k + 2], "little", signed=True) for k in (1, 3, 5))
    out = [old, new]
    for byte in block[7:]:
        for code in (byte >> 4, byte & 15):
            guess = (new * c1 + old * c2) // 256
            value = max(-32768, min(32767, guess + (code - 16 if code & 8 else code) * delta))
            old, new, delta = new, value, max(16, MS_GROWTH[code] * delta // 256)
            out.append(value)
    return out


def encode_ms(samples: list[int], predictor: int = 0, delta: int = 16) -> bytes:
    """A block of an even number of samples, two at least."""
    c1, c2 = MS_WEIGHTS[predictor]
    old, new = samples[:2]
    out = bytearray([predictor]) + b"".join(int(x).to_bytes(2, "little", signed=True) for x in (delta, new, old))
    codes = []
    for s in samples[2:]:
        guess = (new * c1 + old * c2) // 256
        code = max(-8, min(7, round((s - guess) / delta))) & 15
        value = max(-32768, min(32767, guess + (code - 16 if code & 8 else code) * delta))
        old, new, delta = new, value, max(16, MS_GROWTH[code] * delta // 256)
        codes.append(code)
    return bytes(out + bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)))


#: Decoders of whole blocks to 16-bit samples.
ADPCM: dict[str, Callable[[bytes], list[int]]] = {"adpcm_ima_wav": decode_ima_wav, "adpcm_ima_qt": decode_ima_qt, "adpcm_ms": decode_ms}
KINDS = (*WHOLE, *FLOAT, *COMPANDED)


def decode_column(packets: DataFrame, kind: str) -> DataFrame:
    """Adds ``samples`` (doubles) of each ``payload``; of a format of ``KINDS``, or blocks of one of ``ADPCM``."""
    if kind in ADPCM:
        return payload.each(packets, lambda data: ([x / 32768 for x in ADPCM[kind](bytes(data))],), ["payload"], "samples array<double>")
    return payload.each(packets, lambda data: (decode(bytes(data), kind).tolist(),), ["payload"], "samples array<double>")


def encode_column(blocks: DataFrame, kind: str) -> DataFrame:
    """Adds ``payload`` of each array ``samples``; nulls in it count as 0."""
    return payload.each(blocks, lambda xs: (encode(np.array([0.0 if x is None else x for x in xs]), kind),), ["samples"], "payload binary")
