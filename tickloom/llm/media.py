"""Telephony audio as media columns: mu-law, A-law and IMA ADPCM, decoded by tables and numpy; resampled PCM.

A media column holds bytes of a RIFF/WAVE file. G.711 codes are expanded by tables of 256 entries, which follow from
the companding rules. ADPCM is decoded block by block in time, but for all blocks of a batch at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._arrow import bound_batches, id_and_text, slices

PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11
RATE = 8000
#: Bytes of a block of ADPCM, and what payloads are padded to.
BLOCK = 576
#: How the IMA step index moves with the three lower bits of a code.
STEP_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)
#: The IMA step sizes.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350,
    22385, 24623, 27086, 29794, 32767,
)


def mulaw_table() -> np.ndarray:
    """Linear 16-bit values of the 256 mu-law codes."""
    code = ~np.arange(256, dtype=np.int32) & 255
    value = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -value, value).astype(np.int16)


def alaw_table() -> np.ndarray:
    """Linear 16-bit values of the 256 A-law codes."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (code >> 4) & 7, (code & 15) << 4
    value = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, value, -value).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()
_STEPS, _MOVES = np.array(STEPS, np.int32), np.array(STEP_MOVES * 2, np.int32)
#: For each step index and code: the change of the sample, and the next step index.
_DELTA = np.array([[(s >> 3) + (s if c & 4 else 0) + (s >> 1 if c & 2 else 0) + (s >> 2 if c & 1 else 0) for c in range(8)] for s in STEPS], np.int32)
_DELTA = np.concatenate([_DELTA, -_DELTA], axis=1).reshape(-1)
_NEXT = np.clip(np.arange(len(STEPS))[:, None] + _MOVES[None], 0, len(STEPS) - 1).astype(np.int32).reshape(-1)


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(blocks, samples) of mono IMA ADPCM blocks, given as rows of bytes: a 4-byte head, then two codes a byte.

    A step index beyond the table counts as the last one."""
    n, size = blocks.shape
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    step = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    out[0] = head
    value, at = head, 1
    for row in codes:
        for code in (row & 15, row >> 4):
            cell = (step << 4) + code
            value = np.clip(value + _DELTA[cell], -32768, 32767)
            step = _NEXT[cell]
            out[at] = value
            at += 1
    return out.T


def resample(pcm: np.ndarray, source: int = RATE, target: int = 2 * RATE) -> np.ndarray:
    """Linear interpolation on the target's grid, in whole numbers; the last sample is held."""
    n = len(pcm)
    if not n:
        return pcm.astype(np.int16)
    place = np.arange(-(-n * target // source), dtype=np.int64) * source
    left, rest = place // target, place % target
    x = pcm.astype(np.int64)
    a, b = x[left], x[np.minimum(left + 1, n - 1)]
    return ((a * (target - rest) + b * rest + target // 2) // target).astype(np.int16)


def wave(payload: bytes, kind: int, rate: int = RATE, align: int = 1, bits: int = 8, extra: bytes = b"") -> bytes:
    """A mono RIFF/WAVE file."""
    per_second = rate * align if kind != IMA else rate * align // (2 * (align - 4) + 1)
    head = struct.pack("<HHIIHH", kind, 1, rate, per_second, align, bits)
    if kind != PCM:
        head += struct.pack("<H", len(extra)) + extra
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(raw: bytes) -> tuple[int, int, bytes]:
    """(kind, rate, payload) of a RIFF/WAVE file; chunks that aren't known are passed over."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, kind, rate = 12, None, None
    while at + 8 <= len(raw):
        name, n = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate = struct.unpack_from("<HHI", raw, at + 8)
        elif name == b"data":
            if kind is None:
                raise ValueError("data before format")
            return kind, rate, raw[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def to_pcm(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a file of any kind handled here."""
    kind, rate, payload = read_wave(raw)
    data = np.frombuffer(payload, np.uint8)
    if kind == MULAW:
        return rate, MULAW_PCM[data]
    if kind == ALAW:
        return rate, ALAW_PCM[data]
    if kind == IMA:
        return rate, decode_ima(data[: len(data) // BLOCK * BLOCK].reshape(-1, BLOCK)).reshape(-1)
    if kind == PCM:
        return rate, np.frombuffer(payload[: len(payload) // 2 * 2], "<i2")
    raise ValueError(f"format {kind} is not handled")


def padded(text: bytes, multiple: int = BLOCK) -> bytes:
    """Bytes 255 are added up to a positive multiple."""
    return text + b"\xff" * (max(1, -(-len(text) // multiple)) * multiple - len(text))


def features(payload: bytes, ima: np.ndarray, rate: int, wide: bytes) -> str:
    """Whole-number measures of what is stored, expanded by either law, decoded as ADPCM, and of the resampled PCM."""
    data = np.frombuffer(payload, np.uint8)
    linear, other = MULAW_PCM[data], ALAW_PCM[data]
    energy = int((linear.astype(np.int64) ** 2).sum()) // len(linear)
    crossings = int(((linear[1:] < 0) != (linear[:-1] < 0)).sum())
    return f"mulaw_power={energy};mulaw_crossings={crossings};alaw_peak={int(np.abs(other.astype(np.int32)).max())};adpcm_crc32={zlib.crc32(ima.tobytes())};pcm_{rate}_crc32={zlib.crc32(wide)}"


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as the mu-law samples of a WAVE file; a null text counts as empty."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t.encode() for t in part.column("text").to_pylist()]
            media = [wave(padded(t), MULAW) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def store_pcm(media: DataFrame, target: int = 2 * RATE) -> DataFrame:
    """Adds the column ``pcm``: each file decoded to 16-bit PCM, resampled to ``target`` and stored as a file again.

    A null stays null. All other columns stay, but an older ``pcm`` is replaced."""
    bound_batches(media.sparkSession)

    def one(raw: bytes | None) -> bytes | None:
        if raw is None:
            return None
        rate, pcm = to_pcm(raw)
        return wave(resample(pcm, rate, target).tobytes(), PCM, target, 2, 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", 1 << 20):  # four times as much comes out
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(one, part.column("media").to_pylist()), pa.binary())], names=[*part.schema.names, "pcm"])

    own = media.drop("pcm")
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("pcm", T.BinaryType())]))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def describe(media: DataFrame) -> DataFrame:
    """Reads both media columns of ``store_pcm(encode_media(..))`` back and describes them; one row each.

    feature: the mean power and the sign changes of the mu-law samples, the peak of the same bytes as A-law, and checksums
    of the same bytes as ADPCM and of the samples that the stored PCM holds.
    Equal texts give equal values. Repeated rows give repeated rows, an empty table none; the payload of an empty text is
    one block of bytes 255.
    """
    bound_batches(media.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", 1 << 20):
            stored, wide = part.column("media").to_pylist(), [read_wave(raw)[1:] for raw in part.column("pcm").to_pylist()]
            payloads = [read_wave(raw)[2] for raw in stored]
            # the payloads are whole blocks: all of them are decoded together
            count = [len(p) // BLOCK for p in payloads]
            ima = decode_ima(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK))
            at, rows = 0, []
            for p, raw, n, pcm in zip(payloads, stored, count, wide, strict=True):
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), features(p, ima[at : at + n], *pcm)))
                at += n
            columns = [pa.array(c) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *columns], names=names)

    return media.mapInArrow(run, SCHEMA)
