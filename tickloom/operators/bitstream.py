"""Bitstream filters: packets to packets. A packet has pts, dts, duration, flags (1: key) and ``payload`` (bytes)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import to_column
from ..sources import payload as payloads
from .order import ordered, tie

START3, START4 = b"\0\0\1", b"\0\0\0\1"


def chomp(payload: Column) -> Column:
    """Without the zero bytes at its end."""
    return F.unhex(F.regexp_replace(F.hex(payload), "(00)+$", ""))


def remove_extra(payload: Column, extradata: Column) -> Column:
    """Without the extradata that it starts with."""
    text, start = F.hex(payload), F.hex(extradata)
    return F.when(F.startswith(text, start), F.unhex(F.substring(text, F.length(start) + 1, F.length(text)))).otherwise(payload)


def dump_extra(payload: Column, extradata: Column, key: Column) -> Column:
    """Key packets get the extradata in front, unless they start with it."""
    return F.when(key & ~F.startswith(F.hex(payload), F.hex(extradata)), F.concat(extradata, payload)).otherwise(payload)


def setts(packets: DataFrame, by: str, pts: str = "PTS", dts: str = "DTS", duration: str = "DURATION") -> DataFrame:
    """New time stamps by expressions of N, PTS, DTS, DURATION, PREV_INPTS, PREV_INDTS, PREV_INDURATION, NEXT_PTS, NEXT_DTS, NEXT_DURATION and
    STARTPTS, STARTDTS; NaN leaves none."""
    w = ordered(by, *tie(packets)) if "pts" in packets.columns else None
    names = {"PTS": "pts", "DTS": "dts", "DURATION": "duration"}
    known: dict[str, Column] = {k: F.col(c) for k, c in names.items()}
    known |= {f"PREV_IN{k}": F.lag(c).over(w) for k, c in names.items()} | {f"NEXT_{k}": F.lead(c).over(w) for k, c in names.items()}
    known |= {f"START{k}": F.first(names[k]).over(w) for k in ("PTS", "DTS")} | {"N": F.row_number().over(w) - 1}
    made = packets.withColumns({f"_{k}": c for k, c in known.items()})
    bound = {k: F.col(f"_{k}") for k in known}
    new = {c: to_column(text, bound) for c, text in (("pts", pts), ("dts", dts), ("duration", duration))}
    return made.withColumns({c: F.when(~F.isnan(x), x.cast("long")) for c, x in new.items()}).drop(*[f"_{k}" for k in known])


def noise(packets: DataFrame, amount: int, drop: int = 0, seed: int = 0) -> DataFrame:
    """About every ``amount``-th byte is damaged, and every ``drop``-th packet goes (0: none): by hashes of the packet and the seed."""

    def one(data: bytes, key: int) -> tuple:
        import numpy as np

        raw = np.frombuffer(data, np.uint8).copy()
        rng = np.random.default_rng([seed, key & ((1 << 63) - 1)])
        hit = rng.random(len(raw)) < 1 / amount
        raw[hit] ^= rng.integers(1, 256, int(hit.sum()), dtype=np.uint8)
        return (raw.tobytes(),)

    own = packets if not drop else packets.filter(F.pmod(F.xxhash64("payload", "pts", F.lit(seed)), F.lit(drop)) != 0)
    keyed = own.withColumn("_key", F.xxhash64("payload", "pts"))
    return payloads.each(keyed, one, ["payload", "_key"], "payload binary").drop("_key")


def showinfo(packets: DataFrame, by: str) -> DataFrame:
    """(by, n, pts, dts, size, flags, adler32) of each packet."""
    from ..sources.packets import adler32

    n = F.row_number().over(ordered(by, *tie(packets))) - 1
    return packets.select(by, n.alias("n"), "pts", "dts", F.octet_length("payload").alias("size"), "flags", adler32(F.col("payload")).alias("adler32"))


# Units between start codes, or behind lengths


def split_annexb(data: bytes) -> list[bytes]:
    """The units between start codes; zeros at a unit's end belong to the next start code."""
    out, at = [], data.find(START3)
    while at >= 0:
        to = data.find(START3, at + 3)
        unit = data[at + 3 : to if to >= 0 else len(data)].rstrip(b"\0")
        if unit:
            out.append(unit)
        at = to
    return out


def split_lengths(data: bytes, size: int = 4) -> list[bytes]:
    """The units behind lengths of ``size`` bytes; one that is cut short ends the list."""
    out, at = [], 0
    while at + size <= len(data):
        n = int.from_bytes(data[at : at + size], "big")
        if at + size + n > len(data):
            break
        out.append(data[at + size : at + size + n])
        at += size + n
    return out


def nal_type(unit: bytes, codec: str) -> int:
    return unit[0] & 31 if codec == "h264" else unit[0] >> 1 & 63


#: Types of parameter sets, and of units that start a picture that can be decoded alone.
PARAMETER_SETS = {"h264": (7, 8), "hevc": (32, 33, 34)}
RANDOM_ACCESS = {"h264": range(5, 6), "hevc": range(16, 24)}


def to_annexb(data: bytes, codec: str, extradata: list[bytes] = (), size: int = 4) -> bytes:
    """Lengths become start codes; ``extradata`` (parameter sets) goes before a picture that can be decoded alone, unless the packet has
    parameter sets of its own."""
    units = split_lengths(data, size)
    kinds = [nal_type(u, codec) for u in units if u]
    more = list(extradata) if any(k in RANDOM_ACCESS[codec] for k in kinds) and not any(k in PARAMETER_SETS[codec] for k in kinds) else []
    return b"".join(START4 + u for u in [*more, *units])


def mp4toannexb(packets: DataFrame, codec: str, extradata: list[bytes] = (), size: int = 4) -> DataFrame:
    return payloads.each(packets, lambda data: (to_annexb(bytes(data), codec, extradata, size),), ["payload"], "payload binary")


def filter_units(packets: DataFrame, codec: str, remove: list[int] = (), keep: list[int] | None = None) -> DataFrame:
    """Units of some types go, or all others (``keep``); a packet without units goes as a whole."""

    def one(data: bytes) -> list[tuple]:
        units = [u for u in split_annexb(bytes(data)) if (nal_type(u, codec) in keep if keep is not None else nal_type(u, codec) not in remove)]
        return [(b"".join(START4 + u for u in units),)] if units else []

    return payloads.rows(packets, one, ["payload"], "payload binary")


def extract_extradata(packets: DataFrame, codec: str, remove: bool = False) -> DataFrame:
    """Adds ``extradata``: the packet's parameter sets, null if it has none; ``remove`` takes them out of the payload."""

    def one(data: bytes) -> tuple:
        units = split_annexb(bytes(data))
        sets = [u for u in units if nal_type(u, codec) in PARAMETER_SETS[codec]]
        rest = [u for u in units if nal_type(u, codec) not in PARAMETER_SETS[codec]]
        return (b"".join(START4 + u for u in rest) if remove else bytes(data), b"".join(START4 + u for u in sets) if sets else None)

    return payloads.each(packets, one, ["payload"], "payload binary, extradata binary")


def trace_headers(packets: DataFrame, codec: str) -> DataFrame:
    """A row for each unit: its number in the packet, type, reference or layer bits and size."""

    def one(data: bytes) -> Iterator[tuple]:
        for k, u in enumerate(split_annexb(bytes(data))):
            yield (k, nal_type(u, codec), u[0] >> 5 & 3 if codec == "h264" else (u[0] & 1) << 5 | (u[1] >> 3 if len(u) > 1 else 0), len(u))

    return payloads.rows(packets, one, ["payload"], "unit int, unit_type int, ref int, size int").drop("payload")


# Audio


def adts_to_asc(data: bytes) -> tuple[bytes, bytes]:
    """(frame without its header, audio specific configuration): two bytes of object type, rate index and channels."""
    if len(data) < 7 or data[0] != 0xFF or data[1] & 0xF6 != 0xF0:
        raise ValueError("no ADTS header")
    head = 7 if data[1] & 1 else 9
    kind, rate, channels = (data[2] >> 6) + 1, data[2] >> 2 & 15, (data[2] & 1) << 2 | data[3] >> 6
    return data[head:], (kind << 11 | rate << 7 | channels << 3).to_bytes(2, "big")


def aac_adtstoasc(packets: DataFrame) -> DataFrame:
    """Adds ``extradata`` and takes the header off; packets without one stay, with null."""

    def one(data: bytes) -> tuple:
        try:
            return adts_to_asc(bytes(data))
        except ValueError:
            return bytes(data), None

    return payloads.each(packets, one, ["payload"], "payload binary, extradata binary")


def opus_metadata(extradata: Column, gain: int) -> Column:
    """The output gain, 16 bits at byte 16 of the head, replaced."""
    new = (gain & 0xFFFF).to_bytes(2, "little").hex().upper()
    text = F.hex(extradata)
    return F.when(F.startswith(text, F.lit(b"OpusHead".hex().upper())), F.unhex(F.concat(F.substring(text, 1, 32), F.lit(new), F.substring(text, 37, 1 << 20)))).otherwise(extradata)


def pcm_rechunk(packets: DataFrame, by: str, size: int, pad: bool = True) -> DataFrame:
    """(by, n, payload): a stream's bytes in packets of ``size``; the last one is filled with zeros, or shorter.

    Each packet is cut where the new ones meet, and only the pieces are brought together."""
    n = F.octet_length("payload").cast("long")
    end = F.sum(n).over(ordered(by, *tie(packets)).rowsBetween(Window.unboundedPreceding, 0))
    own = packets.withColumn("_from", end - n).withColumn("_to", end).filter("_to > _from")
    pieces = own.withColumn("n", F.explode(F.sequence(F.floor(F.col("_from") / size), F.floor((F.col("_to") - 1) / size))))
    low, high = F.greatest(F.col("_from"), F.col("n") * size), F.least(F.col("_to"), (F.col("n") + 1) * size)
    cut = F.hex(F.substring(F.col("payload"), (low - F.col("_from") + 1).cast("int"), (high - low).cast("int")))
    found = pieces.groupBy(by, "n").agg(F.array_sort(F.collect_list(F.struct(low.alias("at"), cut.alias("hex")))).alias("_p"))
    text = F.concat_ws("", F.transform("_p", lambda p: p["hex"]))
    return found.select(by, "n", F.unhex(F.rpad(text, 2 * size, "0") if pad else text).alias("payload"))


# Subtitles


def text2movsub(payload: Column) -> Column:
    """A length of 16 bits before the text."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(payload).cast("long")), 4, "0")), payload)


def mov2textsub(payload: Column) -> Column:
    """The text that the length in front says, styles behind it left out; empty without a length."""
    n = F.conv(F.hex(F.substring(payload, 1, 2)), 16, 10).cast("int")
    return F.when(F.octet_length(payload) < 2, F.lit(b"")).otherwise(F.substring(payload, F.lit(3), n))


# AV1 and VP9


def split_obus(data: bytes) -> list[tuple[int, bytes]]:
    """(type, whole unit) of the units of a temporal unit; one without a size takes the rest."""
    out, at = [], 0
    while at < len(data):
        head, start = data[at], at
        at += 2 if head & 4 else 1
        if head & 2:
            n = shift = 0
            while at < len(data):
                n |= (data[at] & 127) << shift
                shift += 7
                at += 1
                if not data[at - 1] & 128:
                    break
        else:
            n = len(data) - at
        out.append((head >> 3 & 15, data[start : at + n]))
        at += n
    return out


def av1_frame_split(packets: DataFrame) -> DataFrame:
    """A packet for each unit; ``obu`` is its type."""
    return payloads.rows(packets, lambda data: [(u, kind) for kind, u in split_obus(bytes(data))], ["payload"], "payload binary, obu int")


def av1_frame_merge(packets: DataFrame, by: str) -> DataFrame:
    """(by, pts, payload): units up to the next temporal delimiter (type 2) in one packet, which has the first one's pts."""
    w = ordered(by, *tie(packets))
    kind = F.shiftright(F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("int"), 3).bitwiseAND(F.lit(15))
    unit = packets.withColumn("_u", F.sum((kind == 2).cast("int")).over(w)).withColumn("_n", F.row_number().over(w))
    found = unit.groupBy(by, "_u").agg(F.min_by("pts", "_n").alias("pts"), F.array_sort(F.collect_list(F.struct("_n", F.hex("payload").alias("h")))).alias("_p"))
    return found.select(by, "pts", F.unhex(F.concat_ws("", F.transform("_p", lambda p: p["h"]))).alias("payload"))


def split_superframe(data: bytes) -> list[bytes]:
    """The frames of a superframe, by the index at its end; the packet itself without one."""
    if data and data[-1] & 0xE0 == 0xC0:
        frames, size = (data[-1] & 7) + 1, (data[-1] >> 3 & 3) + 1
        n = 2 + frames * size
        if len(data) >= n and data[-n] == data[-1]:
            out, at = [], 0
            for k in range(frames):
                length = int.from_bytes(data[len(data) - n + 1 + k * size :][:size], "little")
                out.append(data[at : at + length])
                at += length
            return out
    return [data]


def join_superframe(frames: list[bytes]) -> bytes:
    """Frames and an index at the end; a single one stays as it is."""
    if len(frames) == 1:
        return frames[0]
    size = max(1, (max(map(len, frames)).bit_length() + 7) // 8)
    mark = bytes([0xC0 | (size - 1) << 3 | len(frames) - 1])
    return b"".join(frames) + mark + b"".join(len(f).to_bytes(size, "little") for f in frames) + mark


def vp9_superframe_split(packets: DataFrame) -> DataFrame:
    return payloads.rows(packets, lambda data: [(f, k) for k, f in enumerate(split_superframe(bytes(data)))], ["payload"], "payload binary, part int")


def vp9_visible(data: bytes) -> bool:
    """Whether a frame is shown: its show bit, or that it only repeats an older one."""
    if not data or data[0] >> 6 != 2:
        return True
    profile = (data[0] >> 5 & 1) | (data[0] >> 4 & 1) << 1
    at = 3 if profile == 3 else 4  # bits that are left below the profile, one of them reserved at profile 3
    bit = lambda k: data[0] >> k & 1
    if bit(at - 1):  # show an existing frame
        return True
    return bool(bit(at - 3)) if at >= 3 else True


def vp9_superframe(packets: DataFrame, by: str) -> DataFrame:
    """(by, pts, payload): hidden frames go into one packet with the next visible one, whose pts it has."""
    shown = payloads.each(packets, lambda data: (vp9_visible(bytes(data)),), ["payload"], "shown boolean").join(packets.select(by, "pts", *tie(packets), "payload"), [by, "pts", *tie(packets)])
    w = ordered(by, *tie(packets))
    before = F.coalesce(F.sum(F.col("shown").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    unit = shown.withColumn("_u", before).withColumn("_n", F.row_number().over(w))
    found = unit.groupBy(by, "_u").agg(F.max_by("pts", "_n").alias("pts"), F.transform(F.array_sort(F.collect_list(F.struct("_n", "payload"))), lambda p: p["payload"]).alias("_f"))
    return payloads.each(found, lambda fs: (join_superframe([bytes(f) for f in fs]),), ["_f"], "payload binary").select(by, "pts", "payload")
