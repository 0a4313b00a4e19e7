"""The inspector: what files hold, as rows of sections and as text, by the options of its command line.

A file is a row (path, content). Sections: format, streams, packets and frames; a packet of raw samples is 4096 samples of all channels. What is computed
follows from the options: a section that isn't asked for isn't made.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import containers, images, movies, packets, pcm, streams, subtitles

VERSION = "1.0"
#: Samples of a packet of raw audio.
PACKET = 4096
#: Options without a value, and those with one; an alias has the name that counts behind it.
FLAGS = {
    "-show_format", "-show_streams", "-show_packets", "-show_frames", "-show_error", "-show_data", "-show_chapters", "-show_programs", "-show_stream_groups", "-show_private_data", "-private", "-count_frames", "-count_packets",
    "-unit", "-prefix", "-byte_binary_prefix", "-sexagesimal", "-pretty", "-bitexact", "-hide_banner", "-report", "-find_stream_info", "-analyze_frames", "-show_log",
}
VALUES = {
    "-of": "-of", "-output_format": "-of", "-print_format": "-of", "-show_entries": "-show_entries", "-select_streams": "-select_streams", "-read_intervals": "-read_intervals", "-f": "-f", "-i": "-i", "-o": "-o",
    "-show_data_hash": "-show_data_hash", "-show_optional_fields": "-show_optional_fields", "-print_filename": "-print_filename", "-data_dump_format": "-data_dump_format", "-loglevel": "-loglevel", "-v": "-loglevel",
    "-max_alloc": "-max_alloc", "-cpuflags": "-cpuflags", "-cpucount": "-cpucount", "-c": "-c", "-codec": "-c",
}
FIELDS = {
    "format": ("filename", "nb_streams", "format_name", "duration", "size", "bit_rate"),
    "stream": ("index", "codec_name", "codec_type", "sample_fmt", "sample_rate", "channels", "bits_per_sample", "width", "height", "duration_ts", "duration", "bit_rate", "nb_read_frames", "nb_read_packets"),
    "packet": ("codec_type", "stream_index", "pts", "pts_time", "dts", "dts_time", "duration", "duration_time", "size", "pos", "flags", "data", "data_hash"),
    "frame": ("media_type", "stream_index", "key_frame", "pts", "pts_time", "nb_samples", "channels", "width", "height"),
}
#: Units of fields, for ``-unit``, and fields that are times.
UNITS = {"duration": "s", "size": "byte", "bit_rate": "bit/s", "sample_rate": "Hz", "pts_time": "s", "dts_time": "s", "duration_time": "s"}


class OptionError(ValueError):
    """An option that isn't known, or lacks its value."""


def parse(argv: list[str]) -> dict[str, str | bool]:
    out: dict[str, str | bool] = {}
    k = 0
    while k < len(argv):
        a = argv[k]
        if a in FLAGS:
            out[a] = True
        elif a in VALUES:
            if k + 1 == len(argv):
                raise OptionError(f"{a} needs a value")
            k += 1
            out[VALUES[a]] = argv[k]
        elif a.startswith("-"):
            raise OptionError(f"unknown option {a}")
        else:
            out["-i"] = a
        k += 1
    if out.get("-pretty"):
        out |= {"-unit": True, "-prefix": True, "-byte_binary_prefix": True, "-sexagesimal": True}
    return out


def entries(value: str) -> dict[str, tuple[str, ...]]:
    """``section=a,b:section``: a section without names has all of its fields; plural names stand for the singular ones."""
    out = {}
    for part in value.split(":"):
        section, mark, names = part.partition("=")
        section = section.strip().removesuffix("s")
        if section not in FIELDS:
            raise OptionError(f"no section {section}")
        wanted = {n.strip() for n in names.split(",")} if mark else set(FIELDS[section])
        out[section] = tuple(f for f in FIELDS[section] if f in wanted)
    return out


def intervals(value: str) -> list[tuple[Column, Column | None, int | None]]:
    """(start in seconds or null, end or null, number of packets or null) of ``START%END,...``; ``+`` makes an end relative, ``#`` a count."""
    out = []
    for part in value.split(","):
        start, _, end = part.partition("%")
        at = _seconds(start.lstrip("+")) if start else None
        count = int(end.lstrip("+#")) if "#" in end else None
        stop = None if count is not None or not end else _seconds(end.lstrip("+")) + ((at or 0.0) if end.startswith("+") else 0.0)
        out.append((at, stop, count))
    return out


def _seconds(value: str) -> float:
    total = 0.0
    for x in value.split(":"):
        total = total * 60 + float(x)
    return total


def _opened(files: DataFrame, form: str) -> DataFrame:
    """Adds what the format's reader finds; audio, else pictures, by what files start with."""
    if form in images.FORMATS or form in containers.FORMATS:
        return (images if form in images.FORMATS else containers).demux(files, form)
    audio = containers.demux(files).withColumnsRenamed({"format": "a_format"})
    both = images.demux(audio.withColumnRenamed("error", "a_error"))
    return both.withColumn("format", F.coalesce("a_format", "format")).withColumn("error", F.when(F.col("a_format").isNotNull(), F.col("a_error")).otherwise(F.col("error"))).drop("a_format", "a_error")


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def sections(files: DataFrame, argv: list[str]) -> dict[str, DataFrame]:
    """The rows of each section that the options ask for: path, ``_order``, and the section's fields."""
    o = parse(argv)
    wanted = entries(str(o["-show_entries"])) if "-show_entries" in o else {}
    for section in FIELDS:
        if o.get(f"-show_{section}s") or section == "format" and o.get("-show_format"):
            wanted.setdefault(section, FIELDS[section])
    read = _opened(files, str(o.get("-f", "auto")))
    width = F.create_map(*[x for k in pcm.KINDS for x in (F.lit(k), F.lit(pcm._bytes_of(k)))])
    bytes_each = F.coalesce(F.try_element_at(width, _column(read, "codec", "string")), F.lit(1)) * F.coalesce(_column(read, "channels", "int"), F.lit(1))
    own = read.withColumns({
        "_payload": _column(read, "payload", "binary"), "_block": bytes_each, "_rate": _column(read, "rate", "int"), "_codec": _column(read, "codec", "string"), "_channels": _column(read, "channels", "int"),
        "_w": _column(read, "w", "int"), "_h": _column(read, "h", "int"),
    }).withColumn("_samples", F.floor(F.octet_length("_payload") / F.col("_block")))
    audio = F.col("_codec").isNotNull()
    seconds = F.col("_samples") / F.col("_rate")
    out: dict[str, DataFrame] = {}
    if "format" in wanted:
        made = {"filename": F.lit(o["-print_filename"]) if "-print_filename" in o else F.col("path"), "nb_streams": F.when(F.col("error").isNull(), 1).otherwise(0), "format_name": F.col("format"), "duration": seconds,
                "size": F.octet_length("content").cast("long"), "bit_rate": F.floor(8 * F.octet_length("content") / seconds)}
        out["format"] = own.select("path", F.lit(0).alias("_order"), *[made[f].alias(f) for f in wanted["format"]])
    good = own.filter("error is null")
    picked = str(o.get("-select_streams", ""))
    if picked and picked not in ("0", "a", "a:0", "v", "v:0"):
        good = good.limit(0)
    elif picked[:1] in ("a", "v"):
        good = good.filter(audio if picked[0] == "a" else ~audio)
    n_packets = F.when(audio, F.ceil(F.col("_samples") / PACKET)).otherwise(1)
    if "stream" in wanted:
        rate = F.when(audio, 8 * F.col("_block") * F.col("_rate"))
        made = {"index": F.lit(0), "codec_name": F.when(audio, F.concat(F.lit("pcm_"), "_codec")).otherwise(F.col("format")), "codec_type": F.when(audio, "audio").otherwise("video"), "sample_fmt": F.col("_codec"),
                "sample_rate": F.col("_rate"), "channels": F.col("_channels"), "bits_per_sample": F.when(audio, 8 * F.col("_block") / F.col("_channels")).cast("int"), "width": F.col("_w"), "height": F.col("_h"),
                "duration_ts": F.col("_samples"), "duration": seconds, "bit_rate": rate, "nb_read_frames": F.when(F.lit(bool(o.get("-count_frames"))), n_packets), "nb_read_packets": F.when(F.lit(bool(o.get("-count_packets"))), n_packets)}
        out["stream"] = good.select("path", F.lit(0).alias("_order"), *[made[f].alias(f) for f in wanted["stream"]])
    if "packet" in wanted or "frame" in wanted:
        cut = good.filter(n_packets > 0).withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), n_packets.cast("long") - 1)))
        cut = cut.withColumns({"_pts": F.when(audio, F.col("_n") * PACKET).otherwise(0), "_count": F.when(audio, F.least(F.lit(PACKET).cast("long"), F.col("_samples") - F.col("_n") * PACKET)).otherwise(1)})
        cut = cut.withColumn("_time", F.when(audio, F.col("_pts") / F.col("_rate")).otherwise(0.0))
        if "-read_intervals" in o:
            cut = _within(cut, intervals(str(o["-read_intervals"])))
        data = F.when(audio, F.substring("_payload", (F.col("_pts") * F.col("_block") + 1).cast("int"), (F.col("_count") * F.col("_block")).cast("int"))).otherwise(F.col("content"))
        length = F.when(audio, F.col("_count") / F.col("_rate"))
        hashed = {"md5": F.md5, "sha256": lambda c: F.sha2(c, 256), "crc32": lambda c: F.lpad(F.lower(F.hex(F.crc32(c))), 8, "0")}.get(str(o.get("-show_data_hash", "md5")).lower(), F.md5)
        made = {"codec_type": F.when(audio, "audio").otherwise("video"), "stream_index": F.lit(0), "pts": F.col("_pts"), "pts_time": F.col("_time"), "dts": F.col("_pts"), "dts_time": F.col("_time"), "duration": F.col("_count"), "duration_time": length,
                "size": F.octet_length(data).cast("long"), "pos": F.when(audio, F.col("_pts") * F.col("_block")).otherwise(0), "flags": F.lit("K__"), "data": F.when(F.lit(bool(o.get("-show_data"))), text.hex_dump(data)),
                "data_hash": F.when(F.lit("-show_data_hash" in o), F.concat(F.lit(str(o.get("-show_data_hash", ""))), F.lit(":"), hashed(data)))}
        if "packet" in wanted:
            out["packet"] = cut.select("path", F.col("_n").alias("_order"), *[made[f].alias(f) for f in wanted["packet"]])
        if "frame" in wanted:
            made = {"media_type": made["codec_type"], "stream_index": F.lit(0), "key_frame": F.lit(1), "pts": F.col("_pts"), "pts_time": F.col("_time"), "nb_samples": F.when(audio, F.col("_count")), "channels": F.col("_channels"), "width": F.col("_w"), "height": F.col("_h")}
            out["frame"] = cut.select("path", F.col("_n").alias("_order"), *[made[f].alias(f) for f in wanted["frame"]])
    if o.get("-show_error"):
        out["error"] = own.filter("error is not null").select("path", F.lit(0).alias("_order"), F.col("error").alias("string"))
    return out


def _within(cut: DataFrame, spans: list) -> DataFrame:
    """Packets of any interval: from its start, up to its end or its number of packets."""
    tests, df = [], cut
    for k, (start, end, count) in enumerate(spans):
        inside = F.lit(True) if start is None else F.col("_time") >= start
        if end is not None:
            inside &= F.col("_time") < end
        if count is not None:
            place = F.sum(inside.cast("int")).over(Window.partitionBy("path").orderBy("_n"))
            df = df.withColumn(f"_i{k}", inside & (place <= count))
        else:
            df = df.withColumn(f"_i{k}", inside)
        tests.append(f"_i{k}")
    return df.filter(functools.reduce(Column.__or__, [F.col(t) for t in tests])).drop(*tests)


def _shown(df: DataFrame, o: dict) -> DataFrame:
    """Numbers as the options want them: units, prefixes, times of day."""
    new = {}
    for c in df.columns:
        if c in UNITS or c.endswith("_time") or c == "duration":
            real = df.schema[c].dataType.simpleString() == "double"
            if UNITS.get(c) == "s" and real:
                plain = text.sexagesimal(F.col(c)) if o.get("-sexagesimal") else F.format_string("%.6f", F.col(c))
                plain = F.when(F.col(c).isNotNull(), plain)
                new[c] = F.concat(plain, F.lit(" s")) if o.get("-unit") and not o.get("-sexagesimal") else plain
            elif o.get("-unit") or o.get("-prefix"):
                unit = UNITS.get(c, "") if o.get("-unit") else ""
                if o.get("-prefix"):
                    new[c] = text.prefixed(F.col(c), unit, bool(o.get("-byte_binary_prefix")) and UNITS.get(c) == "byte")
                else:
                    new[c] = F.concat(F.col(c).cast("string"), F.lit(f" {unit}"))
    return df.withColumns(new) if new else df


def inspect(files: DataFrame, argv: list[str]) -> DataFrame:
    """(path, section, order, text): a row for each section of each file, in the form that ``-of`` names: default, compact, csv, flat, ini, json or xml, with
    options behind it (``default=nokey=1``). Missing values are ``N/A``, or left out in json and xml."""
    o = parse(argv)
    form, _, more = str(o.get("-of", "default")).partition("=")
    options = text.option_map(more) if more else {}
    on = lambda *names: any(options.get(n, "0") in ("1", "true") for n in names)
    optional = str(o.get("-show_optional_fields", "auto"))
    out = None
    for section, df in sections(files, argv).items():
        rows = _shown(df, o)
        fields = [c for c in rows.columns if c not in ("path", "_order", "section")]
        if optional in ("never", "0"):
            fields = [f for f in fields if f not in ("data", "data_hash", "nb_read_frames", "nb_read_packets")]
        where = F.concat(F.lit(f"{section}s.{section}."), F.col("_order").cast("string")) if section in ("stream", "packet", "frame") else F.lit(section)
        line = {
            "default": lambda fields=fields, section=section: packets.default_section(fields, section, on("nokey", "nk"), on("noprint_wrappers", "nw")),
            "compact": lambda fields=fields, section=section: packets.compact(fields, section, options.get("item_sep", options.get("s", "|"))),
            "csv": lambda fields=fields, section=section: packets.csv_line(fields, section), "flat": lambda fields=fields, where=where: packets.flat_section(fields, where), "ini": lambda fields=fields, where=where: packets.ini_section(fields, where),
            "json": lambda fields=fields: packets.json_object(fields), "xml": lambda fields=fields, section=section: packets.xml_element(fields, section),
        }
        if form not in line:
            raise OptionError(f"no writer {form}")
        own = rows.select("path", F.lit(section).alias("section"), F.col("_order").cast("long").alias("order"), line[form]().alias("text"))
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise OptionError("nothing to show")
    return out


#: Sample formats with their bits, channel layouts, and basic colours.
SAMPLE_FORMATS = (("u8", 8), ("s16", 16), ("s32", 32), ("flt", 32), ("dbl", 64), ("u8p", 8), ("s16p", 16), ("s32p", 32), ("fltp", 32), ("dblp", 64), ("s64", 64), ("s64p", 64))
LAYOUTS = (("mono", 1), ("stereo", 2), ("2.1", 3), ("3.0", 3), ("quad", 4), ("4.0", 4), ("5.0", 5), ("5.1", 6), ("6.1", 7), ("7.1", 8))
PIXEL_FORMATS = (("gray", 1, 8), ("rgb24", 3, 24), ("rgba", 4, 32), ("yuv420p", 3, 12), ("yuv422p", 3, 16), ("yuv444p", 3, 24), ("yuva444p", 4, 32), ("gbrp", 3, 24))
COLOURS = (("black", "#000000"), ("white", "#ffffff"), ("red", "#ff0000"), ("lime", "#00ff00"), ("blue", "#0000ff"), ("yellow", "#ffff00"), ("cyan", "#00ffff"), ("magenta", "#ff00ff"), ("gray", "#808080"), ("green", "#008000"))
DISPOSITIONS = ("default", "dub", "original", "comment", "lyrics", "karaoke", "forced", "hearing_impaired", "visual_impaired", "clean_effects", "attached_pic", "timed_thumbnails", "captions", "descriptions", "metadata", "dependent", "still_image")


def listing(spark: SparkSession, option: str) -> DataFrame:
    """(name, detail): what an option that lists something lists."""
    from ..operators import pixels
    from ..sources import paths
    from . import graph

    audio = [(k, "audio") for k in containers.FORMATS]
    pictures = [(f"{k}_pipe", "picture") for k in images.FORMATS]
    text_in, text_out = [(k, "subtitle") for k in subtitles.READERS], [(k, "subtitle") for k in subtitles.WRITERS]
    elementary = [(k, "elementary stream") for k in streams.PARSERS if k not in images.FORMATS]
    codecs = [(f"pcm_{k}", "audio") for k in pcm.KINDS] + [(k, "audio") for k in pcm.ADPCM] + [(k, "video") for k in images.FORMATS]
    sinks = [(k, "checksum") for k in ("crc", "framecrc", "md5", "framemd5", "hash", "framehash", "streamhash")]
    filters = sorted({*graph.OPERATORS, *graph.JOINS, *pixels.FILTERS})
    about = [("version", VERSION)]
    lists = {
        "-demuxers": audio + pictures + text_in + elementary + [(k, "movie") for k in movies.READERS], "-muxers": audio + text_out + sinks + [(k, "movie") for k in movies.WRITERS] + [(k, "picture") for k, f in images.FORMATS.items() if f[2]], "-codecs": codecs, "-decoders": codecs, "-encoders": codecs,
        "-bsfs": [(k, "") for k in ("null", "chomp", "remove_extra", "dump_extra", "setts", "noise", "showinfo", "filter_units", "extract_extradata", "trace_headers", "h264_mp4toannexb", "hevc_mp4toannexb", "aac_adtstoasc", "opus_metadata", "pcm_rechunk", "text2movsub", "mov2textsub", "av1_frame_split", "av1_frame_merge", "vp9_superframe", "vp9_superframe_split")],
        "-protocols": [(k.rstrip(":,"), "") for k in paths.READERS] + [("crypto", ""), ("md5", ""), ("tee", "")], "-filters": [(k, "") for k in filters], "-sample_fmts": [(k, str(b)) for k, b in SAMPLE_FORMATS],
        "-layouts": [(k, str(n)) for k, n in LAYOUTS], "-pix_fmts": [(k, f"{n} components, {b} bits") for k, n, b in PIXEL_FORMATS], "-colors": list(COLOURS), "-dispositions": [(k, "") for k in DISPOSITIONS],
        "-sections": [(k, ",".join(v)) for k, v in FIELDS.items()], "-version": about, "-show_program_version": about, "-show_library_versions": about, "-show_versions": about, "-buildconf": [("python", "")],
        "-L": [("license", "see the repository")], "-license": [("license", "see the repository")], "-show_pixel_formats": [(k, f"{n} components, {b} bits") for k, n, b in PIXEL_FORMATS], "-devices": [], "-sources": [], "-sinks": [],
        "-h": [(x, "") for x in sorted({*FLAGS, *VALUES})],
    }
    lists["-formats"] = lists["-demuxers"] + lists["-muxers"]
    for alias in ("-?", "-help", "--help"):
        lists[alias] = lists["-h"]
    if option not in lists:
        raise OptionError(f"unknown option {option}")
    return spark.createDataFrame(lists[option], "name string, detail string")
