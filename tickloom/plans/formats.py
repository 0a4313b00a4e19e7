"""Registered queries of sources, sinks and bitstream filters, with DuckDB SQL for the same rows.

Most write a form and read it back: the SQL has what must come out, and the sizes that the format fixes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bitstream
from ..sources import codecs, containers, images, movies, packets, pcm, subtitles
from . import video

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


def _pcm(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        coded = pcm.encode_column(_blocks(s, d), kind).select("vec_id", "payload")
        back = pcm.decode_column(coded, kind)
        return back.select("vec_id", F.octet_length("payload").cast("long").alias("bytes"), F.aggregate(F.transform("samples", lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x).alias("total"))

    return run


_E = "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"
for _kind in pcm.KINDS:
    _sql = None
    if _kind in pcm.WHOLE:
        _half = 1 << (8 * pcm.WHOLE[_kind][0] - 1)
        _sql = f"{_E} SELECT vec_id, count(*) * {pcm.WHOLE[_kind][0]} AS bytes, sum(i * greatest({-_half}, least({_half - 1}, round_even(x * {_half}, 0))) / {_half}::DOUBLE) AS total FROM e GROUP BY 1"
    elif _kind in pcm.FLOAT:
        _sql = f"{_E} SELECT vec_id, count(*) * {pcm.FLOAT[_kind].itemsize} AS bytes, sum(i * CAST(CAST(x AS {'FLOAT' if '32' in _kind else 'DOUBLE'}) AS DOUBLE)) AS total FROM e GROUP BY 1"
    register(f"pcm_{_kind}", _pcm(_kind), _sql)


def _texts(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))


def _container(name: str, codec: str, rate: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        files = containers.mux(_texts(s, d).withColumns({"codec": F.lit(codec), "rate": F.lit(rate), "channels": F.lit(1)}), name).select("doc_id", "content")
        back = containers.demux(files, "auto" if containers.FORMATS[name][0] else name)
        return back.select("doc_id", F.octet_length("content").cast("long").alias("bytes"), "format", "codec", F.col("rate").cast("long").alias("rate"), F.md5("payload").alias("hash"))

    return run


#: How long a file of n bytes of samples is.
SIZES = {
    "wav": ("u8", 8000, "44 + n + n % 2"), "w64": ("u8", 8000, "104 + n + (8 - n % 8) % 8"), "aiff": ("s8", 8000, "54 + n + n % 2"), "au": ("mulaw", 8000, "32 + n"), "caf": ("alaw", 8000, "68 + n"),
    "voc": ("u8", 8000, "43 + n"), "sox": ("s32le", 8000, "32 + n"), "ircam": ("s8", 8000, "1024 + n"), "rso": ("u8", 8000, "8 + n"), "sln": ("s16le", 8000, "n"),
}
for _name, (_codec, _rate, _size) in SIZES.items():
    register(f"container_{_name}", _container(_name, _codec, _rate), f"SELECT doc_id, {_size} AS bytes, '{_name}' AS format, '{_codec}' AS codec, {_rate} AS rate, md5(t) AS hash FROM (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents)")


def _image(name: str, planes: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        own = video.frames(s, d, planes)
        files = images.mux(own.select("vec_id", "w", "h", F.array(*[f"p{k}" for k in range(planes)]).alias("planes")), name).select("vec_id", "content")
        return video.digest(images.frames(images.demux(files, "auto" if images.FORMATS[name][0] else name), planes))

    return run


for _name, _planes in (("png", 4), ("gif", 1), ("bmp", 3), ("qoi", 4), ("pgm", 1), ("ppm", 3), ("pam", 4), ("pfm", 3), ("phm", 1), ("sgi", 3), ("pcx", 3), ("xwd", 3), ("targa", 4)):
    # what a format has no gray form for comes back as RGB, of which the first plane is looked at
    register(f"image_{_name}", _image(_name, _planes), f"{video.BASE} {video._sums(video.each(*[f'v{k}' for k in range(_planes)]), _planes)}")


def _cues(s: SparkSession, d: str) -> DataFrame:
    clean = F.trim(F.regexp_replace("text", "[^A-Za-z ]+", " "))
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", (F.col("turn") * 2000).cast("long").alias("start"), (F.col("turn") * 2000 + 1000).cast("long").alias("end"), F.concat(F.lit("x "), clean).alias("text"))


def _subtitle(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        files = subtitles.mux(_cues(s, d), "conv_id", name).withColumn("content", F.col("content").cast("binary"))
        return subtitles.demux(files, name).select("conv_id", "start", "end", F.trim(F.regexp_replace("text", " +", " ")).alias("text"))

    return run


_C = "WITH c AS (SELECT conv_id, turn * 2000 AS a, turn * 2000 + 1000 AS b, trim(regexp_replace('x ' || trim(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g')), ' +', ' ', 'g')) AS text FROM conversations)"
for _name in ("srt", "webvtt", "microdvd", "jacosub", "ass", "ttml"):
    register(f"subtitles_{_name}", _subtitle(_name), f'{_C} SELECT conv_id, a AS "start", b AS "end", text FROM c')
register("subtitles_lrc", _subtitle("lrc"), f'{_C} SELECT conv_id, a AS "start", lead(a) OVER (PARTITION BY conv_id ORDER BY a, text) AS "end", text FROM c')


# Bitstream filters; a packet is a turn of a conversation


def _turns(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("pts"), F.col("turn").cast("long").alias("dts"), F.lit(1).cast("long").alias("duration"), F.lit(1).alias("flags"), F.col("text").cast("binary").alias("payload"))


def _length() -> Column:
    return F.unhex(F.lpad(F.hex(F.octet_length("payload").cast("long")), 8, "0"))


register("bsf_h264_mp4toannexb", lambda s, d: bitstream.mp4toannexb(_turns(s, d).withColumn("payload", F.concat(_length(), "payload")), "h264").select("conv_id", "pts", F.hex("payload").alias("data")), "SELECT conv_id, turn AS pts, '00000001' || hex(encode(text)) AS data FROM conversations")
register("bsf_hevc_mp4toannexb", lambda s, d: bitstream.mp4toannexb(_turns(s, d).withColumn("payload", F.concat(_length(), "payload")), "hevc").select("conv_id", "pts", F.hex("payload").alias("data")), "SELECT conv_id, turn AS pts, '00000001' || hex(encode(text)) AS data FROM conversations")
register("bsf_text2movsub", lambda s, d: _turns(s, d).select("conv_id", "pts", F.hex(bitstream.text2movsub(F.col("payload"))).alias("data")), "SELECT conv_id, turn AS pts, printf('%04X', octet_length(encode(text))) || hex(encode(text)) AS data FROM conversations")
register("bsf_mov2textsub", lambda s, d: _turns(s, d).select("conv_id", "pts", F.decode(bitstream.mov2textsub(bitstream.text2movsub(F.col("payload"))), "UTF-8").alias("text")), "SELECT conv_id, turn AS pts, text FROM conversations")
register("bsf_null", lambda s, d: _turns(s, d).select("conv_id", "pts", F.md5("payload").alias("hash")), "SELECT conv_id, turn AS pts, md5(text) AS hash FROM conversations")
register("bsf_remove_extra", lambda s, d: _turns(s, d).select("conv_id", "pts", F.decode(bitstream.remove_extra(F.concat(F.lit(b"head"), "payload"), F.lit(b"head")), "UTF-8").alias("text")), "SELECT conv_id, turn AS pts, text FROM conversations")
register("bsf_dump_extra", lambda s, d: _turns(s, d).select("conv_id", "pts", F.decode(bitstream.dump_extra(F.col("payload"), F.lit(b"head"), F.col("pts") % 2 == 0), "UTF-8").alias("text")), "SELECT conv_id, turn AS pts, CASE WHEN turn % 2 = 0 THEN 'head' ELSE '' END || text AS text FROM conversations")
register("bsf_setts", lambda s, d: bitstream.setts(_turns(s, d), "conv_id", "PTS*10+N", "if(isnan(PREV_INDTS),-1,PREV_INDTS)", "NEXT_PTS-PTS").select("conv_id", "pts", "dts", "duration"), "SELECT conv_id, turn * 10 + row_number() OVER w - 1 AS pts, coalesce(lag(turn) OVER w, -1) AS dts, lead(turn) OVER w - turn AS duration FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
register("bsf_showinfo", lambda s, d: bitstream.showinfo(_turns(s, d), "conv_id").select("conv_id", F.col("n").cast("long").alias("n"), "pts", F.col("size").cast("long").alias("size")), "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, turn AS pts, octet_length(encode(text)) AS size FROM conversations")
register("bsf_pcm_rechunk", lambda s, d: bitstream.pcm_rechunk(_turns(s, d), "conv_id", 100, False).select("conv_id", "n", F.hex("payload").alias("data")), "SELECT conv_id, n, substr(t, n * 200 + 1, 200) AS data FROM (SELECT conv_id, string_agg(hex(encode(text)), '' ORDER BY turn) AS t FROM conversations GROUP BY 1), LATERAL (SELECT unnest(range(0, (length(t) + 199) // 200)) AS n) WHERE length(t) > 0")
register("bsf_noise", lambda s, d: bitstream.noise(_turns(s, d), 10).select("conv_id", "pts", F.md5("payload").alias("hash")))
_UNITS = lambda s, d: _turns(s, d).withColumn("payload", F.unhex(F.concat(F.lit("000000016742"), F.lit("000000016801"), F.lit("00000001"), F.hex(F.concat(F.lit(b"A"), "payload")))))  # noqa: E731, N816
register("bsf_filter_units", lambda s, d: bitstream.filter_units(_UNITS(s, d), "h264", [7, 8]).select("conv_id", "pts", F.hex("payload").alias("data")), "SELECT conv_id, turn AS pts, '00000001' || hex(encode('A' || text)) AS data FROM conversations")
register("bsf_extract_extradata", lambda s, d: bitstream.extract_extradata(_UNITS(s, d), "h264", True).select("conv_id", "pts", F.hex("payload").alias("data"), F.hex("extradata").alias("extra")), "SELECT conv_id, turn AS pts, '00000001' || hex(encode('A' || text)) AS data, '000000016742000000016801' AS extra FROM conversations")
register("bsf_trace_headers", lambda s, d: bitstream.trace_headers(_UNITS(s, d), "h264").groupBy("unit", "unit_type").agg(F.count("*").alias("n"), F.sum("size").alias("size")).select(F.col("unit").cast("long").alias("unit"), F.col("unit_type").cast("long").alias("unit_type"), "n", "size"), "SELECT * FROM (SELECT 0 AS unit, 7 AS unit_type, count(*) AS n, count(*) * 2 AS size FROM conversations UNION ALL SELECT 1, 8, count(*), count(*) * 2 FROM conversations UNION ALL SELECT 2, 1, count(*), sum(1 + octet_length(encode(text))) FROM conversations)")
_SUPER = lambda s, d: _turns(s, d).withColumn("payload", F.concat(F.unhex(F.lit("80")), F.unhex(F.lit("00"))))  # noqa: E731, N816
register("bsf_vp9_superframe_split", lambda s, d: bitstream.vp9_superframe_split(_turns(s, d).withColumn("payload", F.unhex(F.lit("AABBCC" + "C9" + "0100" + "0200" + "C9")))).groupBy("part", F.hex("payload").alias("data")).agg(F.count("*").alias("n")).withColumn("part", F.col("part").cast("long")), "SELECT 0 AS part, 'AA' AS data, count(*) AS n FROM conversations UNION ALL SELECT 1, 'BBCC', count(*) FROM conversations")
register("bsf_av1_frame_split", lambda s, d: bitstream.av1_frame_split(_turns(s, d).withColumn("payload", F.unhex(F.lit("1200" + "0A03AABBCC" + "3202DDEE")))).groupBy("obu", F.hex("payload").alias("data")).agg(F.count("*").alias("n")).withColumn("obu", F.col("obu").cast("long")), "SELECT 2 AS obu, '1200' AS data, count(*) AS n FROM conversations UNION ALL SELECT 1, '0A03AABBCC', count(*) FROM conversations UNION ALL SELECT 6, '3202DDEE', count(*) FROM conversations")
register("bsf_av1_frame_merge", lambda s, d: bitstream.av1_frame_merge(_turns(s, d).withColumn("payload", F.unhex(F.when(F.col("pts") % 2 == 0, "1200").otherwise("3202DDEE"))), "conv_id").select("conv_id", "pts", F.hex("payload").alias("data")), "SELECT conv_id, min(turn) AS pts, string_agg(CASE WHEN turn % 2 = 0 THEN '1200' ELSE '3202DDEE' END, '' ORDER BY turn) AS data FROM (SELECT *, sum((turn % 2 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations) GROUP BY conv_id, g")


# Text and checksum sinks

_KEYS = ["conv_id", "turn", "role"]


def _log(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/conversations.parquet").select(*_KEYS, "text")


register("probe_default", lambda s, d: _log(s, d).select("conv_id", "turn", packets.default_section(_KEYS).alias("line")), "SELECT conv_id, turn, '[PACKET]' || chr(10) || 'conv_id=' || conv_id || chr(10) || 'turn=' || turn || chr(10) || 'role=' || role || chr(10) || '[/PACKET]' || chr(10) AS line FROM conversations")
register("probe_ini", lambda s, d: _log(s, d).select("conv_id", "turn", packets.ini_section(_KEYS, F.concat(F.lit("packets.packet."), F.col("turn").cast("string"))).alias("line")), "SELECT conv_id, turn, '[packets.packet.' || turn || ']' || chr(10) || 'conv_id=' || conv_id || chr(10) || 'turn=' || turn || chr(10) || 'role=' || role || chr(10) AS line FROM conversations")
register("probe_json", lambda s, d: _log(s, d).select("conv_id", "turn", packets.json_object([*_KEYS, "text"]).alias("line")), "SELECT conv_id, turn, '{ \"conv_id\": ' || conv_id || ', \"turn\": ' || turn || ', \"role\": \"' || role || '\", \"text\": \"' || replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '\" }' AS line FROM conversations")
register("probe_xml", lambda s, d: _log(s, d).select("conv_id", "turn", packets.xml_element([*_KEYS, "text"]).alias("line")), "SELECT conv_id, turn, '<packet conv_id=\"' || conv_id || '\" turn=\"' || turn || '\" role=\"' || role || '\" text=\"' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '\"/>' AS line FROM conversations")
register("probe_flat_path", lambda s, d: _log(s, d).select("conv_id", "turn", packets.flat_section(_KEYS, F.concat(F.lit("packets.packet."), F.col("turn").cast("string"))).alias("line")), "SELECT conv_id, turn, 'packets.packet.' || turn || '.conv_id=' || conv_id || chr(10) || 'packets.packet.' || turn || '.turn=' || turn || chr(10) || 'packets.packet.' || turn || '.role=\"' || role || '\"' AS line FROM conversations")
_STREAM = lambda s, d: _turns(s, d).withColumn("stream", F.lit(0))  # noqa: E731, N816
register("framemd5_lines", lambda s, d: packets.frame_lines(_STREAM(s, d), "md5").select("conv_id", "pts", "line"), "SELECT conv_id, turn AS pts, printf('%d, %10d, %10d, %8d, %8d, ', 0, turn, turn, 1, octet_length(encode(text))) || md5(text) AS line FROM conversations")
register("framehash_lines", lambda s, d: packets.frame_lines(_STREAM(s, d), "sha256").select("conv_id", "pts", "line"), "SELECT conv_id, turn AS pts, printf('%d, %10d, %10d, %8d, %8d, ', 0, turn, turn, 1, octet_length(encode(text))) || sha256(text) AS line FROM conversations")
register("framecrc_lines", lambda s, d: packets.frame_lines(_STREAM(s, d)).select("conv_id", "pts", "line"))
register("streamhash_md5", lambda s, d: packets.stream_hash(_turns(s, d), "conv_id", ["pts"]), "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS hash FROM conversations GROUP BY 1")
register("streamhash_sha256", lambda s, d: packets.stream_hash(_turns(s, d), "conv_id", ["pts"], "sha256"), "SELECT conv_id, sha256(string_agg(text, '' ORDER BY turn)) AS hash FROM conversations GROUP BY 1")
register("stream_crc", lambda s, d: packets.stream_hash(_turns(s, d), "conv_id", ["pts"], "adler32"))
register("crc32_packet", lambda s, d: packets.frame_hash(_turns(s, d), "crc32").select("conv_id", "pts", "hash"))


# Movies: a file for each conversation, its turns in order as pictures of one stream


def _movie(name: str, codec: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
        turns = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", n.alias("n"), F.concat(F.lit(b"x"), F.col("text").cast("binary")).alias("payload"))
        own = turns.withColumns({"stream": F.lit(0), "kind": F.lit("video"), "codec": F.lit(codec), "rate": F.lit(25.0), "width": F.lit(64), "height": F.lit(48), "channels": F.lit(0), "pts": F.col("n") * 40, "key": F.col("n") % 3 == 0})
        back = movies.demux(movies.mux(own, "conv_id", name))
        return back.select("conv_id", F.col("n").cast("long").alias("n"), "pts", "key", "codec", F.md5("payload").alias("hash"))

    return run


for _name, _codec in (("avi", "H264"), ("flv", "h264"), ("mp4", "avc1"), ("matroska", "V_VP8"), ("webm", "V_VP8"), ("mpegts", "h264")):
    register(f"movie_{_name}", _movie(_name, _codec), f"SELECT conv_id, n, n * 40 AS pts, n % 3 = 0 AS key, '{_codec}' AS codec, md5('x' || text) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)")
register("movie_ogg", _movie("ogg", "opus"), "SELECT conv_id, n, n * 40 AS pts, true AS key, 'unknown' AS codec, md5('x' || text) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations)")


# Codecs: embeddings as 16-bit sounds


def _sounds(s: SparkSession, d: str) -> DataFrame:
    whole = F.transform(F.col("samples"), lambda x: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.floor(x * 32768))).cast("long"))
    return _blocks(s, d).select("vec_id", F.array(whole).alias("samples"), F.lit(8000).alias("rate"), F.lit(16).alias("bits"))


def _sound(codec: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        back = codecs.decode_sounds(codecs.encode_sounds(_sounds(s, d), codec).select("vec_id", "content"), codec)
        total = F.aggregate(F.transform(F.col("samples")[0], lambda x, k: x * (k + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
        return back.select("vec_id", F.col("rate").cast("long").alias("rate"), F.size(F.col("samples")[0]).cast("long").alias("n"), total.alias("total"))

    return run


register("codec_flac", _sound("flac"), f"{_E} SELECT vec_id, 8000 AS rate, count(*) AS n, CAST(sum(i * greatest(-32768, least(32767, floor(x * 32768)))) AS BIGINT) AS total FROM e GROUP BY 1")
register("codec_qoa", _sound("qoa"))
