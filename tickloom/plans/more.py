"""Registered queries of metadata, commands, fields of frames, generated pictures, spectra, parsers, scalar text and paths, with DuckDB SQL for
the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fields, frames, generators, metadata, pixels, spectra, timing
from ..sources import containers, paths, streams
from . import inspector, video

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLE_SQL[name] = sql


# Metadata: a map of the event's type and value


def _tagged(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.array(F.struct(F.lit("type").alias("key"), F.col("event_type").alias("value")))
    odd = F.when(F.col("event_id") % 2 == 1, F.array(F.struct(F.lit("value").alias("key"), F.col("value").cast("string").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return e.select("event_id", "user_id", timing.micros("ts").alias("pts"), F.col("event_id").alias("arrival"), F.map_from_entries(F.concat(kind, odd)).alias("metadata"))


def _entries(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.try_element_at("metadata", F.lit("type")).alias("type"), F.try_element_at("metadata", F.lit("value")).cast("double").alias("value"), F.try_element_at("metadata", F.lit("new")).alias("new"), F.size("metadata").cast("long").alias("n"))


_M = "SELECT event_id, event_type AS type, CASE WHEN event_id % 2 = 1 THEN value END AS value, NULL::VARCHAR AS new, 1 + event_id % 2 AS n FROM events"
register("metadata_has_key", lambda s, d: _entries(metadata.metadata(_tagged(s, d), "select", "value")), f"{_M} WHERE event_id % 2 = 1")
register("metadata_same_str", lambda s, d: _entries(metadata.metadata(_tagged(s, d), "select", "type", "click")), f"{_M} WHERE event_type = 'click'")
register("metadata_starts_with", lambda s, d: _entries(metadata.metadata(_tagged(s, d), "select", "type", "c", "starts_with")), f"{_M} WHERE starts_with(event_type, 'c')")
register("metadata_greater", lambda s, d: _entries(metadata.metadata(_tagged(s, d), "select", "value", "200", "greater")), f"{_M} WHERE event_id % 2 = 1 AND value > 200")
register("metadata_expr", lambda s, d: _entries(metadata.metadata(_tagged(s, d), "select", "value", "7", "expr", "lt(mod(VALUE1,VALUE2),3)")), f"{_M} WHERE event_id % 2 = 1 AND value - floor(value / 7) * 7 < 3")
register("metadata_add", lambda s, d: _entries(metadata.metadata(metadata.metadata(_tagged(s, d), "add", "new", "x"), "add", "type", "y")), "SELECT event_id, event_type AS type, CASE WHEN event_id % 2 = 1 THEN value END AS value, 'x' AS new, 2 + event_id % 2 AS n FROM events")
register("metadata_modify", lambda s, d: _entries(metadata.metadata(metadata.metadata(_tagged(s, d), "modify", "value", "1"), "modify", "new", "x")), "SELECT event_id, event_type AS type, CASE WHEN event_id % 2 = 1 THEN 1.0 END AS value, NULL::VARCHAR AS new, 1 + event_id % 2 AS n FROM events")
register("metadata_delete", lambda s, d: _entries(metadata.metadata(_tagged(s, d), "delete", "type", "click")), "SELECT event_id, CASE WHEN event_type <> 'click' THEN event_type END AS type, CASE WHEN event_id % 2 = 1 THEN value END AS value, NULL::VARCHAR AS new, 1 + event_id % 2 - (event_type = 'click')::INT AS n FROM events")
register("metadata_delete_all", lambda s, d: _entries(metadata.metadata(_tagged(s, d), "delete")), "SELECT event_id, NULL::VARCHAR AS type, NULL::DOUBLE AS value, NULL::VARCHAR AS new, 0 AS n FROM events")
register("metadata_print", lambda s, d: metadata.metadata(_tagged(s, d), "select", "type").select("event_id", metadata.metadata_lines(F.col("event_id"), F.col("event_id") * 40_000).alias("line")).filter("event_id % 2 = 0"), "SELECT event_id, 'frame:' || rpad(event_id::VARCHAR, greatest(5, length(event_id::VARCHAR))::INT, ' ') || 'pts:' || rpad((event_id * 40000)::VARCHAR, greatest(8, length((event_id * 40000)::VARCHAR))::INT, ' ') || 'pts_time:' || regexp_replace(regexp_replace(printf('%.6f', event_id * 0.04), '0+$', ''), '\\.$', '') || chr(10) || 'type=' || event_type || chr(10) AS line FROM events WHERE event_id % 2 = 0")
_SIDE = lambda s, d: _tagged(s, d).withColumn("side_data", F.when(F.col("event_id") % 3 == 0, F.array(F.struct(F.lit("a").alias("kind")), F.struct(F.lit("b").alias("kind")))).otherwise(F.array(F.struct(F.lit("b").alias("kind")))))  # noqa: E731, N816
register("sidedata_select", lambda s, d: metadata.sidedata(_SIDE(s, d), "select", "a").select("event_id"), "SELECT event_id FROM events WHERE event_id % 3 = 0")
register("sidedata_delete", lambda s, d: metadata.sidedata(_SIDE(s, d), "delete", "a").select("event_id", F.size("side_data").cast("long").alias("n")), "SELECT event_id, 1 AS n FROM events")
_DAY = 86_400
_T0 = 1_704_067_200
register(
    "sendcmd",
    lambda s, d: metadata.fired(s, _tagged(s, d), "user_id", f"{_T0 + 5 * _DAY}-{_T0 + 10 * _DAY} [enter+leave] volume gain 2; {_T0 + 12 * _DAY} lut set 'a,b'").select("user_id", "pts", "flag", "target", "argument"),
    f"""WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, epoch_us(ts) AS pts, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 1e6 AS p FROM events),
    a AS (SELECT *, t >= {_T0 + 5 * _DAY} AND t < {_T0 + 10 * _DAY} AS i, coalesce(p >= {_T0 + 5 * _DAY} AND p < {_T0 + 10 * _DAY}, false) AS j FROM s)
    SELECT user_id, pts, 'enter' AS flag, 'volume' AS target, '2' AS argument FROM a WHERE i AND NOT j UNION ALL SELECT user_id, pts, 'leave', 'volume', '2' FROM a WHERE j AND NOT i
    UNION ALL SELECT user_id, pts, 'enter', 'lut', 'a,b' FROM s WHERE t >= {_T0 + 12 * _DAY} AND NOT coalesce(p >= {_T0 + 12 * _DAY}, false)""",
)

# Fields: frames are embeddings in order, ten to a stream


def _frames(s: SparkSession, d: str) -> DataFrame:
    return video.frames(s, d).withColumn("k", F.floor(F.col("vec_id") / 10)).withColumn("n", (F.col("vec_id") % 10).cast("long"))


def _sums(df: DataFrame) -> DataFrame:
    total = F.aggregate(F.transform("p0", lambda v, i: v * (i + 1).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v)
    return df.select("k", "n", F.col("h").cast("long").alias("h"), total.alias("s"))


_FR = video.BASE + ", fr AS (SELECT vec_id // 10 AS k, vec_id % 10 AS n, x, y, i, v0 AS v FROM px), c AS (SELECT k, n FROM fr GROUP BY ALL)"


def _field(name: str, f: Callable[[DataFrame], DataFrame], rows: str | None) -> None:
    """rows: (k, n, h, i, v)."""
    register(name, lambda s, d: _sums(f(_frames(s, d))), rows and f"{_FR} SELECT k, n, h, CAST(sum(v * (i + 1)) AS BIGINT) AS s FROM ({rows}) GROUP BY ALL")


_field("separatefields", lambda x: pixels.separatefields(x).withColumn("n", 2 * F.col("n") + F.col("field")), "SELECT k, 2 * n + y % 2 AS n, 4 AS h, (y // 2) * 8 + x AS i, v FROM fr")
_field("weave_pairs", lambda x: fields.weave(x, "k"), "SELECT k, n // 2 AS n, 16 AS h, (2 * y + n % 2) * 8 + x AS i, v FROM fr WHERE (k, (n // 2) * 2 + 1) IN (SELECT (k, n) FROM c)")
_field("doubleweave", lambda x: fields.weave(x, "k", double=True), "SELECT k, m AS n, 16 AS h, (2 * y + (CASE WHEN n = m THEN m % 2 ELSE 1 - m % 2 END)) * 8 + x AS i, v FROM fr, LATERAL (SELECT unnest([n, n - 1]) AS m) WHERE m >= 0 AND (k, m + 1) IN (SELECT (k, n) FROM c)")
_field("interlace", lambda x: fields.interlace(x, "k", lowpass=False), "SELECT k, n // 2 AS n, 8 AS h, i, v FROM fr WHERE y % 2 = n % 2 AND (k, (n // 2) * 2 + 1) IN (SELECT (k, n) FROM c)")
_field("interlace_lowpass", lambda x: fields.interlace(x, "k", "bff"), "SELECT k, n // 2 AS n, 8 AS h, i, (u + 2 * v + w) // 4 AS v FROM (SELECT *, coalesce(lag(v) OVER z, v) AS u, coalesce(lead(v) OVER z, v) AS w FROM fr WINDOW z AS (PARTITION BY k, n, x ORDER BY y)) WHERE y % 2 <> n % 2 AND (k, (n // 2) * 2 + 1) IN (SELECT (k, n) FROM c)")
_field("tinterlace_merge", lambda x: fields.tinterlace(x, "k"), "SELECT k, n // 2 AS n, 16 AS h, (2 * y + n % 2) * 8 + x AS i, v FROM fr WHERE (k, (n // 2) * 2 + 1) IN (SELECT (k, n) FROM c)")
_field("tinterlace_drop_even", lambda x: fields.tinterlace(x, "k", "drop_even"), "SELECT k, n // 2 AS n, 8 AS h, i, v FROM fr WHERE n % 2 = 0")
_field("tinterlace_pad", lambda x: fields.tinterlace(x, "k", "pad"), "SELECT k, n, 16 AS h, (2 * y + n % 2) * 8 + x AS i, v FROM fr")
_field("fieldorder", lambda x: fields.fieldorder(x), "SELECT k, n, 8 AS h, y * 8 + x AS i, coalesce(lead(v) OVER (PARTITION BY k, n, x ORDER BY y), v) AS v FROM fr")
_TELE = "VALUES (0, 0, 0), (1, 1, 1), (2, 1, 2), (3, 2, 3), (4, 3, 3)"
_field("telecine", lambda x: fields.telecine(x, "k"), f"SELECT fr.k, (fr.n // 4) * 5 + t.o AS n, 8 AS h, i, v FROM fr JOIN ({_TELE}) t(o, a, b) ON fr.n % 4 = CASE WHEN y % 2 = 0 THEN a ELSE b END WHERE (fr.k, (fr.n // 4) * 4 + a) IN (SELECT (k, n) FROM c) AND (fr.k, (fr.n // 4) * 4 + b) IN (SELECT (k, n) FROM c)")
_field("detelecine", lambda x: fields.detelecine(fields.telecine(x, "k"), "k"), "SELECT k, n, 8 AS h, i, v FROM fr WHERE n < 8 AND (k, (n // 4) * 4 + 3) IN (SELECT (k, n) FROM c) OR n % 4 < 2 AND (k, (n // 4) * 4 + 1) IN (SELECT (k, n) FROM c) AND NOT (k, (n // 4) * 4 + 3) IN (SELECT (k, n) FROM c) AND (n % 4 = 0 OR (k, (n // 4) * 4 + 1) IN (SELECT (k, n) FROM c))")
_field("repeatfields", lambda x: fields.repeatfields(x, "k", F.col("n") % 2), "SELECT k, row_number() OVER (PARTITION BY k, i ORDER BY n, r) - 1 AS n, 8 AS h, i, v FROM fr, LATERAL (SELECT unnest(range(0, 1 + n % 2)) AS r)")
_field("phase", lambda x: fields.phase(x, "k"), "SELECT k, n, 8 AS h, i, CASE WHEN y % 2 = 0 THEN v ELSE coalesce(lag(v) OVER (PARTITION BY k, i ORDER BY n), v) END AS v FROM fr")
_field("fieldhint", lambda x: fields.fieldhint(x, "k", x.sparkSession.createDataFrame([(0, 1, 0), (1, 0, 1)], "n long, top long, bottom long")), "SELECT a.k, a.n, 8 AS h, a.i, b.v FROM fr a JOIN fr b ON b.k = a.k AND b.i = a.i AND b.n = CASE WHEN a.y % 2 = 0 THEN 1 - a.n ELSE a.n END WHERE a.n < 2 AND (a.k, 1) IN (SELECT (k, n) FROM c)")
_field("deinterlaced", lambda x: fields.deinterlaced(x, "k"), "SELECT k, n, 8 AS h, i, CASE WHEN y % 2 = 0 THEN v ELSE greatest((a + b) // 2 - abs(a - b) // 2, least((a + b) // 2 + abs(a - b) // 2, (u + w) // 2)) END AS v FROM (SELECT *, coalesce(lag(v) OVER z, v) AS a, coalesce(lead(v) OVER z, v) AS b, lag(v) OVER r AS u, coalesce(lead(v) OVER r, lag(v) OVER r) AS w FROM fr WINDOW z AS (PARTITION BY k, i ORDER BY n), r AS (PARTITION BY k, n, x ORDER BY y))")
_DEEP = f"{_FR}, w AS (SELECT a.k, a.n, a.i, a.v AS here, b.v, b.n - a.n AS d FROM fr a JOIN fr b ON b.k = a.k AND b.i = a.i)"


def _time(name: str, f: Callable[[DataFrame], DataFrame], value: str, where: str, more: str = "") -> None:
    """value: of the window's v, here the pixel's own; where: which d (frames later) are in it."""
    register(f"frames_{name}", lambda s, d: _sums(f(_frames(s, d))), f"{_DEEP} SELECT k, n, 8 AS h, CAST(sum(v * (i + 1)) AS BIGINT) AS s FROM (SELECT k, n, i, {value} AS v FROM w WHERE {where} GROUP BY k, n, i, here{more}) GROUP BY k, n")


_time("tmix", lambda x: frames.tmix(x, "k"), "CAST(floor(avg(v) + 0.5) AS BIGINT)", "d BETWEEN -2 AND 0")
_time("tmedian", lambda x: frames.tmedian(x, "k"), "list_sort(list(v))[CAST(floor(0.5 * (count(*) - 1) + 0.5) AS BIGINT) + 1]", "d BETWEEN -2 AND 0")
_time("tmedian_centred", lambda x: frames.tmedian(x, "k", compat=False), "list_sort(list(v))[CAST(floor(0.5 * (count(*) - 1) + 0.5) AS BIGINT) + 1]", "d BETWEEN -1 AND 1")
_time("atadenoise", lambda x: frames.atadenoise(x, "k", 5, 0.0, 64 / 255), "CAST(floor(sum(v * greatest(0, least(1, (64 - abs(v - here)) / 64.0::DOUBLE))) / sum(greatest(0, least(1, (64 - abs(v - here)) / 64.0::DOUBLE))) + 0.5) AS BIGINT)", "d BETWEEN -4 AND 0")
_time("lagfun", lambda x: frames.lagfun(x, "k", 0.5), "CAST(floor(max(v * pow(0.5::DOUBLE, -d)) + 0.5) AS BIGINT)", "d <= 0")
_time("amplify", lambda x: frames.amplify(x, "k", 2, 0.5, 60.0, 5.0), "CASE WHEN abs(here - avg(v)) < 60 AND abs(here - avg(v)) > 5 THEN CAST(greatest(0, least(255, floor(here + (here - avg(v)) * 0.5 + 0.5))) AS BIGINT) ELSE here END", "d BETWEEN -2 AND 2")
_time("tblend", lambda x: frames.tblend(x, "k", "average"), "(here + max(v)) // 2", "d = -1")
_time("tblend_difference", lambda x: frames.tblend(x, "k", "difference", 0.5), "CAST(floor(here * 0.5 + abs(here - max(v)) * 0.5 + 0.5) AS BIGINT)", "d = -1")
register("vmafmotion", lambda s, d: frames.difference(_frames(s, d), "k").select("k", "n", "motion"), f"{_DEEP} SELECT c.k, c.n, coalesce(m, 0) AS motion FROM c LEFT JOIN (SELECT k, n, avg(abs(v - here)) AS m FROM w WHERE d = -1 GROUP BY ALL) x ON x.k = c.k AND x.n = c.n")
register("frames_mpdecimate", lambda s, d: frames.mpdecimate(_frames(s, d), "k", 1500, 1200, 0.5, 4).select("k", "n"), f"{_DEEP}, b AS (SELECT k, n, i % 8 // 4 + 2 * (i // 32) AS z, sum(abs(v - here)) AS s FROM w WHERE d = -1 GROUP BY ALL) SELECT c.k, c.n FROM c LEFT JOIN (SELECT k, n, max(s) <= 1500 AND avg((s > 1200)::INT) < 0.5 AS g FROM b GROUP BY ALL) x ON x.k = c.k AND x.n = c.n WHERE NOT coalesce(g, false)")
register("cropdetect", lambda s, d: frames.cropdetect(_frames(s, d), "k", 250, 2).select("k", "n", *[F.col(c).cast("long").alias(c) for c in ("x1", "x2", "y1", "y2", "w", "x")]), f"{_FR}, b AS (SELECT k, n, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM fr WHERE n >= 2 AND v > 250 GROUP BY ALL), r AS (SELECT c.k, c.n, min(x1) OVER z AS x1, max(x2) OVER z AS x2, min(y1) OVER z AS y1, max(y2) OVER z AS y2 FROM c LEFT JOIN b ON b.k = c.k AND b.n = c.n WINDOW z AS (PARTITION BY c.k ORDER BY c.n)) SELECT *, (x2 - x1 + 1) // 2 * 2 AS w, x1 + (x2 - x1 + 1 - (x2 - x1 + 1) // 2 * 2) // 2 AS x FROM r")
register("blackframe", lambda s, d: frames.blackframe(_frames(s, d), "k", 10, 32).select("k", "n", F.col("pblack").cast("long").alias("pblack")), f"{_FR} SELECT k, n, CAST(floor(100 * avg((v < 32)::INT)) AS BIGINT) AS pblack FROM fr GROUP BY ALL HAVING floor(100 * avg((v < 32)::INT)) >= 10")
register("blackdetect", lambda s, d: frames.blackdetect(_frames(s, d), "k", 0.11, 0.1), f"{_FR}, b AS (SELECT k, n, avg((v <= 25.5)::INT) >= 0.11 AS d FROM fr GROUP BY ALL), bp AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY k ORDER BY n), false) AS q FROM b) SELECT k, n, CASE WHEN d THEN n END AS black_start, CASE WHEN NOT d THEN n END AS black_end FROM bp WHERE d <> q")
_field("freezeframes", lambda x: frames.freezeframes(x, "k", x, 2, 4, 1), "SELECT a.k, a.n, 8 AS h, a.i, CASE WHEN a.n BETWEEN 2 AND 4 THEN coalesce(b.v, a.v) ELSE a.v END AS v FROM fr a LEFT JOIN fr b ON b.k = a.k AND b.i = a.i AND b.n = 1")
_field("tile", lambda x: frames.tile(x, "k", 2, 2, 1, 1, 7), "SELECT g.k, g.g AS n, 19 AS h, t.i, coalesce(fr.v, 7) AS v FROM (SELECT DISTINCT k, n // 4 AS g FROM c) g CROSS JOIN range(361) t(i) LEFT JOIN fr ON fr.k = g.k AND fr.n // 4 = g.g AND t.i = (fr.n % 4 // 2 * 9 + fr.y + 1) * 19 + fr.n % 2 * 9 + fr.x + 1")
register("frames_random", lambda s, d: frames.shuffled(_frames(s, d), "k", 4).groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("c"), F.sum(F.element_at("p0", 1).cast("long")).alias("v")), f"{_FR} SELECT k, sum(n) AS n, count(*) AS c, sum(v) AS v FROM fr WHERE i = 0 GROUP BY 1")

register("idet", lambda s, d: fields.idet(_frames(s, d), "k"))
register("combing", lambda s, d: fields.combing(_frames(s, d), "k").select("k", "n", "own"), f"{_FR} SELECT k, n, CAST(sum(CASE WHEN y IN (0, 7) THEN 0 ELSE abs(2 * v - u - w) END) AS BIGINT) AS own FROM (SELECT *, lag(v) OVER z AS u, lead(v) OVER z AS w FROM fr WINDOW z AS (PARTITION BY k, n, x ORDER BY y)) GROUP BY ALL")


# Generated pictures


def _made(name: str, f: Callable[[SparkSession], DataFrame], values: tuple[str, ...] | None, w: int = 16, h: int = 12, n: int = 2) -> None:
    """values: SQL of each plane over x, y and n."""
    sums = lambda df: [F.aggregate(F.transform(c, lambda v, i: v * (i + 1).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v).alias(f"s{c[1:]}") for c in df.columns if c[0] == "p"]
    sql = values and f"SELECT n, {', '.join(f'CAST(sum(CAST({v} AS BIGINT) * (y * {w} + x + 1)) AS BIGINT) AS s{k}' for k, v in enumerate(values))} FROM range({n}) a(n), range({w}) b(x), range({h}) c(y) GROUP BY n"
    register(f"src_{name}", lambda s, d: (lambda df: df.select(F.col("n").cast("long").alias("n"), *sums(df)))(f(s)), sql)


_made("color", lambda s: generators.color(s, 2, 16, 12, (1, 2, 3)), ("1", "2", "3"))
_made("rgbtestsrc", lambda s: generators.rgbtestsrc(s, 2, 16, 12), tuple(f"CASE WHEN y // 4 = {c} THEN x * 16 ELSE 0 END" for c in range(3)))
_made("yuvtestsrc", lambda s: generators.yuvtestsrc(s, 2, 16, 12), tuple(f"CASE WHEN y // 4 = {c} THEN x * 16 ELSE 128 END" for c in range(3)))
_BIT = lambda mask: f"CASE x // 2 {' '.join(f'WHEN {k} THEN {v}' for k, v in enumerate(mask))} END"
_made("pal100bars", lambda s: generators.pal100bars(s, 2, 16, 12), tuple(_BIT([255 * b[c] for b in generators.BARS]) for c in range(3)))
_made("pal75bars", lambda s: generators.pal75bars(s, 2, 16, 12), tuple(_BIT([(255 if k == 0 else 191) * b[c] for k, b in enumerate(generators.BARS)]) for c in range(3)))
_made("smptebars", lambda s: generators.smptebars(s, 2, 28, 12), None, 28)
_made("haldclutsrc", lambda s: generators.haldclutsrc(s, 2), tuple(f"floor(((y * 8 + x) // {4**k} % 4) * 255 / 3.0 + 0.5)" for k in range(3)), 8, 8, 1)
_made("zoneplate", lambda s: generators.zoneplate(s, 2, 16, 12, kt=0.3), ("greatest(0, least(255, floor(127.5 + 127.5 * sin((pow(x - 8.0::DOUBLE, 2) + pow(y - 6.0::DOUBLE, 2)) * pi() / 16 + 0.3 * n) + 0.5)))",))
_made("gradients", lambda s: generators.gradients(s, 2, 16, 12, (0, 10, 20), (255, 200, 100)), tuple(f"floor({a} + greatest(0, least(1, 0.5 + ((x - 7.5::DOUBLE) * cos(n * 0.01::DOUBLE) + (y - 5.5::DOUBLE) * sin(n * 0.01::DOUBLE)) / 16)) * ({b} - {a}) + 0.5)" for a, b in ((0, 255), (10, 200), (20, 100))))
_made("colorspectrum", lambda s: generators.colorspectrum(s, 2, 16, 12), None)
_made("mandelbrot", lambda s: generators.mandelbrot(s, 2, 16, 12, 16), None)
_made("sierpinski_triangle", lambda s: generators.sierpinski(s, 2, 16, 12, "triangle"), ("CASE WHEN x & y = 0 THEN 255 ELSE 0 END",))
_made("sierpinski", lambda s: generators.sierpinski(s, 2, 16, 12), ("CASE WHEN x % 3 = 1 AND y % 3 = 1 OR x // 3 % 3 = 1 AND y // 3 % 3 = 1 OR x // 9 % 3 = 1 AND y // 9 % 3 = 1 THEN 0 ELSE 255 END",))
_made("cellauto", lambda s: generators.cellauto(s, 16, 12, 90), None)
_made("life", lambda s: generators.life(s, 5, 8, 8, [(1, 0), (2, 1), (0, 2), (1, 2), (2, 2)]), None)
_made("perlin", lambda s: generators.perlin(s, 2, 16, 12, 2, 0.5), None)
register("src_allrgb", lambda s, d: generators.allrgb(s, 64).select(F.explode(F.arrays_zip("p0", "p1", "p2")).alias("z")).groupBy(F.col("z.p0").alias("r"), F.col("z.p1").alias("g"), F.col("z.p2").alias("b")).agg(F.count("*").alias("n")).select(*[F.col(c).cast("long").alias(c) for c in "rgb"], "n"), "SELECT (i % 16) * 17 AS r, (i // 16 % 16) * 17 AS g, (i // 256) * 17 AS b, 1 AS n FROM range(4096) t(i)")
register("src_nullsrc", lambda s, d: generators.nullsrc(s, 100), "SELECT i AS n, i * 40000 AS pts FROM range(100) t(i)")


# Spectra of embeddings


def _samples(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))


_S = "WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings)"
register("spectrum_dct", lambda s, d: spectra.transformed(_samples(s, d), "dct").select("vec_id", F.get("spectrum", F.lit(0)).alias("a"), F.get("spectrum", F.lit(5)).alias("b")), f"{_S} SELECT vec_id, sum(x) AS a, sum(x * cos(pi() / 64 * (i + 0.5::DOUBLE) * 5)) AS b FROM e GROUP BY 1")
register("spectrum_fft", lambda s, d: spectra.transformed(_samples(s, d), "rdft").select("vec_id", F.get("spectrum", F.lit(6)).alias("re"), F.get("spectrum", F.lit(7)).alias("im")), f"{_S} SELECT vec_id, sum(x * cos(2 * pi() * 3 * i / 64)) AS re, -sum(x * sin(2 * pi() * 3 * i / 64)) AS im FROM e GROUP BY 1")
register("spectrum_dst", lambda s, d: spectra.transformed(_samples(s, d), "dst").select("vec_id", F.get("spectrum", F.lit(2)).alias("a")), f"{_S} SELECT vec_id, sum(x * sin(pi() / 65 * (i + 1) * 3)) AS a FROM e GROUP BY 1")
register("spectrum_mdct", lambda s, d: spectra.transformed(_samples(s, d), "mdct").select("vec_id", F.get("spectrum", F.lit(4)).alias("a")), f"{_S} SELECT vec_id, sum(x * cos(pi() / 32 * (i + 16.5::DOUBLE) * 4.5::DOUBLE)) AS a FROM e GROUP BY 1")
register("spectral_statistics", lambda s, d: spectra.spectral_statistics(_samples(s, d), 8000.0).drop("samples"))
register("aresample", lambda s, d: spectra.aresample(_samples(s, d), 8000, 12_000).select("vec_id", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total")))
for _name, _options in (("dctdnoiz", (10.0,)), ("fftdnoiz", (10.0,)), ("owdenoise", (8.0,)), ("nlmeans", (3.0,))):
    register(f"vf_{_name}", lambda s, d, name=_name, options=_options: video.digest(spectra.on_plane(video.frames(s, d), name, *options)))
register("ssim", lambda s, d: spectra.ssim_pairs(video.frames(s, d).withColumnRenamed("p0", "a").join(video.second(s, d).select("vec_id", F.col("p0").alias("b")), "vec_id")).select("vec_id", "ssim"))
register("siti", lambda s, d: spectra.siti(_frames(s, d), "k").select("k", "n", "si", "ti"))


# Parsers: frames that a file is made of, from turns of conversations


def _built(make: str) -> Callable[[SparkSession, str], DataFrame]:
    """One file for each conversation: the hexadecimal text of each turn's frame, in order."""

    def run(s: SparkSession, d: str) -> DataFrame:
        turns = s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.expr(make).alias("h"))
        files = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "h"))).alias("p"))
        return files.select("conv_id", F.unhex(F.concat_ws("", F.transform("p", lambda x: x["h"]))).alias("content"))

    return run


def _parsed(codec: str, make: str, sql: str) -> None:
    register(f"parse_{codec}", lambda s, d: streams.frame(_built(make)(s, d), codec).select("conv_id", F.col("n").cast("long").alias("n"), F.hex("payload").alias("data")), f"SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, {sql} AS data FROM conversations")


# sixteen bytes of data behind each header
_D16, _D16SQL = "hex(md5(text))", "upper(hex(encode(md5(text))))"
_parsed("aac", f"concat('FFF15080', '04FFFC', {_D16})", f"'FFF1508004FFFC' || {_D16SQL}")
_parsed("aac_latm", f"concat('56E020', {_D16})", f"'56E020' || {_D16SQL}")
_parsed("h264", f"concat('000000016742', '00000001', '65FF', {_D16})", f"'00000001674200000001' || '65FF' || {_D16SQL}")
_parsed("hevc", f"concat('000000014001', '00000001', '2601FF', {_D16})", f"'00000001400100000001' || '2601FF' || {_D16SQL}")
_parsed("mpeg2video", f"concat('000001B3', 'AABB', '000001', '00', '0008', {_D16})", f"'000001B3AABB00000100' || '0008' || {_D16SQL}")
_parsed("mpeg4", f"concat('000001B6', '10', {_D16})", f"'000001B610' || {_D16SQL}")
_parsed("av1", f"concat('1200', '3220', {_D16})", f"'12003220' || {_D16SQL}")
_parsed("mjpeg", f"concat('FFD8FFE00004', 'AABB', {_D16}, 'FFD9')", f"'FFD8FFE00004AABB' || {_D16SQL} || 'FFD9'")
_parsed("ac3", f"concat('0B77', '0000', '00', '40', {_D16}, repeat('00', 90))", f"'0B7700000040' || {_D16SQL} || repeat('00', 90)")
_parsed("mp3", f"concat('FFFB1000', {_D16}, repeat('00', 68))", f"'FFFB1000' || {_D16SQL} || repeat('00', 68)")


# Scalar text

register("text_sexagesimal", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", text.sexagesimal(F.col("value") * 100).alias("t")), "SELECT event_id, printf('%d:%02d:%02d.%06d', m // 3600000000, m // 60000000 % 60, m // 1000000 % 60, m % 1000000) AS t FROM (SELECT event_id, CAST(floor(value * 100 * 1000000 + 0.5) AS BIGINT) AS m FROM events)")
register("text_duration", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", text.duration_micros(F.concat((F.col("event_id") % 7).cast("string"), F.lit(":"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(":30.25"))).alias("a"), text.duration_micros(F.concat(F.col("event_id").cast("string"), F.lit("ms"))).alias("b")), "SELECT event_id, (event_id % 7) * 3600000000 + (event_id % 60) * 60000000 + 30250000 AS a, event_id * 1000 AS b FROM events")
register("text_prefix", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", text.prefixed(F.col("n_chars"), "byte").alias("t")), "SELECT doc_id, CASE WHEN n_chars >= 1000 THEN printf('%.6f', n_chars / 1000.0::DOUBLE) || ' Kbyte' ELSE n_chars::VARCHAR || ' byte' END AS t FROM documents")
register("text_hex_dump", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.size(F.split(text.hex_dump(F.col("text").cast("binary")), "\n")).cast("long").alias("lines"), F.substring(text.hex_dump(F.col("text").cast("binary")), 1, 49).alias("first")), "SELECT conv_id, turn, CASE WHEN n = 0 THEN 1 ELSE (n + 15) // 16 + 1 END AS lines, CASE WHEN n = 0 THEN '' ELSE '00000000: ' || substr(regexp_replace(rpad(lower(hex(encode(text))), greatest(32, 2 * n)::INT, ' '), '(....)', '\\1 ', 'g'), 1, 39) END AS first FROM (SELECT *, octet_length(encode(text)) AS n FROM conversations)")
register("text_language", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", text.language(F.col("lang")).alias("b"), text.language(text.language(F.col("lang")), "terminological").alias("t")), "SELECT doc_id, CASE lang WHEN 'de' THEN 'ger' WHEN 'en' THEN 'eng' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fre' END AS b, CASE lang WHEN 'de' THEN 'deu' WHEN 'en' THEN 'eng' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' END AS t FROM documents")
register("text_glob", lambda s, d: s.read.parquet(f"{d}/part.parquet").filter(F.col("p_type").rlike(text.glob_pattern("*[NS]*{TIN,STEEL}"))).select("p_partkey", "p_type"), "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^.*[NS].*(TIN|STEEL)$')")
register("text_rational", lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", text.rational(F.col("l_quantity").cast("long"), F.lit(12).cast("long")).alias("t")), "SELECT l_orderkey, l_linenumber, (CAST(l_quantity AS BIGINT) // gcd(CAST(l_quantity AS BIGINT), 12)) || '/' || (12 // gcd(CAST(l_quantity AS BIGINT), 12)) AS t FROM lineitem")
register("text_base64", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.regexp_replace(F.base64(F.col("text").cast("binary")), "\\s", "").alias("t")), "SELECT conv_id, turn, to_base64(encode(text)) AS t FROM conversations")

# Paths

register("protocol_crypto", lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.decode(paths.decrypted(paths.encrypted(F.col("text").cast("binary"), b"0123456789abcdef", b"fedcba9876543210"), b"0123456789abcdef", b"fedcba9876543210"), "UTF-8").alias("text")), "SELECT conv_id, turn, text FROM conversations")
register("protocol_data", lambda s, d: paths.open_source(s, "data:;base64,aGVsbG8=").select(F.decode("content", "UTF-8").alias("t")), "SELECT 'hello' AS t")
register("protocol_subfile", lambda s, d: paths.open_source(s, "subfile,,start,1,end,4,,:data:,hello").select(F.decode("content", "UTF-8").alias("t")), "SELECT 'ell' AS t")
register("protocol_concat", lambda s, d: paths.open_source(s, "concat:data:,ab|data:,cd").select(F.decode("content", "UTF-8").alias("t")), "SELECT 'abcd' AS t")
register("protocol_md5", lambda s, d: s.createDataFrame([(paths.md5_of(s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.col("text").cast("binary").alias("payload")), ["conv_id", "turn"]),)], "hash string"), "SELECT md5(string_agg(text, '' ORDER BY conv_id, turn)) AS hash FROM conversations")


# The inspector, over WAVE files of documents


def _files(s: SparkSession, d: str) -> DataFrame:
    own = s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    return containers.mux(own.withColumns({"codec": F.lit("u8"), "rate": F.lit(8000), "channels": F.lit(1)}), "wav").select("path", "content")


_N = "(SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n FROM documents)"
register("inspect_streams", lambda s, d: inspector.inspect(_files(s, d), ["-show_streams", "-show_entries", "stream=codec_name,sample_rate,channels,duration_ts", "-of", "compact"]).select("path", "text"), f"SELECT doc_id::VARCHAR AS path, 'stream|codec_name=pcm_u8|sample_rate=8000|channels=1|duration_ts=' || n AS text FROM {_N}")
register("inspect_format", lambda s, d: inspector.inspect(_files(s, d), ["-show_format", "-show_entries", "format=format_name,size,duration", "-of", "csv"]).select("path", "text"), f"SELECT doc_id::VARCHAR AS path, 'format,wav,' || printf('%.6f', n / 8000.0::DOUBLE) || ',' || (44 + n + n % 2) AS text FROM {_N}")
register("inspect_packets", lambda s, d: inspector.inspect(_files(s, d), ["-show_packets", "-show_entries", "packet=pts,size", "-read_intervals", "%+#2", "-of", "default"]).select("path", "text"), f"SELECT doc_id::VARCHAR AS path, '[PACKET]' || chr(10) || 'pts=' || k * 4096 || chr(10) || 'size=' || least(4096, n - k * 4096) || chr(10) || '[/PACKET]' || chr(10) AS text FROM {_N}, range(2) t(k) WHERE k * 4096 < n")
register("inspect_count", lambda s, d: inspector.inspect(_files(s, d), ["-show_streams", "-count_packets", "-show_entries", "stream=nb_read_packets", "-of", "default=nokey=1:noprint_wrappers=1"]).select("path", "text"), f"SELECT doc_id::VARCHAR AS path, ((n + 4095) // 4096) || chr(10) AS text FROM {_N}")
register("inspect_formats", lambda s, d: inspector.listing(s, "-demuxers").groupBy().agg((F.count("*") > 60).alias("many")), "SELECT true AS many")
