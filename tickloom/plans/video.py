"""Registered queries of the pixel filters, with DuckDB SQL for the same rows.

Frames: each row of ``embeddings`` is one of 8 x 8 pixels. Plane k of pixel i is made of the component e as the SQL says;
the other inputs of filters that take several (q, r) are made of plane 0. A result row holds the size of a frame and, for
each plane, the sum of its values times their places, counted from 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

BASE = """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(CAST(embedding AS DOUBLE[])) AS e FROM embeddings),
p AS (SELECT vec_id, i, i % 8 AS x, i // 8 AS y, ((CAST(floor(e * 1000) AS BIGINT) % 256) + 256) % 256 AS v0 FROM e),
px AS (SELECT *, (v0 * 7 + i * 13) % 256 AS v1, (v0 * 3 + i * 29 + 101) % 256 AS v2, (v0 * 5 + i * 11 + 3) % 256 AS v3, (v0 * 5 + i * 11 + 3) % 256 AS q, (v0 * 3 + i * 29 + 101) % 256 AS r FROM p),
ids AS (SELECT DISTINCT vec_id FROM px)"""


def frames(spark: SparkSession, sf_dir: str, planes: int = 1) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda v: F.pmod(F.floor(v * 1000), F.lit(256)).cast("int")).alias("p0"))
    made = [(7, 13, 0), (3, 29, 101), (5, 11, 3)]
    out = e.select("vec_id", F.lit(8).alias("w"), F.lit(8).alias("h"), "p0", *[_made("p0", *m).alias(f"p{k + 1}") for k, m in enumerate(made[: planes - 1])])
    return out


def _made(p: str, a: int, b: int, c: int):
    return F.transform(p, lambda v, i: (v * a + i * b + c) % 256)


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("p0", _made("p0", 5, 11, 3))


def third(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).withColumn("p0", _made("p0", 3, 29, 101))


def digest(df: DataFrame) -> DataFrame:
    sums = [F.aggregate(F.transform(c, lambda v, i: v * (i + 1).cast("long")), F.lit(0).cast("long"), lambda a, v: a + v).alias(f"s{c[1:]}") for c in df.columns if c[:1] == "p" and c[1:].isdigit()]
    return df.select("vec_id", "w", "h", *sums)


def _sums(rows: str, planes: int = 1, w: int = 8, h: int = 8) -> str:
    """Of rows (vec_id, i, c0, c1 ..)."""
    return f"SELECT vec_id, {w} AS w, {h} AS h, {', '.join(f'CAST(sum(c{k} * (i + 1)) AS BIGINT) AS s{k}' for k in range(planes))} FROM ({rows}) GROUP BY vec_id"


def _near(c: str) -> str:
    return f"greatest(0, least(7, {c}))"


def gathered(sx: str, sy: str, w: int = 8, h: int = 8, planes: int = 1) -> str:
    """Each pixel (x, y) of a frame of w x h from (sx, sy)."""
    return f"SELECT o.vec_id, o.i, {', '.join(f'p.v{k} AS c{k}' for k in range(planes))} FROM (SELECT vec_id, i, i % {w} AS x, i // {w} AS y FROM ids, range({w * h}) t(i)) o JOIN px p ON p.vec_id = o.vec_id AND p.x = {_near(sx.replace('x', 'o.x').replace('y', 'o.y'))} AND p.y = {_near(sy.replace('x', 'o.x').replace('y', 'o.y'))}"


def around(value: str, r: int = 1, ry: int | None = None, column: str = "v0", source: str = "px") -> str:
    """``value`` of the neighbours v at (dx, dy); here: the pixel itself."""
    ry = r if ry is None else ry
    return f"""SELECT vec_id, i, {value} AS c0 FROM (SELECT a.vec_id, a.i, a.{column} AS here, dx, dy, b.{column} AS v FROM {source} a, range(-{r}, {r + 1}) s(dx), range(-{ry}, {ry + 1}) t(dy)
    JOIN {source} b ON b.vec_id = a.vec_id AND b.x = {_near('a.x + dx')} AND b.y = {_near('a.y + dy')}) GROUP BY vec_id, i, here"""


def each(*values: str) -> str:
    """Expressions of a pixel's v0 .. v3, q, r."""
    return f"SELECT vec_id, i, {', '.join(f'{v} AS c{k}' for k, v in enumerate(values))} FROM px"


def byte(x: str) -> str:
    return f"CAST(greatest(0, least(255, floor({x} + 0.5))) AS BIGINT)"


def vf(name: str, rows: str | None, planes: int = 1, w: int = 8, h: int = 8, given: int | None = None, filter: str | None = None, inputs: int = 1, base: str = BASE, extra: dict | None = None, **options) -> None:
    options |= extra or {}

    def run(s: SparkSession, d: str) -> DataFrame:
        own = [frames(s, d, given or planes), second(s, d), third(s, d), third(s, d).withColumn("p0", _made("p0", 1, 0, 64))][:inputs]
        key = filter or name
        return digest(pixels.apply(own[0], key, **options) if inputs == 1 else pixels.apply_joined(key, ["vec_id"], *own, **options))

    QUERIES[f"vf_{name}"] = run
    if rows:
        ORACLE_SQL[f"vf_{name}"] = f"{base} {_sums(rows, planes, w, h)}"


vf("hflip", gathered("7 - x", "y"))
vf("vflip", gathered("x", "7 - y"))
vf("transpose", gathered("y", "x"))
vf("transpose_clock", gathered("y", "7 - x"), filter="transpose", dir="clock")
vf("transpose_cclock", gathered("7 - y", "x"), filter="transpose", dir="cclock")
vf("transpose_clock_flip", gathered("7 - y", "7 - x"), filter="transpose", dir="clock_flip")
vf("crop", gathered("x + 2", "y + 1", 3, 5), w=3, h=5, out_w=3, out_h=5)
vf("pad", "SELECT o.vec_id, o.i, coalesce(p.v0, 9) AS c0 FROM (SELECT vec_id, i, i % 12 - 2 AS x, i // 12 - 1 AS y FROM ids, range(120) t(i)) o LEFT JOIN px p ON p.vec_id = o.vec_id AND p.x = o.x AND p.y = o.y", w=12, h=10, width=12, height=10, x=2, y=1, color=(9, 9, 9, 9))
vf("scale_neighbor", gathered("CAST(floor((x + 0.5) * 8 / 5) AS BIGINT)", "CAST(floor((y + 0.5) * 8 / 12) AS BIGINT)", 5, 12), w=5, h=12, filter="scale", width=5, height=12, flags="neighbor")
vf("scale", f"""SELECT vec_id, i, {byte('sum(v * wx * wy)')} AS c0 FROM (SELECT o.vec_id, o.i, p.v0 AS v, CASE WHEN dx = 0 THEN 1 - (u - floor(u)) ELSE u - floor(u) END AS wx, CASE WHEN dy = 0 THEN 1 - (t - floor(t)) ELSE t - floor(t) END AS wy
    FROM (SELECT vec_id, i, (i % 16 + 0.5::DOUBLE) * 8 / 16 - 0.5 AS u, (i // 16 + 0.5::DOUBLE) * 8 / 4 - 0.5 AS t FROM ids, range(64) t(i)) o, range(2) a(dx), range(2) b(dy) JOIN px p ON p.vec_id = o.vec_id AND p.x = greatest(0, least(7, floor(u) + dx)) AND p.y = greatest(0, least(7, floor(t) + dy))) GROUP BY vec_id, i""", w=16, h=4, width=16, height=4)
vf("rotate_90", gathered("y", "7 - x"), filter="rotate", angle=1.5707963267948966)
vf("field", gathered("x", "2 * y", 8, 4), h=4)
vf("il_deinterleave", gathered("x", "CASE WHEN y < 4 THEN 2 * y ELSE 2 * (y - 4) + 1 END"), filter="il", luma_mode="d")
vf("il_interleave", gathered("x", "CASE WHEN y % 2 = 1 THEN y // 2 ELSE 4 + y // 2 END"), filter="il", luma_mode="i", luma_swap=True)
vf("scroll", gathered("(x + 2) % 8", "(y + 4) % 8"), hpos=0.25, vpos=0.5)
vf("fillborders_smear", gathered("greatest(2, least(6, x))", "greatest(1, least(4, y))"), filter="fillborders", left=2, right=1, top=1, bottom=3)
vf("fillborders_mirror", gathered("CASE WHEN x < 2 THEN 3 - x WHEN x >= 7 THEN 13 - x ELSE x END", "y"), filter="fillborders", left=2, right=1, mode="mirror")
vf("fillborders_wrap", gathered("CASE WHEN x < 2 THEN 5 + x WHEN x >= 7 THEN x - 5 ELSE x END", "y"), filter="fillborders", left=2, right=1, mode="wrap")
vf("fillborders_fixed", each("CASE WHEN x < 2 OR x >= 7 THEN 9 ELSE v0 END"), filter="fillborders", left=2, right=1, mode="fixed", color=(9, 9, 9, 9))
for _mode, _agg in (("avg", "CAST(sum(v0) OVER b // count(*) OVER b AS BIGINT)"), ("min", "min(v0) OVER b"), ("max", "max(v0) OVER b")):
    vf(f"pixelize_{_mode}", f"SELECT vec_id, i, {_agg} AS c0 FROM px WINDOW b AS (PARTITION BY vec_id, x // 3, y // 5)", filter="pixelize", width=3, height=5, mode=_mode)
vf("shuffleplanes", each("v2", "v0", "v1"), 3, map0=2, map1=0, map2=1)
vf("swapuv", each("v0", "v2", "v1"), 3)
vf("alphaextract", each("v3"), given=4)
vf("alphamerge", each("v0", "v1", "v2", "q"), 4, given=3, inputs=2)
vf("hstack", "SELECT vec_id, y * 16 + x AS i, v0 AS c0 FROM px UNION ALL SELECT vec_id, y * 16 + x + 8, q FROM px", w=16, inputs=2)
vf("vstack", "SELECT vec_id, i, v0 AS c0 FROM px UNION ALL SELECT vec_id, i + 64, q FROM px", h=16, inputs=2)
vf("xstack", "SELECT o.vec_id, o.i, coalesce(q.q, p.v0, 0) AS c0 FROM (SELECT vec_id, i, i % 12 AS x, i // 12 AS y FROM ids, range(144) t(i)) o LEFT JOIN px p ON p.vec_id = o.vec_id AND p.x = o.x AND p.y = o.y LEFT JOIN px q ON q.vec_id = o.vec_id AND q.x = o.x - 4 AND q.y = o.y - 3", w=12, h=12, inputs=2, layout=((0, 0), (4, 3)), width=12, height=12)
vf("overlay", "SELECT p.vec_id, p.i, coalesce(o.q, p.v0) AS c0 FROM px p LEFT JOIN px o ON o.vec_id = p.vec_id AND o.x = p.x - 3 AND o.y = p.y + 2", inputs=2, x=3, y=-2)
vf("framepack_lines", "SELECT vec_id, (2 * y) * 8 + x AS i, v0 AS c0 FROM px UNION ALL SELECT vec_id, (2 * y + 1) * 8 + x, q FROM px", h=16, filter="framepack", inputs=2, format="lines")
vf("framepack_columns", "SELECT vec_id, y * 16 + 2 * x AS i, v0 AS c0 FROM px UNION ALL SELECT vec_id, y * 16 + 2 * x + 1, q FROM px", w=16, filter="framepack", inputs=2, format="columns")
vf("weave", "SELECT vec_id, (2 * y + 1) * 8 + x AS i, v0 AS c0 FROM px UNION ALL SELECT vec_id, (2 * y) * 8 + x, q FROM px", h=16, inputs=2, first_field="bottom")
for _edge, _fold in (("smear", "greatest(0, least(7, {0}))"), ("wrap", "(({0}) % 8 + 8) % 8"), ("mirror", "CASE WHEN (({0}) % 16 + 16) % 16 < 8 THEN (({0}) % 16 + 16) % 16 ELSE 15 - (({0}) % 16 + 16) % 16 END")):
    vf(f"displace_{_edge}", f"SELECT a.vec_id, a.i, b.v0 AS c0 FROM px a JOIN px b ON b.vec_id = a.vec_id AND b.x = {_fold.format('a.x + a.q - 128')} AND b.y = {_fold.format('a.y + a.r - 128')}", filter="displace", inputs=3, edge=_edge)
vf("remap", "SELECT a.vec_id, a.i, coalesce(b.v0, 0) AS c0 FROM px a LEFT JOIN px b ON b.vec_id = a.vec_id AND b.x = a.q AND b.y = a.r", inputs=3)

vf("convolution", around(byte("sum(v * CASE WHEN dx = 0 AND dy = 0 THEN 5.0 WHEN dx * dy = 0 THEN -1.0 ELSE 0.0 END)")), matrix="0 -1 0 -1 5 -1 0 -1 0")
vf("convolution_row", around(byte("sum(v * (dx + 2.0)) / 6.0 + 3"), 1, 0), filter="convolution", matrix="1 2 3", mode="row", bias=3.0)
for _name, _gx, _by in (("sobel", "dx * CASE WHEN dy = 0 THEN 2.0 ELSE 1.0 END", 1), ("prewitt", "dx * 1.0", 1), ("scharr", "dx * CASE WHEN dy = 0 THEN 10.0 ELSE 3.0 END", 16)):
    _gy = _gx.replace("dx", "~").replace("dy", "dx").replace("~", "dy")
    vf(_name, around(byte(f"sqrt(pow(sum(v * {_gx}) / {_by}, 2) + pow(sum(v * {_gy}) / {_by}, 2))")))
vf("roberts", around(byte("sqrt(pow(CAST(sum(CASE WHEN dx = 0 AND dy = 0 THEN v WHEN dx = 1 AND dy = 1 THEN -v ELSE 0 END) AS DOUBLE), 2) + pow(CAST(sum(CASE WHEN dx = 1 AND dy = 0 THEN v WHEN dx = 0 AND dy = 1 THEN -v ELSE 0 END) AS DOUBLE), 2))")))
_RING = "CASE dy * 3 + dx WHEN -4 THEN 0 WHEN -3 THEN 1 WHEN -2 THEN 2 WHEN 1 THEN 3 WHEN 4 THEN 4 WHEN 3 THEN 5 WHEN 2 THEN 6 WHEN -1 THEN 7 END"
vf("kirsch", around(byte("greatest(" + ", ".join(f"sum(CASE WHEN dx = 0 AND dy = 0 THEN 0 WHEN (({_RING}) - {t} + 8) % 8 < 3 THEN 5 * v ELSE -3 * v END)" for t in range(8)) + ") / 3.0")))
vf("dilation", around("CAST(least(max(v), here + 20) AS BIGINT)"), thresholds=(20,) * 4)
vf("dilation_cross", around("CAST(max(CASE WHEN dx * dy = 0 THEN v END) AS BIGINT)"), filter="dilation", coordinates=90)
vf("erosion", around("CAST(greatest(min(v), here - 20) AS BIGINT)"), thresholds=(20,) * 4)
vf("inflate", around("CAST(greatest(here, (sum(v) - here) // 8) AS BIGINT)"))
vf("deflate", around("CAST(least(here, (sum(v) - here) // 8) AS BIGINT)"))
vf("median", around("CAST(list_sort(list(v))[5] AS BIGINT)"))
vf("median_r2", around("CAST(list_sort(list(v))[19] AS BIGINT)", 2), filter="median", radius=2, percentile=0.75)
vf("avgblur", around("CAST(sum(v) // 15 AS BIGINT)", 1, 2), size_x=1, size_y=2)
vf("boxblur", f"{around('CAST((2 * sum(v) + 25) // 50 AS BIGINT)', 2, source='once', column='c0')}", base=BASE + f", half AS ({around('CAST((2 * sum(v) + 25) // 50 AS BIGINT)', 2)}), once AS (SELECT *, i % 8 AS x, i // 8 AS y FROM half)")
vf("unsharp", around(byte("here + 1.5 * (here - (2 * sum(v) + 25) // 50)"), 2), luma_amount=1.5)
vf("morpho_erode", around("min(v)"), filter="morpho")
vf("morpho_gradient", around("max(v) - min(v)"), filter="morpho", mode="gradient")
_OPEN = BASE + f", half AS ({around('min(v)')}), once AS (SELECT *, i % 8 AS x, i // 8 AS y FROM half)"
vf("morpho_open", around("max(v)", source="once", column="c0"), base=_OPEN, filter="morpho", mode="open")
vf("guided", None, radius=1)
vf("gblur", None, sigma=0.8)
vf("epx", None, w=16, h=16)
vf("perspective", None, x0=1, y0=0, x1=8, y1=1, x2=0, y2=7, x3=7, y3=8)

vf("lut", each("CAST(greatest(0, least(255, 255 - v0 // 2)) AS BIGINT)"), c0="negval+floor(val/2)+mod(val,2)")
vf("lutyuv", each("255 - v0", "greatest(16, least(240, v1))", "v2 // 2"), 3, c0="negval", c1="clip(val,16,240)", c2="val/2")
vf("lut2", each("(v0 + q) // 2"), inputs=2, c0="(x+y)/2")
vf("pseudocolor", each("v0", "255 - v0", "v0 * v0 // 255"), 3, given=1, c1="negval", c2="val*val/255")
vf("colorchannelmixer", each(byte("v0 * 0.5 + v1 * 0.25"), byte("v1 * 1.0 - v2 * 0.5"), byte("v2 * 1.5")), 3, rr=0.5, rg=0.25, gb=-0.5, bb=1.5)
vf("colorlevels", each("CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v0 / 255.0::DOUBLE - 0.25) / 0.5)) * 255.0) AS BIGINT)", "CAST(floor((0.5::DOUBLE + v1 / 255.0::DOUBLE * 0.5) * 255.0) AS BIGINT)", "CAST(floor(v2 / 255.0::DOUBLE * 255.0) AS BIGINT)"), 3, rimin=0.25, rimax=0.75, gomin=0.5)
vf("hue", each("v0", byte("128 - (v2 - 128)"), byte("v1 - 128.0 + 128")), 3, extra={"h": 90.0})
vf("hue_saturation", each("v0", byte("(v1 - 128) * 0.5 + 128"), byte("(v2 - 128) * 0.5 + 128")), 3, filter="hue", s=0.5)
vf("colormatrix", None, 3, src="bt601", dst="bt709")
vf("exposure", each(byte("v0 * 2.0")), exposure=1.0)
vf("normalize", None, 3)
vf("limitdiff", each(f"CASE WHEN abs(v0 - q) <= 51 THEN v0 WHEN abs(v0 - q) >= 102 THEN q ELSE {byte('v0 + (q - v0) * (abs(v0 - q) - 51) / 51.0')} END"), inputs=2, threshold=0.2)
vf("multiply", each(byte("v0 / 255.0::DOUBLE * (q / 255.0::DOUBLE) * 255 + 0.5 * 255")), inputs=2)
vf("mix", each("CAST(round_even((v0 * 1.0::DOUBLE + q * 2.0 + r) / 4.0, 0) AS BIGINT)"), inputs=3, weights=(1.0, 2.0, 1.0))
vf("xmedian", each("list_sort([v0, q, r])[2]"), inputs=3)
vf("xfade", each("CAST(floor(v0 + 0.25 * (q - v0)) AS BIGINT)"), inputs=2, progress=0.25)
vf("maskedmerge", each(byte("v0 + (q - v0) * r / 255.0::DOUBLE")), inputs=3)
vf("maskedclamp", each("greatest(greatest(0, q - 5), least(greatest(least(255, r + 5), greatest(0, q - 5)), v0))"), inputs=3, undershoot=5, overshoot=5)
vf("maskedmax", each("CASE WHEN abs(v0 - r) > abs(v0 - q) THEN r ELSE q END"), inputs=3)
vf("maskedmin", each("CASE WHEN abs(v0 - r) < abs(v0 - q) THEN r ELSE q END"), inputs=3)
vf("maskedthreshold", each("CASE WHEN abs(v0 - q) <= 60 THEN v0 ELSE q END"), inputs=2, threshold=60)
vf("threshold", each("CASE WHEN v0 > q THEN (r + 64) % 256 ELSE r END"), inputs=4)
vf("premultiply", each(byte("v0 * q / 255.0::DOUBLE")), inputs=2)
vf("unpremultiply", each(f"CASE WHEN q = 0 THEN 0 ELSE {byte('v0 * 255.0::DOUBLE / greatest(q, 1)')} END"), inputs=2)
vf("colorkey", each("v0", "v1", "v2", "CASE WHEN sqrt(pow(v0 / 255.0::DOUBLE - 128 / 255.0::DOUBLE, 2) + pow(v1 / 255.0::DOUBLE - 128 / 255.0::DOUBLE, 2) + pow(v2 / 255.0::DOUBLE - 128 / 255.0::DOUBLE, 2)) / sqrt(3.0) > 0.3 THEN 255 ELSE 0 END"), 4, given=3, color=(128, 128, 128), similarity=0.3)
vf("colorhold", None, 3, color=(128, 128, 128), similarity=0.3, blend=0.2)
vf("drawbox", each("CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 2 AND 6 AND (x = 1 OR x = 6 OR y = 2 OR y = 6) THEN 200 ELSE v0 END"), x=1, y=2, width=6, height=5, thickness=1, color=(200,) * 4)
vf("drawgrid", each("CASE WHEN (x + 2) % 3 = 0 OR (y + 3) % 4 = 0 THEN 200 ELSE v0 END"), x=1, y=1, width=3, height=4, color=(200,) * 4)

vf("cas", None, strength=0.5)
for _m in (1, 2, 4):
    vf(f"removegrain_{_m}", around(f"greatest(list_sort(list(v) FILTER (WHERE dx <> 0 OR dy <> 0))[{_m}], least(list_sort(list(v) FILTER (WHERE dx <> 0 OR dy <> 0))[{9 - _m}], here))"), filter="removegrain", m0=_m)
vf("varblur", "SELECT a.vec_id, a.i, CAST(sum(b.v0) // count(*) AS BIGINT) AS c0 FROM (SELECT *, CAST(floor(3 * q / 255.0::DOUBLE + 0.5) AS BIGINT) AS rad FROM px) a, range(-3, 4) s(dx), range(-3, 4) t(dy) JOIN px b ON b.vec_id = a.vec_id AND b.x = greatest(0, least(7, a.x + dx)) AND b.y = greatest(0, least(7, a.y + dy)) WHERE abs(dx) <= a.rad AND abs(dy) <= a.rad GROUP BY a.vec_id, a.i", inputs=2, max_r=3)
vf("vignette", each("CAST(floor(v0 * CASE WHEN pi() / 5 * sqrt(pow(x - 4.0::DOUBLE, 2) + pow(y - 4.0::DOUBLE, 2)) / sqrt(32.0::DOUBLE) < pi() / 2 THEN pow(cos(pi() / 5 * sqrt(pow(x - 4.0::DOUBLE, 2) + pow(y - 4.0::DOUBLE, 2)) / sqrt(32.0::DOUBLE)), 4) ELSE 0 END) AS BIGINT)"))
vf("delogo", "SELECT p.vec_id, p.i, CASE WHEN p.x BETWEEN 2 AND 4 AND p.y BETWEEN 3 AND 5 THEN CAST(floor(((l.v0 * (5 - p.x) + r.v0 * (p.x - 1)) / 4.0::DOUBLE * (p.y - 2) * (6 - p.y) + (t.v0 * (6 - p.y) + b.v0 * (p.y - 2)) / 4.0::DOUBLE * (p.x - 1) * (5 - p.x)) / ((p.y - 2) * (6 - p.y) + (p.x - 1) * (5 - p.x)) + 1e-9) AS BIGINT) ELSE p.v0 END AS c0 FROM px p JOIN px l ON l.vec_id = p.vec_id AND l.x = 1 AND l.y = p.y JOIN px r ON r.vec_id = p.vec_id AND r.x = 5 AND r.y = p.y JOIN px t ON t.vec_id = p.vec_id AND t.y = 2 AND t.x = p.x JOIN px b ON b.vec_id = p.vec_id AND b.y = 6 AND b.x = p.x", extra={"x": 2, "y": 3, "w": 3, "h": 3})
vf("noise", None, strength=5)
vf("lut1d", each("CAST(floor(CASE WHEN v0 <= 127 THEN v0 / 255.0::DOUBLE * 2 * 0.5 * 255 + 1e-6 ELSE (0.5 + (v0 / 255.0::DOUBLE * 2 - 1) * 0.5) * 255 + 1e-6 END) AS BIGINT)", "CAST(floor(CASE WHEN v1 <= 127 THEN v1 / 255.0::DOUBLE * 2 * 0.25 * 255 + 1e-6 ELSE (0.25 + (v1 / 255.0::DOUBLE * 2 - 1) * 0.75) * 255 + 1e-6 END) AS BIGINT)", "CAST(floor(CASE WHEN v2 <= 127 THEN v2 / 255.0::DOUBLE * 2 * 0.75 * 255 + 1e-6 ELSE (0.75 + (v2 / 255.0::DOUBLE * 2 - 1) * 0.25) * 255 + 1e-6 END) AS BIGINT)"), 3, table=((0.0, 0.0, 0.0), (0.5, 0.25, 0.75), (1.0, 1.0, 1.0)))
_CUBE = tuple((r / 2, g / 2, b / 2) for b in range(3) for g in range(3) for r in range(3))
vf("lut3d", each("v0", "v1", "v2"), 3, table=_CUBE, size=3)
vf("lut3d_nearest", each(*[f"CAST(floor(floor(v{k} / 255.0::DOUBLE * 2 + 0.5) * 127.5 + 0.5) AS BIGINT)" for k in range(3)]), 3, filter="lut3d", table=_CUBE, size=3, interp="nearest")
vf("paletteuse", each(*[f"CASE WHEN pow(v0 - 0, 2) + pow(v1 - 0, 2) + pow(v2 - 0, 2) <= pow(v0 - 255, 2) + pow(v1 - 128, 2) + pow(v2 - 64, 2) THEN 0 ELSE {c} END" for c in (255, 128, 64)]), 3, palette=((0, 0, 0), (255, 128, 64)))
