import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import audio, order, pixels, recursive, timing
from tickloom.streaming import windows as live

RATE = 8000.0


@pytest.fixture(scope="module")
def two(spark):
    """Two streams, shuffled; in several batches."""
    rows = [(k, n, math.sin(n / 7 + k) * (1 + k)) for k in (1, 2) for n in range(600)]
    return spark.createDataFrame(rows, "k int, pts long, v double").repartition(5)


def series(df, column="v"):
    got = df.orderBy("k", "pts").select("k", column).collect()
    return {k: np.array([r[1] for r in got if r[0] == k], float) for k in (1, 2)}


def test_scan_crosses_batches(spark, two):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = series(recursive.evaluated(two, "k", "st(0,ld(0)*0.5+v)"), "x")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for k, x in series(two).items():
        y, want = 0.0, []
        for v in x:
            y = y * 0.5 + v
            want.append(y)
        assert got[k] == pytest.approx(want)
    assert order.scan(two.limit(0), "k", ["v"], "x", lambda: 0.0, lambda s, a: (s, a[0])).count() == 0


@pytest.mark.parametrize("kind", [*recursive.DEFAULTS])
def test_filters_against_the_difference_equation(two, kind):
    got = series(recursive.equalize(two, "k", kind, RATE, gain=6.0))
    sections = [recursive.coefficients("lowshelf", 3000.0, RATE, 0.5, "q", -3.0), recursive.coefficients("highshelf", 3000.0, RATE, 0.5, "q", 3.0)] if kind == "tiltshelf" else [recursive.coefficients(kind, *[recursive.DEFAULTS[kind][0], RATE, recursive.DEFAULTS[kind][1]], "q", 6.0)]
    for k, x in series(two).items():
        for b0, b1, b2, a1, a2 in sections:
            y = np.zeros(len(x) + 2)
            p = np.concatenate([[0, 0], x])
            for n in range(2, len(p)):
                y[n] = b0 * p[n] + b1 * p[n - 1] + b2 * p[n - 2] - a1 * y[n - 1] - a2 * y[n - 2]
            x = y[2:]
        assert got[k] == pytest.approx(x, abs=1e-9)


def response(c, f):
    z = np.exp(-2j * np.pi * f / RATE)
    return abs((c[0] + c[1] * z + c[2] * z * z) / (1 + c[3] * z + c[4] * z * z))


def test_responses_at_known_frequencies():
    assert response(recursive.coefficients("lowpass", 1000, RATE), 1000) == pytest.approx(0.707, abs=1e-3) and response(recursive.coefficients("lowpass", 1000, RATE), 0) == pytest.approx(1)
    assert response(recursive.coefficients("highpass", 1000, RATE), 0) == pytest.approx(0, abs=1e-12) and response(recursive.coefficients("bandreject", 1000, RATE), 1000) == pytest.approx(0, abs=1e-9)
    assert response(recursive.coefficients("equalizer", 1000, RATE, 1.0, "q", 6.0), 1000) == pytest.approx(10 ** (6 / 20)) and response(recursive.coefficients("lowshelf", 500, RATE, 0.7, "q", 6.0), 0) == pytest.approx(10 ** (6 / 20))
    assert all(response(recursive.coefficients("allpass", 1000, RATE), f) == pytest.approx(1) for f in (10, 500, 1000, 3000))
    # the loudness weighting is 0 dB at 997 Hz, give or take the measure's -0.691
    a, b = recursive.k_weighting(48_000)
    at = lambda c, f: abs((c[0] + c[1] * np.exp(-2j * np.pi * f / 48_000) + c[2] * np.exp(-4j * np.pi * f / 48_000)) / (1 + c[3] * np.exp(-2j * np.pi * f / 48_000) + c[4] * np.exp(-4j * np.pi * f / 48_000)))
    assert 20 * math.log10(at(a, 997) * at(b, 997)) == pytest.approx(0.691, abs=0.02)


def test_envelopes(two):
    assert recursive.gain_curve(-10, -20, 2, 0) == -5 and recursive.gain_curve(-30, -20, 2, 0) == 0 and recursive.gain_curve(-30, -20, 2, 0, True) == 5
    x, up, down = series(two)[1], recursive._coeff(20, RATE), recursive._coeff(250, RATE)
    state, want = 0.0, []
    for v in x:
        state += (abs(v) - state) * (up if abs(v) > state else down)
        want.append(v * 10 ** (recursive.gain_curve(recursive._db(state), recursive._db(0.125), 2.0, recursive._db(2.82843)) / 20))
    assert series(recursive.acompressor(two, "k", RATE))[1] == pytest.approx(want)
    assert np.abs(series(recursive.alimiter(two, "k", RATE, 0.5))[2]).max() <= 0.5
    settled = series(recursive.adynamicsmooth(two.withColumn("v", F.lit(1.0)), "k", RATE))[1]
    assert settled[-1] == pytest.approx(1)


def test_dejudder(spark):
    pts = [0]
    for n in range(40):
        pts.append(pts[-1] + (2, 4)[n % 2])
    s = spark.createDataFrame([(1, p, 0.0) for p in pts], "k int, pts long, v double")
    got = [r["pts"] for r in timing.dejudder(s, 4, "k").orderBy("pts").collect()]
    assert {b - a for a, b in zip(got[5:], got[6:], strict=False)} == {3}


def test_setpts_that_reads_its_own_output(two):
    got = timing.setpts(two, "if(isnan(PREV_OUTPTS),100,PREV_OUTPTS+2)", "k").filter("k = 1").orderBy("pts").select("pts").collect()
    assert [r[0] for r in got] == [100 + 2 * n for n in range(600)]


def test_short_and_long_filters_agree(two):
    taps = [math.cos(k) / 100 for k in range(64)]
    short, long = series(audio.fir(two, "k", taps)), series(audio.fir(two, "k", taps + [0.0]))
    assert short[1] == pytest.approx(long[1]) and short[2] == pytest.approx(np.convolve(series(two)[2], taps)[:600])


def test_pixels_against_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (5, 7))
    df = spark.createDataFrame([(1, 7, 5, a.reshape(-1).tolist()), (2, 0, 0, []), (3, 7, 5, None)], "k int, w int, h int, p0 array<int>")

    def run(name, **options):
        rows = {r["k"]: r for r in pixels.apply(df, name, **options).collect()}
        assert set(rows) == {1, 2, 3}
        return np.array(rows[1]["p0"]).reshape(rows[1]["h"], rows[1]["w"])

    pad = np.pad(a, 2, mode="edge")
    around = np.stack([pad[1 + dy : 6 + dy, 1 + dx : 8 + dx] for dy in (0, 1, 2) for dx in (0, 1, 2)])
    assert (run("hflip") == a[:, ::-1]).all() and (run("transpose", dir="clock") == np.rot90(a, -1)).all() and (run("transpose", dir="cclock") == np.rot90(a)).all()
    assert (run("median") == np.median(around, axis=0)).all() and (run("dilation") == around.max(axis=0)).all()
    assert (run("avgblur") == around.sum(axis=0) // 9).all() and (run("crop", out_w=3, out_h=3) == a[1:4, 2:5]).all()
    wide = np.stack([pad[dy : 5 + dy, dx : 7 + dx] for dy in range(5) for dx in range(5)])
    assert (run("unsharp") == np.clip(np.floor(a + (a - (2 * wide.sum(axis=0) + 25) // 50) + 0.5), 0, 255)).all()
    assert (run("swaprect", w=2, h=2, x1=0, y1=0, x2=4, y2=3)[:2, :2] == a[3:5, 4:6]).all()
    assert (run("rotate", angle=math.pi) == a[::-1, ::-1]).all() and (run("gblur", sigma=0.0) == a).all()
    assert (run("lut", c0="255-val") == 255 - a).all() and (run("perspective", x0=0, y0=0, x1=7, y1=0, x2=0, y2=5, x3=7, y3=5) == a).all()
    flat = pixels.apply(df.filter("k = 1").withColumn("p0", F.array_repeat(F.lit(9), 35)), "guided").first()["p0"]
    assert set(flat) == {9}
    assert [r["cell"] for r in pixels.untiled(df.filter("k = 1"), 2, 2).orderBy("cell").collect()] == [0, 1, 2, 3]


def test_streams_keep_state_over_batches(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    make = lambda a, b: spark.range(a, b).selectExpr("1L user_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id * 20) ts", "double(id) value", "id event_id")
    schema = make(0, 1).schema
    for part, (a, b) in enumerate(((0, 5), (5, 9))):
        make(a, b).coalesce(1).write.parquet(str(tmp_path / f"part{part}"))
        for f in (tmp_path / f"part{part}").glob("*.parquet"):
            shutil.copy(f, tmp_path / "in" / f"{part}.parquet")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = live.run_available(spark, live.held_slots(stream, "user_id", 600_000_000), str(tmp_path / "out"), str(tmp_path / "cp"))
    # ten-minute slots: records come every twenty minutes, each is held for two slots; the last one waits
    got = [r["v"] for r in out.orderBy("slot").collect()]
    assert got == [float(k // 2) for k in range(16)]
