import pytest
from pyspark.sql import functions as F

from tickloom.operators import align, elementwise, stats, timing, windows
from tickloom.plans import graph
from tickloom.sources import packets
from tickloom.streaming.windows import run_available, sliding_counts

SCHEMA = "k int, pts long, v double"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def values(df, *cols):
    return [tuple(r) for r in df.orderBy("k", "pts").select(*cols).collect()]


def test_worked_asof_example(spark):
    # ten records over four, on a grid of 20 ticks a second
    main = make(spark, [(1, 2 * n, float(n)) for n in range(10)])
    other = make(spark, [(1, 5 * n, float(n + 1)) for n in range(4)])
    assert [r[0] for r in values(align.asof(main, other, "k"), "other_v")] == [1, 1, 1, 2, 2, 3, 3, 3, 4, 4]
    assert [r[0] for r in values(align.asof(main, other, "k", mode="nearest"), "other_v")] == [1, 1, 2, 2, 3, 3, 3, 4, 4, 4]
    assert len(values(align.asof(main, other, "k", eof="endall"), "pts")) == 8
    assert [r[0] for r in values(align.asof(main, other, "k", eof="pass"), "other_v")][-2:] == [None, None]


def test_nearest_ties_keep_the_earlier(spark):
    main, other = make(spark, [(1, 5, 0.0)]), make(spark, [(1, 0, 1.0), (1, 10, 2.0)])
    assert values(align.asof(main, other, "k", mode="nearest"), "other_v") == [(1.0,)]


def test_loop(spark):
    s = make(spark, [(1, n, float(n)) for n in range(5)])
    assert timing.loop(s, 2, 5, "k").count() == 15
    assert [r["position"] for r in timing.loop(s, 3, 1, "k").orderBy("position").collect()] == list(range(8))


def test_fps_holds_and_drops(spark):
    s = make(spark, [(1, 0, 1.0), (1, 30, 2.0), (1, 31, 3.0)])
    assert [(r["slot"], r["v"]) for r in timing.fps(s, 10, "k").orderBy("slot").collect()] == [(0, 1.0), (1, 1.0), (2, 1.0), (3, 3.0)]


def test_lagfun(spark):
    s = make(spark, [(1, n, v) for n, v in enumerate([200.0, 50.0, 50.0, 200.0, 0.0])])
    for bucket in (None, 2):
        assert [r[0] for r in values(windows.lagfun(s, 0.5, "k", bucket), "v")] == [200, 100, 50, 200, 100]


def test_lagfun_keeps_old_peaks(spark):
    x = [-5.0, -1.0, 1e6] + [0.0] * 200
    want = [x[0]]
    for v in x[1:]:
        want.append(max(v, want[-1] * 0.95))
    got = values(windows.lagfun(make(spark, [(1, n, v) for n, v in enumerate(x)]), 0.95, "k"), "v")
    assert [r[0] for r in got] == pytest.approx(want)


def test_runs_and_freeze(spark):
    s = make(spark, [(1, 10 * n, v) for n, v in enumerate([1.0, 5.0, 5.0, 5.0, 9.0, 9.0])])
    assert [tuple(r) for r in windows.runs(s, F.col("v") == 5, "k").collect()] == [(1, 10, 30, 3, 40)]
    assert sorted(map(tuple, windows.freezedetect(s, 0.0, 10, "k").collect())) == [(1, 10, 40), (1, 40, None)]


def test_decimate_drops_duplicates_only(spark):
    s = make(spark, [(1, n, v) for n, v in enumerate([0.0, 9.0, 9.0, 1.0, 7.0, 3.0, 3.0])])
    assert [r[0] for r in values(windows.decimate(s, 5, "k"), "pts")] == [0, 1, 3, 4, 5]  # an incomplete group counts as well
    assert len(values(windows.decimate(s, 5, "k", scthresh=2.0), "pts")) == 6  # a cut in the first group
    slow = make(spark, [(1, n, 50.0 * n) for n in range(10)])
    assert len(values(windows.decimate(slow, 5, "k"), "pts")) == 10


def test_rescale_rounds_halves_away_from_zero(spark):
    df = spark.createDataFrame([(5,), (-5,), (4,), (None,)], "x long").select(timing.rescale(F.col("x"), (1, 10), (1, 1)))
    assert [r[0] for r in df.collect()] == [1, -1, 0, None]


def test_statistics_of_constant_and_equal_streams(spark):
    s = make(spark, [(1, 0, 0.0), (1, 1, 0.0)])
    assert stats.astats(s, "k").first()["peak_db"] == float("-inf")
    assert stats.error_measures(spark.createDataFrame([(1, 2.0, 2.0)], "k int, a double, b double"), "k", 1.0).first()["psnr"] == float("inf")


def test_empty_streams(spark):
    e = make(spark, [])
    for df in (timing.fps(e, 10, "k"), windows.freezedetect(e, 0.0, 1, "k"), align.asof(e, e, "k"), timing.loop(e, 1, 2, "k"), stats.astats(e, "k"), windows.tmedian(e, 1, "k")):
        assert df.count() == 0


@pytest.mark.parametrize("mode,want", [("average", 150), ("multiply", 78), ("screen", 222), ("difference", 100), ("negation", 210), ("dodge", 255), ("burn", 115), ("subtract", 0), ("overlay", 156), ("hardlight", 189), ("addition128", 172), ("difference128", 28), ("divide", 127)])
def test_blend(spark, mode, want):
    assert spark.range(1).select(elementwise.blend(mode, F.lit(100), F.lit(200))).first()[0] == want


def test_dodge_of_white(spark):
    assert spark.range(1).select(elementwise.blend("dodge", F.lit(255), F.lit(0))).first()[0] == 255


def test_derivative_starts_from_zero(spark):
    s = make(spark, [(1, n, v) for n, v in enumerate([5.0, 7.0, 4.0])])
    for bucket in (None, 1, 2):
        assert [r[0] for r in values(windows.derivative(s, "k", bucket), "v")] == [5, 2, -3]


def test_silence(spark):
    s = make(spark, [(1, 10 * n, v) for n, v in enumerate([0.0, 0.1, -0.1, 1.0, 0.0, -1.0, 0.0, 0.0, 0.0])])
    assert sorted(map(tuple, windows.silencedetect(s, 0.1, 20, "k").collect())) == [(1, 0, 30, 30), (1, 60, None, None)]


def test_tmedian_forms(spark):
    s = make(spark, [(1, n, v) for n, v in enumerate([5.0, 1.0, 3.0, 9.0])])
    assert [r[0] for r in values(windows.tmedian(s, 1, "k"), "v")] == [5, 5, 3, 3]
    assert [r[0] for r in values(windows.tmedian(s, 1, "k", compat=False), "v")] == [5, 3, 3, 9]


def test_entropy_is_normalised(spark):
    flat = make(spark, [(1, n, float(n)) for n in range(256)])
    assert tuple(stats.entropy(flat, 0, 256, 256, "k").first())[1:] == (8.0, 1.0)
    skew = make(spark, [(1, n, v) for n, v in enumerate([0.0] * 90 + [1.0] * 9 + [99.0])])
    assert stats.entropy(skew, 0, 256, 256, "k").first()["normalized_entropy"] == pytest.approx(0.064487, abs=1e-6)
    assert stats.entropy(skew, 0, 256, 256, "k", "diff").first()["entropy"] == pytest.approx(0.691776, abs=1e-6)


def test_equal_time_stamps_keep_their_order(spark):
    rows = [(1, 0, float(n), n) for n in range(50)]
    s = spark.createDataFrame(rows[::-1], SCHEMA + ", arrival long").repartition(7)
    for bucket in (None, 5):
        assert [r["v"] for r in timing.framestep(s, 10, "k", bucket).orderBy("v").collect()] == [0, 10, 20, 30, 40]
        assert [r["v"] for r in windows.derivative(s, "k", bucket).collect()].count(1.0) == 49


def test_worked_framesync_examples(spark):
    ticks = lambda rate, n: make(spark, [(1, k * 1000 // rate, float(k)) for k in range(n)])
    main, other = ticks(10, 4), ticks(25, 10)  # 0.4 seconds of either
    for bucket in (None, 150):
        assert align.framesync([main, other], "k", bucket=bucket).count() == 6
        assert align.framesync([main, other], "k", uniform=True, bucket=bucket).count() == 12
    assert align.framesync([main, other], "k", shortest=True).count() == 4
    got = align.framesync([other, main], "k", eof="pass").orderBy("pts").collect()
    assert len(got) == 10 and [r["v1"] for r in got][-2:] == [None, None]
    assert align.common_base((1, 10), (1, 25)) == (1, 50)


def test_asof_of_a_long_stream_is_linear(spark):
    main = spark.range(20_000).selectExpr("1 k", "id * 7 pts", "double(id) v")
    other = spark.range(20_000).selectExpr("1 k", "id * 5 pts", "double(id) v")
    got = align.asof(main, other, "k", mode="nearest", bucket=10_000).agg(F.sum(F.abs(F.col("other_pts") - F.col("pts"))), F.count("*")).first()
    want = [min(p % 5, 5 - p % 5) if p < 99_995 else p - 99_995 for p in range(0, 140_000, 7)]
    assert tuple(got) == (sum(want), 20_000)


def test_graph_of_several_inputs(spark):
    a, b = make(spark, [(1, n, 100.0 + n) for n in range(4)]), make(spark, [(1, n, 10.0 * n) for n in range(4)])
    out = graph.build("[a][b]blend=all_mode=average,volume=2:enable='gte(n,2)'[x];[a][b]psnr[y]", {"a": a, "b": b}, "k")
    assert [r[0] for r in values(out["x"], "v")] == [50, 55, 122, 132] and out["y"].count() == 1
    with pytest.raises(graph.GraphError):
        graph.build("[a][b]volume=2", {"a": a, "b": b}, "k")


def test_graph_text(spark):
    s = make(spark, [(1, n, 10.0 * n) for n in range(10)])
    out = graph.build("select='gt(v,20)',setpts=PTS-STARTPTS,framestep=2", {"in": s}, "k")["out"]
    assert values(out, "pts", "v") == [(0, 30.0), (2, 50.0), (4, 70.0), (6, 90.0)]
    both = graph.build("[in]split[a][b];[a]trim=end_pts=2[x];[b]volume=2,lut=val+1[y]", {"in": s}, "k")
    assert both["x"].count() == 2 and both["y"].agg(F.sum("v")).first()[0] == 910
    for bad in ("nosuch", "[zz]null", "select='gt(v,1)", "=3"):
        with pytest.raises(graph.GraphError):
            graph.build(bad, {"in": s}, "k")


def test_packets(spark):
    p = spark.createDataFrame([(1, "ab"), (2, None)], "k int, payload string")
    assert packets.frame_hash(p, "crc32").orderBy("k").first()["hash"] == "9e83486d"
    assert [r["hash"] for r in packets.frame_hash(p, "adler32").orderBy("k").collect()] == ["012400c3", None]
    assert packets.show_entries(p, "payload").columns == ["payload"]


def test_streaming_equals_batch(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int) * 7) as ts, if(id % 2 = 0, 'a', 'b') as event_type, cast(id as double) as value from range(40)")
    rows.write.parquet(str(tmp_path / "in"))
    batch = sliding_counts(spark.read.parquet(str(tmp_path / "in")), "1 hour", "30 minutes", "1 hour").count()
    live = sliding_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "1 hour", "30 minutes", "1 hour")
    got = run_available(spark, live, str(tmp_path / "out"), str(tmp_path / "cp")).count()
    assert 0 < got <= batch  # windows that the watermark hasn't passed stay open


def test_interval_join_takes_all_orders(spark, tmp_path):
    from tickloom.plans import catalogue

    hour = 3600
    spark.sql("select 1L event_id, 1L user_id, 'view' event_type, timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 1800) ts, double(id) value from range(60)").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("select id o_orderkey, timestamp_ntz'1995-03-01 00:00:00' + make_dt_interval(0, id) o_orderdate from range(480, 510)").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalogue.QUERIES["interval_join"](spark, str(tmp_path)).select("cue", "v").collect()
    starts = {k: (794_016_000 + hour * k) % 2_592_000 for k in range(480, 510)}
    want = [(k, float(n)) for k, b in starts.items() for n in range(60) if b <= 1800 * n < b + 6 * hour]
    assert len({k for k, _ in want}) == 30 and sorted(tuple(r) for r in got) == sorted(want)


def test_registered_queries_have_sql():
    from tickloom.plans import catalogue

    # recursions, random numbers, checksums that DuckDB lacks, and pixels between pixels
    without = set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)
    assert len(without) < 0.2 * len(catalogue.QUERIES) and not {x for x in without if x.startswith(("asof", "fps", "blend", "container", "subtitles"))}


def test_entry_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, check=True)
    assert all(int(x) > 300 for x in found.stdout.split()[-2:])
