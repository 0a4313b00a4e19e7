"""Queries against their SQL on values that sf0.01 lacks."""

import math

from tickloom.plans import catalogue


def differing(spark, tmp_path, name, key):
    """Rows of the query that its SQL in DuckDB lacks, and the other way about; a NaN is like another."""
    import duckdb

    for table in tmp_path.glob("*.parquet"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table.stem} AS SELECT * FROM '{table}/*.parquet'")
    frame = catalogue.QUERIES[name](spark, str(tmp_path))
    flat = lambda rows: sorted([tuple("nan" if isinstance(x, float) and math.isnan(x) else float(f"{x:.12g}") if isinstance(x, float) else x for x in r) for r in rows], key=lambda r: r[:key])
    got, want = flat(map(tuple, frame.collect())), flat(duckdb.sql(f"SELECT {', '.join(frame.columns)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall())
    return len(want), [(a, b) for a, b in zip(got, want, strict=True) if a != b]


def events(spark, tmp_path, values, types=("click",)):
    """Events of one user, a second apart, for each list of values."""
    rows = [(k * 1000 + n, k, types[n % len(types)], n, v) for k, vs in enumerate(values) for n, v in enumerate(vs)]
    d = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, n int, value double")
    d.selectExpr("event_id", "user_id", "event_type", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, n) AS ts", "value").write.parquet(str(tmp_path / "events.parquet"))


ZEROS = [[0.0, 3.0, 0.0, 4.5, 2.0, 8.0, 1.0, 5.0, 7.0], [2.0, 4.0, 0.0, 1.0], [0.0, 0.0], [3.0]]


def test_deflicker_hm_of_zeros(spark, tmp_path):
    events(spark, tmp_path, [*ZEROS, [1.0, -1.0, 2.0], [5.0, None, 4.0], [1.0, -0.0, 2.0]])
    assert differing(spark, tmp_path, "deflicker_hm", 1) == (25, [])


def test_interval_join_is_dealt_to_many_tasks(spark, tmp_path):
    # both tables are one small file each; the pairs are many more, and must not all be made by one task
    events(spark, tmp_path, [[float(n) for n in range(40)]] * 3)
    spark.sql("select id o_orderkey, timestamp_ntz'2023-12-19 00:00:00' + make_dt_interval(0, 0, 0, id * 7) o_orderdate from range(0, 500, 1, 1)").write.parquet(f"{tmp_path}/orders.parquet")
    assert catalogue.QUERIES["interval_join"](spark, str(tmp_path)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows, wrong = differing(spark, tmp_path, "interval_join", 3)
    assert rows > 100 and wrong == []


def test_axcorrelate_of_silence_and_of_single_pairs(spark, tmp_path):
    # a stream that begins with a click or a view of 0, one that is silent, and pairs whose quotient is a digit over 1
    found = [[0.0, 3.0, 4.0, 5.0], [3.0, 0.0, 4.0, 5.0], [0.0] * 6, [0.1 * n for n in range(40)], [None, 1.0, 2.0, None, 0.0, 3.0]]
    events(spark, tmp_path, [*found, *[[v, v * 1.1] for v in (0.07, 1.13, 7.91, 13.57, 99.99, 3.21)]], ("click", "view"))
    rows, wrong = differing(spark, tmp_path, "axcorrelate", 2)
    assert rows == 36 and wrong == []
    c = [r["c"] for r in catalogue.QUERIES["axcorrelate"](spark, str(tmp_path)).collect()]
    assert any(math.isnan(x) for x in c if x is not None) and None in c
    assert graph_values(spark, [(0.0, 0.0), (2.0, 3.0)]) == [0.0, 1.0]  # the filter itself takes silence as 0


def graph_values(spark, pairs):
    from tickloom.operators import audio

    d = spark.createDataFrame([(1, n, a, b) for n, (a, b) in enumerate(pairs)], "user_id long, n long, a double, b double")
    return [r["c"] for r in audio.axcorrelate(d, "user_id", 5).orderBy("n").collect()]


SIGNED = [[-1.5, 0.0, 2.0, -0.0, 7.0, -3.0, 1.0], [5.0, None, 4.0, 0.0], [2.0, math.nan, 1.0, 0.0]]


def deflickered(spark, tmp_path, mode, more=SIGNED):
    events(spark, tmp_path, [*ZEROS, *more])
    return differing(spark, tmp_path, f"deflicker_{mode}", 1)


def test_deflicker_am_of_zeros(spark, tmp_path):
    assert deflickered(spark, tmp_path, "am") == (31, [])


def test_deflicker_cm_of_zeros(spark, tmp_path):
    assert deflickered(spark, tmp_path, "cm") == (31, [])


def test_deflicker_gm_of_zeros(spark, tmp_path):
    assert deflickered(spark, tmp_path, "gm", SIGNED[1:]) == (24, [])


def test_deflicker_median_of_zeros(spark, tmp_path):
    assert deflickered(spark, tmp_path, "median", [*SIGNED, [1.0, None, None, None, 2.0, 3.0]]) == (37, [])


def test_deflicker_qm_of_zeros(spark, tmp_path):
    assert deflickered(spark, tmp_path, "qm") == (31, [])
