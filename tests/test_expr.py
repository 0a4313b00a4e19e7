import math

import pytest
from pyspark.sql import functions as F

from tickloom.functions import expr

CASES = {
    "2^3^2": 64.0, "-2^2": -4.0, "0-20dB": 0.1, "1+2*3": 7.0, "(1+2)*3": 9.0, "1;2;3": 3.0, "1k": 1000.0, "2Ki": 2048.0, "1B": 8.0, "0x10": 16.0, "1/0": math.inf, "0-1/0": -math.inf,
    "if(0/0,1,2)": 1.0, "gt(0/0,1)": 0.0, "eq(0/0,0/0)": 0.0, "mod(5,0-3)": -1.0, "clip(5,1,3)": 3.0, "round(0-2.5)": -3.0, "trunc(0-1.7)": -1.0, "gcd(12,18)": 6.0, "max(0/0,1)": 1.0,
    "bitand(12,10)": 8.0, "ifnot(0,4)": 4.0, "lerp(1,3,0.5)": 2.0, "log(0)": -math.inf, "between(2,1,2)": 1.0, "not(0)": 1.0, "2^-1": 0.5, "hypot(3,4)": 5.0, "sgn(0-3)": -1.0,
}


def test_columns_and_python_agree_with_known_values(spark):
    row = spark.range(1).select(*[expr.to_column(t).alias(f"c{k}") for k, t in enumerate(CASES)]).first()
    for k, (text, want) in enumerate(CASES.items()):
        assert row[k] == pytest.approx(want), text
        assert expr.evaluate(expr.parse(text), {}, [0.0] * 10) == pytest.approx(want), text


@pytest.mark.parametrize("text", ["", "1+", "(1", "foo", "sin()", "sin(1,2)", "1 2x", "max(1)", "1)"])
def test_rejects(text):
    with pytest.raises(expr.ExprError):
        expr.parse(text)


def test_registers_carry_over():
    tree, registers = expr.parse("st(0,ld(0)+v)", {"v"}), [0.0] * 10
    assert [expr.evaluate(tree, {"v": x}, registers) for x in (1.0, 2.0, 3.0)] == [1.0, 3.0, 6.0]
    assert expr.evaluate(expr.parse("root(ld(0)*ld(0)-4,3)"), {}, [0.0] * 10) == pytest.approx(2, abs=1e-6)
    with pytest.raises(expr.ExprError):
        expr.to_column("ld(0)")


EDGES = {
    "ceil(0/0)": math.nan, "floor(1/0)": math.inf, "floor(v)": 1e300, "trunc(0-1/0)": -math.inf, "round(v)": 1e300, "mod(5,0)": math.nan, "mod(2,1/0)": math.nan, "sgn(0/0)": 0.0,
    "gcd(0/0,6)": 6.0, "gcd(1/0,6)": 1.0, "gcd(0-7,0)": -7.0, "gcd(0-12,0-18)": 6.0, "bitand(1/0,255)": 255.0, "bitor(0/0,1)": math.nan, "bitand(v,1)": 1.0, "max(1,0/0)": math.nan, "clip(5,0/0,1)": math.nan,
    "max(0/0,1)": 1.0, "not(0/0)": 0.0, "ifnot(0/0,7)": 0.0, "squish(v)": 0.0, "print(3,1)": 3.0,
}


def test_edges(spark):
    row = spark.range(1).select(*[expr.to_column(t, {"v": F.lit(1e300)}).alias(f"c{k}") for k, t in enumerate(EDGES)]).first()
    for k, (text, want) in enumerate(EDGES.items()):
        assert row[k] == pytest.approx(want, nan_ok=True), text
        assert expr.evaluate(expr.parse(text, {"v"}), {"v": 1e300}, [0.0] * 10) == pytest.approx(want, nan_ok=True), text


def test_expressions_that_evaluate_parts_again():
    run = lambda text, registers=None, **more: expr.evaluate(expr.parse(text), {}, registers if registers is not None else [0.0] * 10, **more)
    assert run("root(ld(0)-2,1)") == 2 and run("root(1,10)") == 10 and run("root(ld(0),10)") == 0
    assert run("taylor(1,1)") == pytest.approx(math.e) and run("taylor(mod(ld(0),2)*(2-mod(ld(0),4)),0.5)") == pytest.approx(math.sin(0.5))
    assert run("st(100,5);ld(100)") == 5 and run("ld(0-1)") == 0 and run("st(3.7,5);ld(3)") == 5
    assert run("st(1,0);while(lt(ld(1),5),st(1,ld(1)+1))") == 5 and run("time(0)", now=lambda: 12.5) == 12.5
    registers = [0.0] * 10
    first = run("random(0)", registers)
    assert first == 1_013_904_223 / (2**64 - 1) and registers[0] == 1_013_904_223 and 2 <= run("randomi(0,2,5)", registers) <= 5


def test_null_is_nan(spark):
    df = spark.createDataFrame([(None,), (2.0,)], "v double").select(expr.condition("v", {"v": F.col("v")}).alias("c"), expr.to_column("gt(v,1)", {"v": F.col("v")}).alias("g"))
    assert [tuple(r) for r in df.collect()] == [(True, 0.0), (True, 1.0)]
