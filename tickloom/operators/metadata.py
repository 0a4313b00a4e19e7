"""Frame metadata (a map ``metadata``), side data (an array ``side_data`` of structs with ``kind``), and scripts of commands."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import condition


def matches(current: Column, value: str, function: str = "same_str", expression: str | None = None) -> Column:
    """Whether a value of the map fits ``value``; false for a missing one. Numbers that can't be read fit nothing, but are NaN in an
    expression, whose variables are VALUE1 and FRAMEVAL (the map's), VALUE2 and USERVAL (the option's)."""
    a, b = F.expr("try_cast(null as double)") if current is None else current.try_cast("double"), F.lit(value).try_cast("double")
    if function == "expr":
        return current.isNotNull() & condition(expression or "0", {"VALUE1": a, "FRAMEVAL": a, "VALUE2": b, "USERVAL": b})
    test = {
        "same_str": lambda: current == value, "starts_with": lambda: F.startswith(current, F.lit(value)), "ends_with": lambda: F.endswith(current, F.lit(value)),
        "less": lambda: a < b, "equal": lambda: a == b, "greater": lambda: a > b,
    }[function]
    return F.coalesce(test(), F.lit(False))


def metadata(frames: DataFrame, mode: str = "select", key: str | None = None, value: str | None = None, function: str = "same_str", expression: str | None = None) -> DataFrame:
    """select: frames that have the key, and a fitting value if one is given. add: a key that is missing. modify: one that is there. delete: a key,
    with a value only if that fits, or everything without a key. A null map counts as empty."""
    if key is None and mode != "delete":
        raise ValueError("metadata key must be set")
    held = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    now = F.try_element_at(held, F.lit(key)) if key is not None else None
    if mode == "select":
        return frames.filter(F.map_contains_key(held, key) if value is None else matches(now, value, function, expression))
    entries = F.map_entries(held)
    pair = F.struct(F.lit(key).alias("key"), F.lit(value).alias("value")) if key is not None else None
    if mode == "add":
        new = F.when(F.map_contains_key(held, key), held).otherwise(F.map_from_entries(F.concat(entries, F.array(pair))))
    elif mode == "modify":
        new = F.transform_values(held, lambda k, v: F.when(k == key, F.lit(value)).otherwise(v))
    elif mode == "delete" and key is None:
        new = F.create_map().cast("map<string,string>")
    elif mode == "delete":
        goes = F.lit(True) if value is None else matches(now, value, function, expression)
        new = F.when(goes, F.map_filter(held, lambda k, _: k != key)).otherwise(held)
    else:
        raise ValueError("mode is select, add, modify or delete; print has a function of its own")
    return frames.withColumn("metadata", new)


def metadata_lines(n: Column, pts: Column, tick: float = 1e-6) -> Column:
    """What ``print`` writes of a frame: a padded head, and ``key=value`` lines; nothing without entries."""
    time = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", pts * tick), "0+$", ""), r"\.$", "")
    head = F.concat(F.format_string("frame:%-5dpts:%-8dpts_time:", n.cast("long"), pts.cast("long")), time, F.lit("\n"))
    lines = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"], F.lit("\n")))
    return F.when(F.size("metadata") > 0, F.concat(head, F.concat_ws("", lines))).otherwise("")


def sidedata(frames: DataFrame, mode: str = "select", kind: str | None = None) -> DataFrame:
    """select: frames that have side data of a kind; delete: it goes, or all of it without a kind."""
    held = F.col("side_data")
    if mode == "select":
        return frames.filter(F.coalesce(F.exists(held, lambda x: x["kind"] == kind), F.lit(False)))
    if mode != "delete":
        raise ValueError("mode is select or delete")
    return frames.withColumn("side_data", F.filter(held, lambda x: F.lit(False) if kind is None else x["kind"] != kind))


def commands(text: str) -> list[tuple[float, float | None, str, str, str, str]]:
    """(start, end, flag, target, command, argument) of a script: ``START[-END] [flags] target command [arg], ...; ...``. ``#`` starts
    a comment. Flags are enter (the default) and leave; a command with both appears twice."""
    plain = re.sub(r"#[^\n]*", "", text)
    out = []
    for interval in filter(str.strip, _parts(plain, ";")):
        m = re.match(r"\s*(\d+(?:\.\d+)?)(?:-(\d+(?:\.\d+)?))?\s+(.*)", interval, re.S)
        if not m:
            raise ValueError(f"no interval: {interval.strip()!r}")
        for one in _parts(m[3], ","):
            c = re.match(r"\s*(?:\[([\w+|\s]+)\])?\s*(\S+)\s+(\S+)\s*(.*?)\s*$", one, re.S)
            if not c:
                raise ValueError(f"no command: {one.strip()!r}")
            for flag in re.split(r"[+|]", c[1]) if c[1] else ["enter"]:
                if flag.strip() not in ("enter", "leave"):
                    raise ValueError(f"no flag: {flag.strip()!r}")
                out.append((float(m[1]), float(m[2]) if m[2] else None, flag.strip(), c[2], c[3], c[4].strip("'")))
    return out


def _parts(text: str, separator: str) -> list[str]:
    """Quotes protect separators."""
    out, now, quoted = [], "", False
    for c in text:
        quoted = not quoted if c == "'" else quoted
        if c == separator and not quoted:
            out.append(now)
            now = ""
        else:
            now += c
    return [*out, now]


def fired(spark: SparkSession, stream: DataFrame, by: str, script: str, tick: float = 1e-6) -> DataFrame:
    """(by, pts, flag, target, command, argument): the commands that each record fires, being the first one inside an interval, or the first one
    outside again; an interval's start belongs to it, its end doesn't. The script is a short list, broadcast as one."""
    from .order import previous

    rows = [(k, *c) for k, c in enumerate(commands(script))]
    table = F.broadcast(spark.createDataFrame(rows, "c int, start double, end double, flag string, target string, command string, argument string"))
    d = previous(stream.select(by, "pts", *(["arrival"] if "arrival" in stream.columns else [])), by, {"_p": F.col("pts")})
    t, p = F.col("pts") * tick, F.col("_p") * tick
    inside = lambda x: F.coalesce((x >= F.col("start")) & (F.col("end").isNull() | (x < F.col("end"))), F.lit(False))
    both = d.join(table, ((F.col("flag") == "enter") & inside(t) & ~inside(p)) | ((F.col("flag") == "leave") & ~inside(t) & inside(p)))
    return both.select(by, "pts", "flag", "target", "command", "argument")
