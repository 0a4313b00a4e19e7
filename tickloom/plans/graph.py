"""The text language of operator graphs: ``name=arg:key=value,name;[label]name[label]``.

A chain is a list of operators joined by commas, chains are joined by semicolons, and labels in brackets name what a
chain takes and gives. Quotes and backslashes protect separators. A graph is folded into one DataFrame plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import to_column
from ..operators import align, audio, elementwise, metadata, recursive, stats, timing, windows
from ..operators.order import previous


class GraphError(ValueError):
    """A graph that can't be read or built."""


@dataclass
class Node:
    name: str
    args: list[str] = field(default_factory=list)
    options: dict[str, str] = field(default_factory=dict)
    inputs: list[str] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)


def _cut(text: str, separators: str) -> list[tuple[str, str]]:
    """(part, separator after it): quotes, brackets and backslashes protect separators."""
    parts, now, quoted, k = [], "", False, 0
    while k < len(text):
        c = text[k]
        if c == "\\" and not quoted and k + 1 < len(text):
            now += text[k : k + 2]
            k += 2
            continue
        if c == "'":
            quoted = not quoted
        if c in separators and not quoted:
            parts.append((now, c))
            now = ""
        else:
            now += c
        k += 1
    if quoted:
        raise GraphError("a quote isn't closed")
    return [*parts, (now, "")]


def _plain(text: str) -> str:
    out, k, quoted = "", 0, False
    while k < len(text):
        if text[k] == "\\" and not quoted and k + 1 < len(text):
            k += 1
            out += text[k]
        elif text[k] == "'":
            quoted = not quoted
        else:
            out += text[k]
        k += 1
    return out


def _node(text: str) -> Node:
    text = text.strip()
    ins, outs = [], []
    while text.startswith("["):
        label, _, text = text[1:].partition("]")
        ins.append(label)
        text = text.strip()
    while text.endswith("]"):
        text, _, label = text[:-1].rpartition("[")
        outs.insert(0, label)
        text = text.strip()
    name, _, rest = text.partition("=")
    if not name.strip():
        raise GraphError("an operator without a name")
    node = Node(name.strip(), inputs=ins, outputs=outs)
    for part, _ in _cut(rest, ":") if rest else []:
        key, eq, value = part.partition("=")
        if eq and key.strip().isidentifier() and "(" not in key:
            node.options[key.strip()] = _plain(value)
        else:
            node.args.append(_plain(part))
    return node


def parse(text: str) -> list[list[Node]]:
    """Chains of nodes."""
    chains: list[list[Node]] = [[]]
    for part, separator in _cut(text, ",;"):
        chains[-1].append(_node(part))
        if separator == ";":
            chains.append([])
    return chains


def option(node: Node, name: str, place: int, default=None, kind: Callable = float):
    """An option by its name, or by its place among the unnamed ones."""
    text = node.options.get(name, node.args[place] if place is not None and place < len(node.args) else None)
    if text is None:
        if default is None:
            raise GraphError(f"{node.name} needs {name}")
        return default
    try:
        return kind(text)
    except ValueError:
        raise GraphError(f"{node.name}: {name} can't be {text!r}") from None


def _numbers(text: str) -> list[float]:
    return [float(x) for x in text.replace("|", " ").split()]


def _on_v(f: Callable[[Column, Node], Column]) -> Callable[[DataFrame, Node, str], DataFrame]:
    return lambda s, n, by: s.withColumn("v", f(F.col("v"), n))


def _equalizer(s: DataFrame, n: Node, by: str) -> DataFrame:
    rate = option(n, "rate", None, 48_000.0)
    more = {k: option(n, a, None, d) for k, a, d in (("frequency", "f", 0.0), ("width", "w", 0.0), ("gain", "g", 0.0), ("mix", "m", 1.0))}
    return recursive.equalize(s, by, n.name, rate, more["frequency"] or None, more["width"] or None, n.options.get("t", "q"), more["gain"], int(option(n, "p", None, 2.0)), mix=more["mix"])


def _compressor(f: Callable) -> Callable[[DataFrame, Node, str], DataFrame]:
    names = ("threshold", "ratio", "knee", "attack", "release", "makeup", "level_in")
    return lambda s, n, by: f(s, by, option(n, "rate", None, 48_000.0), **{k: float(n.options[k]) for k in names if k in n.options})


#: Operators of one input: name to a function of the stream, the node and the column that names streams.
OPERATORS: dict[str, Callable[[DataFrame, Node, str], DataFrame]] = {
    "null": lambda s, n, by: s,
    "select": lambda s, n, by: timing.select(s, option(n, "expr", 0, "1", str), by),
    "setpts": lambda s, n, by: timing.setpts(s, option(n, "expr", 0, "PTS", str), by),
    "settb": lambda s, n, by: s.withColumn("pts", timing.rescale(F.col("pts"), (1, 1_000_000), tuple(int(x) for x in option(n, "expr", 0, None, str).split("/")))),
    "framestep": lambda s, n, by: timing.framestep(s, option(n, "step", 0, 1, int), by),
    "fps": lambda s, n, by: timing.fps(s, round(1_000_000 / option(n, "fps", 0, 25.0)), by).select(by, (F.col("slot") * round(1_000_000 / option(n, "fps", 0, 25.0))).alias("pts"), "v"),
    "framerate": lambda s, n, by: align.framerate(s, round(1_000_000 / option(n, "fps", 0, 50.0)), by).select(by, (F.col("slot") * round(1_000_000 / option(n, "fps", 0, 50.0))).alias("pts"), "v"),
    "trim": lambda s, n, by: timing.trim(s, *[int(n.options[k]) if k in n.options else None for k in ("start_pts", "end_pts")]),
    "reverse": lambda s, n, by: timing.reverse(s, by),
    "loop": lambda s, n, by: timing.loop(s, option(n, "loop", 0, 0, int), option(n, "size", 1, 0, int), by).withColumnRenamed("position", "pts"),
    "tpad": lambda s, n, by: timing.tpad(s, by, option(n, "tick", None, 1, int), option(n, "start", None, 0, int), option(n, "stop", None, 0, int), n.options.get("start_mode", "add"), n.options.get("stop_mode", "add")),
    "shuffleframes": lambda s, n, by: timing.shuffleframes(s, [int(x) for x in _numbers(option(n, "mapping", 0, "0", str))], by),
    "dejudder": lambda s, n, by: timing.dejudder(s, option(n, "cycle", 0, 4, int), by),
    "tmix": lambda s, n, by: windows.tmix(s, option(n, "frames", 0, 3, int), by, _numbers(n.options["weights"]) if "weights" in n.options else None, option(n, "scale", None, 0.0)),
    "tmedian": lambda s, n, by: windows.tmedian(s, option(n, "radius", 0, 1, int), by, option(n, "percentile", None, 0.5)),
    "tmidequalizer": lambda s, n, by: windows.tmidequalizer(s, option(n, "radius", 0, 5, int), by, option(n, "sigma", 1, 0.5)),
    "lagfun": lambda s, n, by: windows.lagfun(s, option(n, "decay", 0, 0.95), by),
    "amplify": lambda s, n, by: windows.amplify(s, option(n, "radius", 0, 2, int), by, option(n, "factor", 1, 2.0), option(n, "threshold", 2, 10.0), option(n, "tolerance", 3, 0.0)),
    "deflicker": lambda s, n, by: windows.deflicker(s, option(n, "size", 0, 5, int), by, n.options.get("mode", "am")).withColumn("v", F.col("v") * F.col("factor")).drop("factor"),
    "decimate": lambda s, n, by: windows.decimate(s, option(n, "cycle", 0, 5, int), by, option(n, "dupthresh", 1, 1.1), option(n, "scthresh", 2, 15.0)),
    "mpdecimate": lambda s, n, by: windows.mpdecimate(s, option(n, "hi", None, 768.0), option(n, "lo", None, 320.0), by, option(n, "frac", None, 0.33)),
    "freezedetect": lambda s, n, by: windows.freezedetect(s, option(n, "noise", 0, 0.001), option(n, "duration", 1, 2_000_000, int), by),
    "silencedetect": lambda s, n, by: windows.silencedetect(s, option(n, "noise", 0, 0.001), option(n, "duration", 1, 2_000_000, int), by),
    "vfrdet": lambda s, n, by: windows.vfrdet(s, by),
    "scdet": lambda s, n, by: windows.scene_score(s, by, option(n, "threshold", 0, 10.0)),
    "aderivative": lambda s, n, by: windows.derivative(s, by),
    "aintegral": lambda s, n, by: windows.integral(s, by),
    "volume": _on_v(lambda v, n: v * to_column(option(n, "volume", 0, "1.0", str))),
    "lut": lambda s, n, by: s.withColumn("v", to_column(option(n, "c0", 0, "val", str), {"val": F.col("v")})),
    "acrusher": _on_v(lambda v, n: audio.acrusher(v, option(n, "bits", None, 8.0), option(n, "mix", None, 0.5), option(n, "level_in", 0, 1.0), option(n, "level_out", 1, 1.0))),
    "asoftclip": _on_v(lambda v, n: elementwise.soft_clip(option(n, "type", 0, "tanh", str), v, option(n, "threshold", 1, 1.0))),
    "dcshift": _on_v(lambda v, n: audio.dcshift(v, option(n, "shift", 0, 0.0), option(n, "limitergain", 1, 0.0))),
    "crystalizer": lambda s, n, by: audio.crystalizer(s, by, option(n, "i", 0, 2.0)),
    "adelay": lambda s, n, by: audio.adelay(s, by, option(n, "delays", 0, 0, int)),
    "aecho": lambda s, n, by: audio.aecho(s, by, [int(x) for x in _numbers(option(n, "delays", 2, "1000", str))], _numbers(option(n, "decays", 3, "0.5", str)), option(n, "in_gain", 0, 0.6), option(n, "out_gain", 1, 0.3)),
    "tremolo": lambda s, n, by: audio.tremolo(s, by, option(n, "rate", None, 48_000.0), option(n, "f", 0, 5.0), option(n, "d", 1, 0.5)),
    "volumedetect": lambda s, n, by: audio.volumedetect(s, by),
    "astats": lambda s, n, by: stats.astats(s, by),
    "loudnorm": lambda s, n, by: audio.loudnorm(s, by, option(n, "I", 0, -24.0), option(n, "TP", 1, -2.0)),
    "acompressor": _compressor(recursive.acompressor),
    "agate": _compressor(recursive.agate),
    "alimiter": lambda s, n, by: recursive.alimiter(s, by, option(n, "rate", None, 48_000.0), option(n, "limit", None, 1.0)),
    "speechnorm": lambda s, n, by: recursive.speechnorm(s, by, option(n, "peak", 0, 0.95), option(n, "expansion", 1, 2.0), option(n, "compression", 2, 2.0)),
    "hqdn3d": lambda s, n, by: recursive.hqdn3d(s, by, option(n, "luma_tmp", 0, 6.0)),
    "biquad": lambda s, n, by: recursive.biquad(s, by, **{k: option(n, k, None, d) for k, d in (("a0", 1.0), ("a1", 0.0), ("a2", 0.0), ("b0", 1.0), ("b1", 0.0), ("b2", 0.0))}),
} | {k: _equalizer for k in recursive.DEFAULTS}
#: What has an effect on a live graph only: pacing, waiting, measures of time, and permissions of buffers.
for _a in ("realtime", "arealtime", "cue", "acue", "latency", "alatency", "bench", "abench", "perms", "aperms", "anull", "copy", "acopy", "format", "noformat", "aformat"):
    OPERATORS[_a] = OPERATORS["null"]
OPERATORS |= {
    "tblend": lambda s, n, by: _tblend(s, option(n, "all_mode", 0, "normal", str), by),
    "asetrate": lambda s, n, by: timing.asetrate(s, option(n, "old", None, 48_000, int), option(n, "sample_rate", 0, 48_000, int)),
    "aresample": lambda s, n, by: align.framerate(s, round(1_000_000 / option(n, "sample_rate", 0, 48_000.0)), by).select(by, (F.col("slot") * round(1_000_000 / option(n, "sample_rate", 0, 48_000.0))).alias("pts"), "v"),
    "segment": lambda s, n, by: timing.segment(s, [int(x) for x in _numbers(option(n, "timestamps", 0, "0", str))]),
    "nullsink": lambda s, n, by: s.limit(0), "anullsink": lambda s, n, by: s.limit(0),
    "metadata": lambda s, n, by: metadata.metadata(s, option(n, "mode", 0, "select", str), n.options.get("key"), n.options.get("value"), n.options.get("function", "same_str"), n.options.get("expr")),
    "sidedata": lambda s, n, by: metadata.sidedata(s, option(n, "mode", 0, "select", str), n.options.get("type")),
    "silenceremove": lambda s, n, by: audio.silenceremove(s, by, option(n, "window", None, 960, int), option(n, "start_threshold", None, 0.0)),
    "compand": lambda s, n, by: recursive.compand(s, by, option(n, "rate", None, 48_000.0), [tuple(float(y) for y in x.split("/")) for x in option(n, "points", 2, "-70/-70|-60/-20|1/0", str).split("|")]),
    "adynamicsmooth": lambda s, n, by: recursive.adynamicsmooth(s, by, option(n, "rate", None, 48_000.0), option(n, "basefreq", 1, 22_050.0), option(n, "sensitivity", 0, 2.0)),
    "vibrato": lambda s, n, by: audio.vibrato(s, by, option(n, "rate", None, 48_000.0), option(n, "f", 0, 5.0), option(n, "d", 1, 0.5)),
    "apsyclip": _on_v(lambda v, n: audio.apsyclip(v, option(n, "clip", 2, 1.0), option(n, "level_in", 0, 1.0), option(n, "level_out", 1, 1.0))),
    "compensationdelay": lambda s, n, by: audio.compensationdelay(s, by, option(n, "m", None, 0.0), option(n, "temp", None, 20.0), option(n, "dry", None, 0.0), option(n, "wet", None, 1.0)),
    "drmeter": lambda s, n, by: audio.drmeter(s, by, round(option(n, "length", 0, 3.0) * option(n, "rate", None, 48_000.0))),
    "ebur128": lambda s, n, by: stats.ebur128(s, by, option(n, "rate", None, 48_000, int)),
    "replaygain": lambda s, n, by: stats.replaygain(s, by, option(n, "rate", None, 48_000, int)),
    "histogram": lambda s, n, by: stats.histogram(s, 0.0, 256.0, 256),
    "entropy": lambda s, n, by: stats.entropy(s, 0.0, 256.0, 256, by, option(n, "mode", 0, "normal", str)),
}
for _a, _b in (("asegment", "segment"), ("ametadata", "metadata"), ("asidedata", "sidedata"), ("aselect", "select"), ("asetpts", "setpts"), ("asettb", "settb"), ("atrim", "trim"), ("areverse", "reverse"), ("aloop", "loop")):
    OPERATORS[_a] = OPERATORS[_b]


def _tblend(s: DataFrame, mode: str, by: str) -> DataFrame:
    """Each record with the one before; the first one goes."""
    d = previous(s, by, {"_p": F.col("v")}).filter("_p is not null")
    return d.withColumn("v", elementwise.blend(mode, F.col("v").cast("long"), F.col("_p").cast("long")).cast("double")).drop("_p")


def _blend(a: DataFrame, b: DataFrame, n: Node, by: str) -> DataFrame:
    both = align.framesync([a, b], by)
    return both.select(by, "pts", elementwise.blend(option(n, "all_mode", 0, "normal", str), F.col("v0").cast("long"), F.coalesce("v1", "v0").cast("long")).cast("double").alias("v"))


def _pairs(make: Callable[[DataFrame, str], DataFrame]) -> Callable[[list[DataFrame], Node, str], DataFrame]:
    return lambda inputs, n, by: make(align.lockstep(*inputs, by), by)


#: Operators of several inputs.
JOINS: dict[str, Callable[[list[DataFrame], Node, str], DataFrame]] = {
    "blend": lambda inputs, n, by: _blend(*inputs, n, by),
    "mix": lambda inputs, n, by: _mix(inputs, n, by),
    "xmedian": lambda inputs, n, by: align.framesync(inputs, by, uniform=True).select(by, "pts", F.get(F.array_sort(F.array(*[f"v{k}" for k in range(len(inputs))])), F.lit((len(inputs) - 1) // 2)).alias("v")),
    "amultiply": lambda inputs, n, by: align.lockstep(*inputs, by).select(by, F.col("n").alias("pts"), (F.col("a") * F.col("b")).alias("v")),
    "psnr": _pairs(lambda p, by: stats.error_measures(p, by, 255.0)),
    "identity": _pairs(lambda p, by: stats.error_measures(p, by, 255.0).select(by, "identity")),
    "msad": _pairs(lambda p, by: stats.error_measures(p, by, 255.0).select(by, "msad")),
    "asdr": _pairs(lambda p, by: stats.error_measures(p, by, 1.0).select(by, "sdr")),
    "apsnr": _pairs(lambda p, by: stats.error_measures(p, by, 1.0).select(by, "psnr")),
    "asisdr": _pairs(stats.asisdr),
    "interleave": lambda inputs, n, by: _together(inputs, by),
    "ainterleave": lambda inputs, n, by: _together(inputs, by),
    "amix": lambda inputs, n, by: _mix(inputs, n, by),
    "streamselect": lambda inputs, n, by: inputs[int(option(n, "map", 1, "0", str).split()[0])],
    "astreamselect": lambda inputs, n, by: inputs[int(option(n, "map", 1, "0", str).split()[0])],
    "axcorrelate": lambda inputs, n, by: audio.axcorrelate(align.lockstep(*inputs, by), by, option(n, "size", 0, 256, int)).select(by, F.col("n").alias("pts"), F.col("c").alias("v")),
    "concat": lambda inputs, n, by: _together(inputs, by),
}


def _mix(inputs: list[DataFrame], n: Node, by: str) -> DataFrame:
    w = _numbers(n.options["weights"]) if "weights" in n.options else [1.0] * len(inputs)
    total = sum((F.col(f"v{k}") * x for k, x in enumerate(w)), F.lit(0.0)) / (option(n, "scale", None, 0.0) or sum(w))
    return align.framesync(inputs, by, uniform=True, shortest=n.options.get("duration") == "shortest").select(by, "pts", total.alias("v"))


def _together(inputs: list[DataFrame], by: str) -> DataFrame:
    out = inputs[0].select(by, "pts", "v")
    for other in inputs[1:]:
        out = out.unionByName(other.select(by, "pts", "v"))
    return out


def _applied(node: Node, inputs: list[DataFrame], by: str) -> DataFrame:
    if node.name in JOINS:
        return JOINS[node.name](inputs, node, by)
    if node.name not in OPERATORS:
        raise GraphError(f"no operator {node.name}")
    if len(inputs) != 1:
        raise GraphError(f"{node.name} takes one input")
    on = node.options.pop("enable", None)
    if on is None:
        return OPERATORS[node.name](inputs[0], node, by)
    return timing.enabled(inputs[0], on, by, lambda s: OPERATORS[node.name](s, node, by))


def build(text: str, inputs: dict[str, DataFrame], by: str) -> dict[str, DataFrame]:
    """Folds a graph over its labelled inputs; an unlabelled chain starts from ``in``. Returns labelled outputs, an
    unlabelled one as ``out``. ``split`` gives its input to each of its outputs; operators of ``JOINS`` take all of their labels.
    ``enable=expression`` limits an operator that changes values to the records for which the expression holds."""
    known = dict(inputs)
    given: dict[str, DataFrame] = {}
    for chain in parse(text):
        now = None
        for node in chain:
            for label in node.inputs:
                if label not in known:
                    raise GraphError(f"nothing gives [{label}]")
            own = [known[label] for label in node.inputs]
            if not own:
                if now is None and "in" not in known:
                    raise GraphError("a chain without an input")
                own = [known["in"] if now is None else now]
            if node.name in ("split", "asplit"):
                for label in node.outputs:
                    known[label] = own[0]
                continue
            now = _applied(node, own, by)
            for label in node.outputs:
                known[label] = given[label] = now
        if not chain[-1].outputs:
            given["out"] = now
    return given
