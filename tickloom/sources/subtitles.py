"""Text subtitles: files to cues (start, end, text; milliseconds), and back.

A reader takes the whole text of a file and yields (start, end, text); ``end`` is None where a format has none and the next cue's
start isn't known. Lines that can't be read are passed over. Text keeps its line breaks as line feeds.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import payload

Cue = tuple[int, int | None, str]


def _ms(h: str | int, m: str | int, s: str | int, fraction: str = "0") -> int:
    """Milliseconds; a fraction has any number of digits."""
    return (int(h) * 3600 + int(m) * 60 + int(s)) * 1000 + int((fraction + "000")[:3])


def _clock(ms: int, mark: str = ".", hours: int = 2) -> str:
    return f"{ms // 3_600_000:0{hours}d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}{mark}{ms % 1000:03d}"


def _lines(text: str) -> list[str]:
    return text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")


def _until_next(cues: Iterable[Cue]) -> Iterator[Cue]:
    """Cues without an end last until the next one's start."""
    held: Cue | None = None
    for cue in cues:
        if held is not None:
            yield held if held[1] is not None else (held[0], cue[0], held[2])
        held = cue
    if held is not None:
        yield held


ARROW = re.compile(r"\s*(?:(\d+):)?(\d+):(\d+)[.,](\d+)\s*-->\s*(?:(\d+):)?(\d+):(\d+)[.,](\d+)")


def read_srt(text: str) -> Iterator[Cue]:
    """Also of WebVTT: lines after a time line, up to an empty one."""
    lines, at = _lines(text), 0
    while at < len(lines):
        m = ARROW.match(lines[at])
        at += 1
        if not m:
            continue
        body = []
        while at < len(lines) and lines[at].strip():
            body.append(lines[at])
            at += 1
        g = m.groups()
        yield _ms(g[0] or 0, g[1], g[2], g[3]), _ms(g[4] or 0, g[5], g[6], g[7]), "\n".join(body)


def write_srt(cues: list[Cue]) -> str:
    return "".join(f"{k}\n{_clock(a, ',')} --> {_clock(b if b is not None else a, ',')}\n{t}\n\n" for k, (a, b, t) in enumerate(cues, 1))


def write_webvtt(cues: list[Cue]) -> str:
    clock = lambda ms: _clock(ms) if ms >= 3_600_000 else _clock(ms)[3:]
    return "WEBVTT\n" + "".join(f"\n{clock(a)} --> {clock(b if b is not None else a)}\n{t}\n" for a, b, t in cues)


def read_microdvd(text: str, fps: float = 23.976) -> Iterator[Cue]:
    """Frame numbers; a first cue at frame 1 that holds a number sets the frame rate."""
    for k, line in enumerate(_lines(text)):
        m = re.match(r"\{(\d+)\}\{(\d*)\}(.*)", line)
        if not m:
            continue
        if k == 0 and m[1] in ("0", "1") and re.fullmatch(r"\d+(\.\d+)?", m[3].strip()):
            fps = float(m[3])
            continue
        yield round(int(m[1]) * 1000 / fps), round(int(m[2]) * 1000 / fps) if m[2] else None, m[3].replace("|", "\n")


def write_microdvd(cues: list[Cue], fps: float = 25.0) -> str:
    frame = lambda ms: round(ms * fps / 1000)
    return f"{{1}}{{1}}{fps:g}\n" + "".join(f"{{{frame(a)}}}{{{frame(b) if b is not None else ''}}}{t.replace(chr(10), '|')}\n" for a, b, t in cues)


def read_mpl2(text: str) -> Iterator[Cue]:
    """Tenths of a second in square brackets; ``|`` parts lines, a slash before one makes it italic."""
    for line in _lines(text):
        if m := re.match(r"\[(\d+)\]\[(\d*)\](.*)", line):
            yield int(m[1]) * 100, int(m[2]) * 100 if m[2] else None, "\n".join(x.removeprefix("/") for x in m[3].split("|"))


def read_mpsub(text: str) -> Iterator[Cue]:
    """A line with the wait after the last cue and the length, in seconds; text up to an empty line."""
    lines, at, now = _lines(text), 0, 0.0
    while at < len(lines):
        m = re.fullmatch(r"\s*(-?\d+(?:\.\d+)?)\s+(\d+(?:\.\d+)?)\s*", lines[at])
        at += 1
        if not m:
            continue
        body = []
        while at < len(lines) and lines[at].strip():
            body.append(lines[at])
            at += 1
        start = now + float(m[1])
        now = start + float(m[2])
        yield round(start * 1000), round(now * 1000), "\n".join(body)


def read_lrc(text: str) -> Iterator[Cue]:
    """Several times may stand before a line; ``offset`` (milliseconds) makes all of them earlier."""
    offset, found = 0, []
    for line in _lines(text):
        if m := re.match(r"\[offset:\s*([+-]?\d+)\]", line):
            offset = int(m[1])
            continue
        times, rest = [], line
        while m := re.match(r"\s*\[(\d+):(\d+)(?:[.:](\d+))?\]", rest):
            times.append(_ms(0, m[1], m[2], m[3] or "0"))
            rest = rest[m.end() :]
        found += [(t, rest.strip()) for t in times]
    return _until_next((max(0, t - offset), None, body) for t, body in sorted(found, key=lambda x: x[0]))


def write_lrc(cues: list[Cue]) -> str:
    return "".join(f"[{a // 60_000:02d}:{a // 1000 % 60:02d}.{a % 1000 // 10:02d}]{line}\n" for a, _, t in cues for line in t.split("\n"))


def read_subviewer(text: str) -> Iterator[Cue]:
    """``hh:mm:ss.cc,hh:mm:ss.cc`` and a line, in which ``[br]`` parts lines."""
    lines = _lines(text)
    for line, body in zip(lines, [*lines[1:], ""], strict=True):
        if m := re.match(r"(\d+):(\d+):(\d+)[.,](\d+),(\d+):(\d+):(\d+)[.,](\d+)", line):
            yield _ms(*m.groups()[:4]), _ms(*m.groups()[4:]), body.replace("[br]", "\n")


def read_subviewer1(text: str) -> Iterator[Cue]:
    """``[hh:mm:ss]`` before the text, and another one, before an empty line, where it ends."""
    lines = [x for x in _lines(text)]
    found = [(k, _ms(*m.groups())) for k, x in enumerate(lines) if (m := re.match(r"\[(\d+):(\d+):(\d+)\]\s*$", x))]
    for n, (k, start) in enumerate(found):
        end = found[n + 1][1] if n + 1 < len(found) else None
        body = [x for x in lines[k + 1 : found[n + 1][0] if n + 1 < len(found) else len(lines)] if x.strip()]
        if body:
            yield start, end, "\n".join(body[0].split("|"))


def read_vplayer(text: str) -> Iterator[Cue]:
    found = []
    for line in _lines(text):
        if m := re.match(r"(\d+):(\d+):(\d+)(?:[.,](\d+))?[:=\s]\s*(.*)", line):
            found.append((_ms(m[1], m[2], m[3], m[4] or "0"), None, m[5].replace("|", "\n")))
    return _until_next(sorted(found, key=lambda c: c[0]))


def read_pjs(text: str) -> Iterator[Cue]:
    """Tenths of a second, and the text in quotes."""
    for line in _lines(text):
        if m := re.match(r'\s*(\d+),\s*(\d+),\s*"(.*)"', line):
            yield int(m[1]) * 100, int(m[2]) * 100, m[3].replace("|", "\n")


def read_stl(text: str, fps: float = 30.0) -> Iterator[Cue]:
    """Spruce's text form: ``hh:mm:ss:ff , hh:mm:ss:ff , text``; frames after the last colon."""
    at = lambda g: _ms(*g[:3]) + int(int(g[3]) * 1000 / fps)
    for line in _lines(text):
        if m := re.match(r"(\d+):(\d+):(\d+)[:.](\d+)\s*,\s*(\d+):(\d+):(\d+)[:.](\d+)\s*,\s*(.*)", line):
            yield at(m.groups()[:4]), at(m.groups()[4:8]), m[9].replace("|", "\n")


def read_jacosub(text: str) -> Iterator[Cue]:
    """``h:mm:ss.hh h:mm:ss.hh {commands} text``, or frames at 30 a second after ``@``; ``\\n`` parts lines."""
    for line in _lines(text):
        if m := re.match(r"(\d+):(\d+):(\d+)\.(\d+)\s+(\d+):(\d+):(\d+)\.(\d+)\s+(.*)", line):
            span, body = (_ms(*m.groups()[:4]), _ms(*m.groups()[4:8])), m[9]
        elif m := re.match(r"@(\d+)\s+@(\d+)\s+(.*)", line):
            span, body = (round(int(m[1]) * 1000 / 30), round(int(m[2]) * 1000 / 30)), m[3]
        else:
            continue
        yield *span, re.sub(r"^[A-Z]{1,2}\d*\s+|\{[^}]*\}", "", body).replace("\\n", "\n")


def write_jacosub(cues: list[Cue]) -> str:
    clock = lambda ms: f"{ms // 3_600_000}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000 // 10:02d}"
    return "#TIMERES 100\n" + "".join(f"{clock(a)} {clock(b if b is not None else a)} {t.replace(chr(10), chr(92) + 'n')}\n" for a, b, t in cues)


def _markup(body: str) -> str:
    return html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?i)<br\s*/?>", "\n", body))).strip()


def read_realtext(text: str) -> Iterator[Cue]:
    span = re.compile(r'(?is)<time\s+begin="([^"]*)"(?:\s+end="([^"]*)")?\s*/?>')
    marks = list(span.finditer(text))

    def at(value: str) -> int:
        parts = [float(x) for x in value.split(":")]
        return round(1000 * sum(x * 60**k for k, x in enumerate(reversed(parts))))

    cues = []
    for m, following in zip(marks, [*marks[1:], None], strict=False):
        body = _markup(text[m.end() : following.start() if following else len(text)])
        cues.append((at(m[1]), at(m[2]) if m[2] else None, body))
    return (c for c in _until_next(cues) if c[2])


def read_sami(text: str) -> Iterator[Cue]:
    """A cue lasts until the next ``sync``; one of blanks ends the one before."""
    marks = list(re.finditer(r"(?i)<sync\s+start\s*=\s*\"?(\d+)\"?[^>]*>", text))
    cues = [(int(m[1]), None, _markup(text[m.end() : n.start() if n else len(text)]).replace("\xa0", "").strip()) for m, n in zip(marks, [*marks[1:], None], strict=False)]
    return (c for c in _until_next(cues) if c[2])


def _ass_time(value: str) -> int | None:
    m = re.fullmatch(r"\s*(\d+):(\d+):(\d+)[.:](\d+)\s*", value)
    return _ms(*m.groups()) if m else None


def read_ass(text: str) -> Iterator[Cue]:
    """The dialogue of the events, without override blocks; the last field of a line may hold commas."""
    fields, inside = ["Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text"], False
    for line in _lines(text):
        if line.strip().startswith("["):
            inside = line.strip().lower() == "[events]"
        elif inside and line.lower().startswith("format:"):
            fields = [x.strip() for x in line[7:].split(",")]
        elif inside and line.startswith("Dialogue:"):
            values = dict(zip(fields, line[9:].split(",", len(fields) - 1), strict=False))
            start, end = _ass_time(values.get("Start", "")), _ass_time(values.get("End", ""))
            if start is not None:
                yield start, end, re.sub(r"\{[^}]*\}", "", values.get("Text", "")).replace("\\N", "\n").replace("\\n", "\n").replace("\\h", " ").strip()


def write_ass(cues: list[Cue]) -> str:
    clock = lambda ms: f"{ms // 3_600_000}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000 // 10:02d}"
    head = "[Script Info]\nScriptType: v4.00+\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize\nStyle: Default,Arial,16\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
    return head + "".join(f"Dialogue: 0,{clock(a)},{clock(b if b is not None else a)},Default,,0,0,0,,{t.replace(chr(10), chr(92) + 'N')}\n" for a, b, t in cues)


def read_ttml(text: str) -> Iterator[Cue]:
    """Paragraphs with begin and end, or dur; clock times or seconds, milliseconds, minutes and hours."""
    units = {"h": 3_600_000, "m": 60_000, "s": 1000, "ms": 1}

    def at(value: str) -> int | None:
        if m := re.fullmatch(r"(\d+):(\d+):(\d+)(?:[.:](\d+))?", value):
            return _ms(m[1], m[2], m[3], m[4] or "0")
        m = re.fullmatch(r"(\d+(?:\.\d+)?)(h|ms|m|s)", value)
        return round(float(m[1]) * units[m[2]]) if m else None

    for m in re.finditer(r"(?is)<(?:\w+:)?p\b([^>]*?)(?:/>|>(.*?)</(?:\w+:)?p>)", text):
        values = dict(re.findall(r'(\w+)="([^"]*)"', m[1]))
        start = at(values.get("begin", ""))
        if start is not None:
            end, length = at(values.get("end", "")), at(values.get("dur", ""))
            yield start, end if end is not None else start + length if length is not None else None, _markup(m[2] or "")


def write_ttml(cues: list[Cue]) -> str:
    body = "".join(f'      <p begin="{_clock(a)}" end="{_clock(b if b is not None else a)}">{html.escape(t).replace(chr(10), "<br/>")}</p>\n' for a, b, t in cues)
    return f'<?xml version="1.0" encoding="utf-8"?>\n<tt xmlns="http://www.w3.org/ns/ttml">\n  <body>\n    <div>\n{body}    </div>\n  </body>\n</tt>\n'


def read_scc(text: str) -> Iterator[Cue]:
    """Cues are the pairs of bytes, in hexadecimal, of a line; they last until the next line's time. Frames are 30 a second."""
    found = []
    for line in _lines(text):
        if m := re.match(r"(\d+):(\d+):(\d+)[:;](\d+)\s+((?:[0-9a-fA-F]{4}\s*)+)$", line):
            found.append((_ms(*m.groups()[:3]) + int(m[4]) * 1000 // 30, None, " ".join(m[5].split()).lower()))
    return _until_next(found)


def write_scc(cues: list[Cue]) -> str:
    clock = lambda ms: f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}:{(ms % 1000 * 30 + 999) // 1000:02d}"
    return "Scenarist_SCC V1.0\n" + "".join(f"\n{clock(a)}\t{t}\n" for a, _, t in cues)


READERS: dict[str, Callable[[str], Iterable[Cue]]] = {
    "srt": read_srt, "webvtt": read_srt, "microdvd": read_microdvd, "mpl2": read_mpl2, "mpsub": read_mpsub, "lrc": read_lrc, "subviewer": read_subviewer, "subviewer1": read_subviewer1,
    "vplayer": read_vplayer, "pjs": read_pjs, "stl": read_stl, "jacosub": read_jacosub, "realtext": read_realtext, "sami": read_sami, "ass": read_ass, "ttml": read_ttml, "scc": read_scc,
}
WRITERS: dict[str, Callable[[list[Cue]], str]] = {"srt": write_srt, "webvtt": write_webvtt, "microdvd": write_microdvd, "lrc": write_lrc, "jacosub": write_jacosub, "ass": write_ass, "ttml": write_ttml, "scc": write_scc}

#: What shows a format, in the order of trial.
SIGNS = (
    ("webvtt", r"﻿?WEBVTT"), ("scc", r"Scenarist_SCC"), ("ass", r"﻿?\[Script Info\]"), ("sami", r"(?i)\s*<SAMI>"), ("realtext", r"(?i)\s*<window"), ("ttml", r"(?s)\s*(<\?xml[^>]*>\s*)?<tt\b"),
    ("mpsub", r"(?m)^FORMAT=(TIME|\d+)"), ("microdvd", r"\{\d+\}\{\d*\}"), ("mpl2", r"\[\d+\]\[\d*\]"), ("srt", r"(?m)^\s*(?:\d+:)?\d+:\d+,\d+\s*-->"), ("subviewer", r"(?m)^\d+:\d+:\d+\.\d+,\d+:\d+:\d+\.\d+"),
    ("subviewer1", r"(?m)^\[\d+:\d+:\d+\]\s*$"), ("lrc", r"(?m)^\[\d+:\d+(\.\d+)?\]"), ("pjs", r'(?m)^\s*\d+,\s*\d+,\s*"'), ("stl", r"(?m)^\d+:\d+:\d+[:.]\d+\s*,"), ("jacosub", r"(?m)^(\d+:\d+:\d+\.\d+\s+\d+:|@\d+\s+@)"),
    ("vplayer", r"(?m)^\d+:\d+:\d+[:= ]"),
)


def detect(text: str) -> str | None:
    return next((name for name, sign in SIGNS if re.match(sign, text) or sign.startswith("(?m)") and re.search(sign, text[:4096])), None)


def demux(files: DataFrame, format: str = "auto", column: str = "content") -> DataFrame:
    """(.., format, cue, start, end, text): a row for each cue of each file's bytes, UTF-8 with replacements for what isn't."""

    def cues(raw: bytes) -> Iterator[tuple]:
        text = bytes(raw).decode("utf-8", "replace")
        name = detect(text) if format == "auto" else format
        for k, (start, end, body) in enumerate(READERS[name](text) if name else ()):
            yield name, k, start, end, body

    return payload.rows(files, cues, [column], "format string, cue int, start long, end long, text string").drop(column)


def mux(cues: DataFrame, by: str, format: str) -> DataFrame:
    """(by, content): a file for each value of ``by``, cues in order of start. One file's cues are brought together, as it is one value."""
    held = cues.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("_cues"))
    return payload.each(held, lambda xs: (WRITERS[format]([(x["start"], x["end"], x["text"]) for x in xs]),), ["_cues"], "content string").select(by, "content")


def read(spark: SparkSession, path: str, format: str = "auto") -> DataFrame:
    return demux(spark.read.format("binaryFile").load(path).select("path", "content"), format)


def burn(frames: DataFrame, cues: DataFrame, by: str, width: int) -> DataFrame:
    """(by, pts, v, cue): what each frame shows; see ``align.intervals``. A cue has start, end and ``cue``."""
    from ..operators.align import intervals

    return intervals(frames, cues, width, by)
