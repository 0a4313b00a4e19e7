"""Scalar families beside the expression language: numbers, times and tags as text, dumps, patterns of file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of powers of a thousand, and of 1024.
DECIMAL = ("", "K", "M", "G", "T", "P", "E")


def prefixed(x: Column, unit: str = "", binary: bool = False) -> Column:
    """A number with six decimals and the largest power that it reaches: ``1.500000 Mbit/s``; whole numbers below the first power stay whole."""
    base = 1024.0 if binary else 1000.0
    power = F.greatest(F.lit(0), F.least(F.lit(len(DECIMAL) - 1), F.when(F.abs(x) >= 1, F.floor(F.log(F.abs(x).cast("double")) / F.log(F.lit(base)) + 1e-12)).otherwise(0))).cast("int")
    mark = F.get(F.array(*[F.lit(p + ("i" if binary and p else "")) for p in DECIMAL]), power)
    number = F.when(power == 0, F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(F.format_string("%f", x.cast("double")))).otherwise(F.format_string("%f", x / F.pow(F.lit(base), power)))
    tail = F.concat(mark, F.lit(unit))
    return F.when(tail == "", number).otherwise(F.concat(number, F.lit(" "), tail))


def sexagesimal(seconds: Column) -> Column:
    """``h:mm:ss.uuuuuu``; a sign in front."""
    micros = F.floor(F.abs(seconds) * 1_000_000 + 0.5)
    text = F.format_string("%d:%02d:%02d.%06d", F.floor(micros / 3_600_000_000), F.floor(micros / 60_000_000) % 60, F.floor(micros / 1_000_000) % 60, micros % 1_000_000)
    return F.when(seconds < 0, F.concat(F.lit("-"), text)).otherwise(text)


def duration_micros(text: Column) -> Column:
    """Microseconds of ``[-][HH:]MM:SS[.m]`` or ``[-]S[.m][s|ms|us]``; null for anything else."""
    t = F.trim(text)
    sign = F.when(F.startswith(t, F.lit("-")), -1).otherwise(1)
    clock = r"^-?(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d*)?)$"
    plain = r"^-?(\d+(?:\.\d*)?|\.\d+)(s|ms|us)?$"
    part = lambda k: F.when(F.regexp_extract(t, clock, k) == "", F.lit("0")).otherwise(F.regexp_extract(t, clock, k)).cast("decimal(38,9)")
    hms = part(1) * 3_600_000_000 + part(2) * 60_000_000 + part(3) * 1_000_000
    unit = F.regexp_extract(t, plain, 2)
    scale = F.when(unit == "ms", 1000).when(unit == "us", 1).otherwise(1_000_000)
    number = F.when(t.rlike(plain), F.regexp_extract(t, plain, 1)).otherwise("0").cast("decimal(38,9)") * scale
    return F.when(t.rlike(clock), (sign * F.floor(hms)).cast("long")).when(t.rlike(plain), (sign * F.floor(number)).cast("long"))


def rational(num: Column, den: Column, mark: str = "/") -> Column:
    """In lowest terms."""
    from .expr import COLUMNS

    g = COLUMNS["gcd"](num.cast("double"), den.cast("double")).cast("long")
    by = F.when(g == 0, F.lit(1).cast("long")).otherwise(F.abs(g))
    return F.concat((num / by).cast("long").cast("string"), F.lit(mark), (den / by).cast("long").cast("string"))


def hex_dump(payload: Column) -> Column:
    """Lines of sixteen bytes: the offset, pairs of bytes in hexadecimal, and printable ASCII."""
    text, n = F.lower(F.hex(payload)), F.octet_length(payload)
    shown = F.regexp_replace(F.decode(payload, "ISO-8859-1"), r"[^\x20-\x7e]", ".")

    def line(k: Column) -> Column:
        own = F.substring(text, k * 32 + 1, F.lit(32))
        pairs = F.regexp_replace(F.rpad(own, 32, " "), "(....)", "$1 ")
        return F.concat(F.lpad(F.lower(F.hex(k * 16)), 8, "0"), F.lit(": "), pairs, F.lit(" "), F.substring(shown, k * 16 + 1, F.lit(16)), F.lit("\n"))

    lines = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(n / 16) - 1), line)
    return F.when(n > 0, F.concat_ws("", lines)).otherwise("")


def glob_pattern(pattern: str) -> str:
    """A regular expression for file names with ``*``, ``?``, ``[...]``, ``{a,b}`` and backslashes; a sign ``%`` before one makes it one."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c in "\\%" and k + 1 < len(pattern) and pattern[k + 1] in "*?[]{}\\%":
            k += 1
            out += re.escape(pattern[k])
        elif c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", k + 2)) > 0:
            out += "[" + pattern[k + 1 : end].replace("!", "^", 1) + "]"
            k = end
        elif c == "{" and (end := pattern.find("}", k)) > 0:
            out += "(?:" + "|".join(re.escape(x) for x in pattern[k + 1 : end].split(",")) + ")"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return f"^{out}$"


#: Language tags of three letters (bibliographic, where it differs also terminological) and of two.
LANGUAGES = (
    ("ara", "ara", "ar"), ("chi", "zho", "zh"), ("cze", "ces", "cs"), ("dan", "dan", "da"), ("dut", "nld", "nl"), ("eng", "eng", "en"), ("fin", "fin", "fi"), ("fre", "fra", "fr"), ("ger", "deu", "de"),
    ("gre", "ell", "el"), ("heb", "heb", "he"), ("hin", "hin", "hi"), ("hun", "hun", "hu"), ("ita", "ita", "it"), ("jpn", "jpn", "ja"), ("kor", "kor", "ko"), ("nor", "nor", "no"), ("per", "fas", "fa"),
    ("pol", "pol", "pl"), ("por", "por", "pt"), ("rum", "ron", "ro"), ("rus", "rus", "ru"), ("slo", "slk", "sk"), ("spa", "spa", "es"), ("swe", "swe", "sv"), ("tur", "tur", "tr"), ("ukr", "ukr", "uk"), ("vie", "vie", "vi"),
)


def language(tag: Column, to: str = "bibliographic") -> Column:
    """A tag of any of the three forms as one of them (bibliographic, terminological, two); null if it isn't known."""
    k = {"bibliographic": 0, "terminological": 1, "two": 2}[to]
    table = {x: row[k] for row in LANGUAGES for x in row}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(tag))


def option_map(text: str, pair: str = "=", separator: str = ":") -> dict[str, str]:
    """``key=value:key=value`` with one level of quotes and backslashes."""
    parts, now, quoted, k = [], "", False, 0
    while k < len(text):
        if text[k] == "\\" and not quoted and k + 1 < len(text):
            now += text[k + 1]
            k += 1
        elif text[k] == "'":
            quoted = not quoted
        elif text[k] == separator and not quoted:
            parts.append(now)
            now = ""
        else:
            now += text[k]
        k += 1
    out = {}
    for part in [*parts, now]:
        key, mark, value = part.partition(pair)
        if mark:
            out[key.strip()] = value
    return out


class BitReader:
    """Bits of some bytes, the highest first, and exponential Golomb codes; past the end there are zeros."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def bits(self, n: int) -> int:
        shift = self.left - n
        self.left = shift
        return (self.value >> shift if shift >= 0 else self.value << -shift) & (1 << n) - 1

    def golomb(self) -> int:
        zeros = 0
        while zeros < 32 and not self.bits(1):
            zeros += 1
        return (1 << zeros) - 1 + self.bits(zeros)

    def signed_golomb(self) -> int:
        k = self.golomb()
        return (k + 1) // 2 if k % 2 else -(k // 2)
