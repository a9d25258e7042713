"""Encodings and labels: quantised bytes, level characters, bins, names, phrases, times out of paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import c, d

# The 64 level characters, the unit codes that stay upper-case in fire names, and the time stamps in file names.
LEVELS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
UNITS = (
    "SCU LNU CZU SQF KNP SHU BTU TCU MEU AMR BEU SLU RRU BDU LMU NEU FKU "
    "MMU TGU HUU SKU MVU LAC ORC VNC SBC KRN TUU MRN ENF STF SNF TNF SRF KNF"
).split()
STAMP = r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})(?:[T_ -]?(\d{2})[-_:]?(\d{2})(?:[-_:]?(\d{2}))?)?"
QUANTUM, NO_VALUE = 500.0, -128


def quantised(values: Column) -> Column:
    """An array of numbers as base64 of int8 (value * 500, halves to even, clipped; missing is -128)."""
    def byte(v: Column) -> Column:
        n = F.when(v.isNull() | F.isnan(v), d(NO_VALUE)).otherwise(F.greatest(d(-128), F.least(d(127), F.rint(v * d(QUANTUM)))))
        return F.lpad(F.right(F.hex(n.cast("bigint")), F.lit(2)), 2, "0")

    return F.base64(F.to_binary(F.array_join(F.transform(values, byte), ""), F.lit("hex")))


def dequantised(text: Column) -> Column:
    """The numbers of ``quantised``; missing ones are NULL."""
    h = F.hex(F.unbase64(text))
    n = F.expr("int(0)") + (F.length(h) / 2).cast("int")
    def value(k: Column) -> Column:
        u = F.conv(F.substr(h, k * 2 - 1, F.lit(2)), 16, 10).cast("int")
        v = F.when(u > 127, u - 256).otherwise(u)
        return F.when(v > NO_VALUE, v / d(QUANTUM))

    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), value)).otherwise(F.array().cast("array<double>"))


def level(x: Column, low: Column, high: Column) -> Column:
    """One of 64 characters for a value clipped to a range; "." if it is missing."""
    share = F.try_divide(F.least(F.greatest(x, low), high) - low, high - low)
    return F.when(x.isNull(), F.lit(".")).otherwise(F.substr(F.lit(LEVELS), F.coalesce(F.rint(share * 63).cast("int"), F.lit(0)) + 1, F.lit(1)))


def binned(x: Column, edges: list[float]) -> Column:
    """Number of the half-open bin [edge, next edge) that holds x; NULL outside."""
    out = F.when(F.lit(False), F.lit(0))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        out = out.when((x >= a) & (x < b), F.lit(k))
    return out


def fire_name(name: Column) -> Column:
    """Title case, unit codes in capitals, a capital after Mc."""
    def cased(w: Column) -> Column:
        rest = F.substr(w, F.lit(3), F.length(w))
        return F.when(F.upper(w).isin(*UNITS), F.upper(w)).when(F.startswith(w, F.lit("Mc")) & (F.length(w) > 3), F.concat(F.lit("Mc"), F.initcap(rest))).otherwise(w)

    return F.array_join(F.transform(F.filter(F.split(F.initcap(F.lower(name)), r"\s+"), lambda w: w != ""), cased), " ")


def change_phrase(a: Column, b: Column) -> Column:
    """How b compares with a error: "the same error as", or so many percent "less"/"more error than"."""
    p = (b - a) / a * 100
    return F.when(F.abs(p) < 0.5, F.lit("the same error as")).otherwise(
        F.concat(F.rint(F.abs(p)).cast("bigint").cast("string"), F.when(p < 0, F.lit("% less error than")).otherwise(F.lit("% more error than"))))


def photo_time(path: Column) -> Column:
    """Capture time in a path: year, month, day and perhaps hour, minute, second; else a ten-digit Unix time; else NULL.

    Only the last part of the path counts. The first stamp with a year from 1990 to 2100, a month, a day, an hour under
    24 and a minute under 60 holds; parts that are absent are 0, and so is a second over 59. A date that does not exist
    gives NULL.
    """
    name = F.element_at(F.split(c(path), "/"), -1)
    parts = [F.regexp_extract_all(name, F.lit(STAMP), F.lit(k)) for k in range(1, 7)]
    rows = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("y", "m", "d", "h", "i", "s"))))
    num = lambda t: F.coalesce(F.nullif(t, F.lit("")).cast("int"), F.lit(0))
    fits = F.filter(rows, lambda r: num(r["y"]).between(1990, 2100) & num(r["m"]).between(1, 12) & num(r["d"]).between(1, 31) & (num(r["h"]) < 24) & (num(r["i"]) < 60))
    r = F.get(fits, F.lit(0))
    sec = F.when(num(r["s"]) > 59, F.lit(0)).otherwise(num(r["s"]))
    text = F.format_string("%04d-%02d-%02d %02d:%02d:%02d", num(r["y"]), num(r["m"]), num(r["d"]), num(r["h"]), num(r["i"]), sec)
    made = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss"))
    unix = F.nullif(F.regexp_extract(name, r"(?<!\d)(1[0-9]{9})(?!\d)", 1), F.lit("")).cast("bigint")
    return F.when(r.isNotNull(), made).otherwise(F.timestamp_seconds(unix)).cast("timestamp_ntz")
