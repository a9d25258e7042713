"""Secret scans: fixed patterns, and sliding-window Shannon entropy per character class, as Spark expressions only.

Positions come from splitting a text at a pattern: the pieces between the matches and the matches themselves alternate,
so running sums of their lengths are the offsets, in code points. The entropy scan takes every long run of token
characters outside the pattern matches. A window slides over the run; the counts of the characters in it and the sum of
count * log2(count) are kept up to date by adding one character and removing one, so a step costs the alphabet's size
whatever the window. The threshold depends on the run's character class. Allow-listed runs (placeholders, words in ordinary
spelling, plain numbers, UUIDs, ordered alphabets, paths of words) are suppressed; pattern matches never are. A long run is
worked on in parts that overlap by a window, and its first part that reaches the threshold settles it.

There is no Python on the executors and no shuffle. What a text's matches need of each other (offsets, overlaps, masked
pieces) is worked out in blocks of ``BLOCK`` matches, so that texts with very many matches stay affordable.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

# The patterns, the least length that counts and the group whose length it is, in reporting order.
KINDS = [
    ("assign", r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
#: Runs that the entropy scan looks at.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Alphabet of the counts; other letters cannot occur in a run.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: (character class, pattern of the whole run, least entropy of a window in bits); the first class that fits holds.
CLASSES = [("hex", r"^[0-9a-fA-F]+$", 3.0), ("alpha", r"^[A-Za-z]+$", 3.8), ("alnum", r"^[0-9A-Za-z]+$", 3.6), ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.8)]
#: Runs that are no secrets whatever their entropy. Repeats are possessive: a group that gives back takes stack for each turn.
ALLOWED = [
    r"(?i)(?:^|[+/_=-])(?:example|sample|dummy|placeholder|changeme|redacted|your)(?:[+/_=-]|$)|example(?:key)?$|xxxxxx",
    r"^[+/_=-]*+(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)[+/_=-]*+)++$",
    r"^[0-9+/_=-]+$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)(?:^|=)(?:0123456789|1234567890|abcdefghij)",
    r"^/?(?:[A-Za-z]++[0-9]{0,2}+[/_-]++)++[A-Za-z]*+[0-9]{0,2}+$",
]
#: Characters of a run that are worked on together.
PART = 1_024
SPAN = "struct<start:int,rank:int,end:int,kind:string,said:string>"
#: Matches that are worked on together.
BLOCK = 256


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def in_blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK items; none for an empty one."""
    n = F.ceil(F.size(items) / BLOCK).cast("int")
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: k < n)
    return F.transform(numbers, lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def bare(spans: Column) -> Column:
    """Spans without what they say."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))


def located(text: Column, pattern: str, group: int, least: int, kind: str, rank: int) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches whose group has at least so many characters, with their text."""
    p = F.lit(pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    sized = whole if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    steps = F.zip_with(
        F.zip_with(F.split(text, pattern, -1), whole, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("said"))),
        sized, lambda a, g: F.struct(a["gap"].alias("gap"), a["said"].alias("said"), F.length(a["said"]).alias("n"), F.length(g).alias("g")))
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["n"]
        new = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["said"].alias("said")))
        return F.struct(end.alias("at"), F.when(x["g"] >= least, F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    def block(acc: Column, own: Column) -> Column:
        within = F.aggregate(own, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return let(within, lambda w: F.struct(w["at"].alias("at"), F.concat(acc["parts"], F.array(w["out"])).alias("parts")))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("parts"))
    found = let(F.filter(steps, lambda x: x["n"].isNotNull()), lambda x: F.aggregate(in_blocks(x), zero, block, lambda acc: F.flatten(acc["parts"])))
    return F.when(text.rlike(pattern), found).otherwise(none)


def window_entropy(codes: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of any window of so many of an array of ALPHABET's numbers; 0 for a shorter one."""
    xlog = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def moved(acc: Column, code: Column, by: int) -> Column:
        old = F.get(acc["counts"], code)
        return F.struct(
            F.transform(acc["counts"], lambda n, k: F.when(k == code, n + by).otherwise(n)).alias("counts"),
            (acc["sum"] + xlog(old + by) - xlog(old)).alias("sum"), acc["best"].alias("best"))

    def step(acc: Column, x: Column) -> Column:
        after = moved(acc, x["code"], 1)
        slid = F.when(x["gone"] >= 0, let(after, lambda a: moved(a, x["gone"], -1))).otherwise(after)
        entropy = F.lit(math.log2(window)) - slid["sum"] / window
        best = F.when((x["gone"] > -2) & (entropy > slid["best"]), entropy).otherwise(slid["best"])
        return F.struct(slid["counts"].alias("counts"), slid["sum"].alias("sum"), best.alias("best"))

    # Each character with the one that leaves the window: -1 when the first window is full, -2 before.
    steps = F.transform(codes, lambda c, i: F.struct(c.alias("code"), F.when(i >= window, F.get(codes, i - window)).when(i == window - 1, F.lit(-1)).otherwise(F.lit(-2)).alias("gone")))
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
    return F.aggregate(steps, zero, step, lambda acc: acc["best"])


def parts_of(run: Column, window: int = WINDOW, size: int = PART) -> Column:
    """A run cut into parts, each followed by the next one's first characters, so that every window lies in one."""
    return let(F.regexp_extract_all(run, F.lit(f".{{1,{size}}}"), F.lit(0)), lambda parts: F.transform(
        parts, lambda p, i: F.concat(p, F.coalesce(F.substr(F.get(parts, i + 1), F.lit(1), F.lit(window - 1)), F.lit("")))))


def suspicious(run: Column) -> Column:
    """Whether a run's windows reach its class's entropy and no allow-list entry suppresses it."""
    allowed = reduce(Column.__or__, (run.rlike(p) for p in ALLOWED))
    least = reduce(lambda acc, c: acc.when(run.rlike(c[1]), F.lit(c[2])), CLASSES[1:], F.when(run.rlike(CLASSES[0][1]), F.lit(CLASSES[0][2])))

    def reached(part: Column, bits: Column) -> Column:
        codes = F.transform(F.split(part, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
        # A window's entropy is at most the logarithm of the number of characters it can draw on.
        return let(codes, lambda x: F.when(F.log2(F.size(F.array_distinct(x))) < bits, F.lit(False)).otherwise(window_entropy(x) >= bits))

    return F.when(allowed, F.lit(False)).otherwise(let(least, lambda bits: F.exists(parts_of(run), lambda part: reached(part, bits))))


def with_spans(docs: DataFrame, base_col: str, all_col: str, text_col: str = "text") -> DataFrame:
    """Adds two arrays of (start, rank, end, kind) in order: the pattern matches, and these with the entropy spans."""
    text = text_of(text_col)
    ranked = [bare(located(text, p, g, n, kind, rank)) for rank, (kind, p, g, n) in enumerate(KINDS)]
    docs = docs.withColumn(base_col, F.array_sort(F.concat(*ranked)))
    runs = located(text, CANDIDATE, 0, WINDOW, "entropy", len(KINDS))
    # Blocks of pattern matches with the range that they cover: a run looks only into those that it touches.
    covered = F.transform(in_blocks(F.col(base_col)), lambda own: F.struct(
        own.alias("own"), F.get(own, F.lit(0))["start"].alias("start"), F.array_max(F.transform(own, lambda b: b["end"])).alias("end")))
    meets = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    free = lambda s, c: ~F.exists(c, lambda k: meets(s, k) & F.exists(k["own"], lambda b: meets(s, b)))
    extra = let(covered, lambda c: F.filter(F.filter(runs, lambda s: free(s, c)), lambda s: suspicious(s["said"])))
    return docs.withColumn(all_col, F.array_sort(F.concat(F.col(base_col), bare(extra))))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans): one row per row of docs, counts and spans of its secrets.

    Null and empty texts have no spans. Ids may be null or repeated. Other columns of docs are ignored.
    """
    rows = with_spans(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias("__text")), "__base", "__all", "__text")
    number = lambda rank: F.size(F.filter("__base", lambda s: s["rank"] == rank)).cast("bigint")
    counts = [number(rank).alias(f"n_{kind}") for rank, (kind, *_) in enumerate(KINDS)]
    return rows.select(id_col, *counts, F.sha2(digest(F.col("__base")).cast("binary"), 256).alias("base_sha256"), digest(F.col("__all")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span (overlapping ones as one) replaced by a mark; ``chars_col`` follows the text.

    A null text stays null. All other columns stay as they were.
    """
    rows = with_spans(docs, "__landsight_base", "__landsight_all", text_col)
    text = F.col(f"`{text_col}`")

    def block(acc: Column, own: Column) -> Column:
        """The pieces of the text up to the end of a block of spans, cut from that part of the text alone."""
        end = F.greatest(acc["at"], F.array_max(F.transform(own, lambda s: s["end"])))

        def pieces(part: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                said = F.concat(F.substr(part["text"], a["at"] - acc["at"] + 1, s["start"] - a["at"]), F.lit(mark))
                kept = F.when(s["start"] >= a["at"], F.concat(a["said"], F.array(said))).otherwise(a["said"])
                return F.struct(F.greatest(a["at"], s["end"]).alias("at"), kept.alias("said"))

            within = F.aggregate(own, F.struct(acc["at"].alias("at"), F.array().cast("array<string>").alias("said")), step, lambda a: a["said"])
            return F.struct(part["end"].alias("at"), F.concat(acc["parts"], F.array(F.array_join(within, ""))).alias("parts"))

        return let(F.struct(end.alias("end"), F.substr(text, acc["at"] + 1, end - acc["at"]).alias("text")), pieces)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    masked = F.aggregate(in_blocks(F.col("__landsight_all")), zero, block, lambda a: F.concat(F.array_join(a["parts"], ""), F.substr(text, a["at"] + 1, F.length(text))))
    out = rows.withColumn(text_col, F.when(F.size("__landsight_all") > 0, masked).otherwise(text)).drop("__landsight_base", "__landsight_all")
    return out.withColumn(chars_col, F.length(text).cast(docs.schema[chars_col].dataType)) if chars_col and chars_col in docs.columns else out


def oracle_sql(table: str = "documents") -> str:
    """``scan`` of a table in DuckDB's SQL: the same patterns and offsets, entropies by its own aggregate."""
    plain = lambda p: re.sub(r"([+*}])\+", r"\1", p)  # noqa: E731  RE2 has no possessive repeats and needs none
    either = lambda w: "".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in w)  # noqa: E731  its (?i) is not ASCII only
    words = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    patterns = [(kind, p.replace("(?i:", "(?:").replace("password|passwd|secret|token|api_?key", words), g, n) for kind, p, g, n in KINDS]
    quoted = lambda p: "'" + plain(p).replace("'", "''") + "'"
    spans = lambda rank, kind, p, g, n: f"""SELECT row, {rank} AS rank, '{kind}' AS kind, said, g, CAST(coalesce(sum(length(gap) + length(said)) OVER before, 0) + length(gap) AS BIGINT) AS start
  FROM (SELECT row, unnest(range(1, len(said) + 1)) AS k, unnest(gaps[1:len(said)]) AS gap, unnest(said) AS said, unnest(g) AS g FROM (
    SELECT row, string_split_regex(text, {quoted(p)}) AS gaps, regexp_extract_all(text, {quoted(p)}) AS said, regexp_extract_all(text, {quoted(p)}, {g}) AS g FROM texts))
  WINDOW before AS (PARTITION BY row ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""  # noqa: E731
    base = " UNION ALL ".join(f"SELECT * FROM ({spans(rank, kind, p, g, n)}) WHERE length(g) >= {n}" for rank, (kind, p, g, n) in enumerate(patterns))
    allowed = " OR ".join(f"regexp_matches(said, {quoted(p)})" for p in ALLOWED)
    least = "CASE " + " ".join(f"WHEN regexp_matches(said, {quoted(p)}) THEN {x}" for _, p, x in CLASSES) + " END"
    top = f"list_max(list_transform(range(1, length(said) - {WINDOW - 2}), lambda k: list_entropy(string_split(substr(said, k, {WINDOW}), ''))))"
    digest = "coalesce(string_agg(kind || ':' || start || ':' || (start + length(said)), ',' ORDER BY start, rank){}, '')"
    return f"""WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM {table}),
base AS ({base}),
runs AS ({spans(len(KINDS), "entropy", CANDIDATE, 0, WINDOW)}),
found AS (SELECT * FROM base UNION ALL SELECT * FROM runs r WHERE NOT ({allowed}) AND {top} >= {least}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row = r.row AND b.start < r.start + length(r.said) AND r.start < b.start + length(b.said))),
said AS (SELECT row, {", ".join(f"count(*) FILTER (rank = {rank}) AS n_{kind}" for rank, (kind, *_) in enumerate(KINDS))},
  {digest.format(f" FILTER (rank < {len(KINDS)})")} AS base, {digest.format("")} AS spans FROM found GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, *_ in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN said USING (row)"""
