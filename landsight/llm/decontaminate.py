"""Benchmark decontamination: rare n-gram seeds join training passages to test items, Smith-Waterman alignment scores them.

The benchmark is taken in blocks of bounded size (``BLOCK_CHARS``); the corpus is read once for each block, so what is
sent to the executors never grows with either table. A block's words are numbered, its n-grams are sorted arrays of numbers.
One pass finds every n-gram that a document shares with an item and the passages around them; of these it keeps the ones
that have enough of the item's words to reach the score whatever their order, which loses nothing. Each n-gram's number of
passages is counted over all documents, and those that are not far more frequent than the item's others are its rare
seeds (``RARE``). Kept passages are aligned to the whole item, also those without a rare seed: copies of an edited text can make
the n-grams that they kept the frequent ones. Passages that repeat within a task are aligned once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import bounded_batches, sendable, stored

SEED_WORDS = 3
#: A block of the benchmark has up to so many characters (a single longer item is a block of its own).
BLOCK_CHARS = 4_000_000
#: A seed occurs in at most so many times the median number of passages of its item's n-grams, and so many more.
RARE = (4, 4)
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the highest possible alignment score from which a document counts as contaminated by an item.
CONTAMINATED = 0.4
#: Alignments that a task keeps for passages that repeat.
KEPT_ALIGNMENTS = 4_096
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores in lower case."""
    return _WORD.findall((text or "").lower())


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with linear gaps: best score, and the half-open range of the passage's words that it spans."""
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    h, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, at, begin = 0, 0, 0
    for x in item:
        diagonal = h[:-1] + np.where(passage == x, MATCH, MISMATCH)
        up = h[1:] + GAP
        cell = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.where(cell == 0, np.arange(1, n + 1), np.where(cell == diagonal, start[:-1], start[1:]))
        lifted = np.concatenate(([0], cell)) + ramp
        top = np.maximum.accumulate(lifted)
        came = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        h = top - ramp
        start = np.where(h == 0, np.arange(n + 1), np.concatenate(([0], origin))[came])
        k = int(h.argmax())
        if h[k] > best:
            best, at, begin = int(h[k]), k, int(start[k])
    return best, begin, at


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_CHARS) -> Iterator[list[tuple]]:
    """The items, ordered by id and text, in lists of bounded size. Null ids and items without words are left out."""
    picked = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    held, size = [], 0
    for id_, text in picked.distinct().orderBy("id", "text").toLocalIterator():
        if words := words_of(text):
            if held and size + len(text) > most:
                yield held
                held, size = [], 0
            held.append((id_, words))
            size += len(text)
    if held:
        yield held


class Block:
    """The items of a block as numbers: their words, and for each length of n-grams the sorted n-grams with the places that have them."""

    def __init__(self, items: list[tuple]) -> None:
        self.number: dict[str, int] = {}
        self.items = [np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int64) for _, words in items]
        self.times = [np.unique(x, return_counts=True) for x in self.items]
        base, first = len(self.number) + 1, 0
        if base**SEED_WORDS >= 1 << 63:
            raise ValueError("a single item has over two million different words")
        self.grams: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = []
        for n in range(1, SEED_WORDS + 1):
            own = [(i, x) for i, x in enumerate(self.items) if len(x) >= n and (n == SEED_WORDS or len(x) == n)]
            if own:
                keys = np.concatenate([self.keys(x, n, base) for _, x in own])
                item = np.concatenate([np.full(len(x) - n + 1, i) for i, x in own])
                place = np.concatenate([np.arange(len(x) - n + 1) for _, x in own])
                order = np.argsort(keys, kind="stable")
                known, start = np.unique(keys[order], return_index=True)
                self.grams.append((n, known, np.append(start, len(keys)), item[order], place[order], first))
                first += len(keys)
        self.base, self.size = base, first

    @staticmethod
    def keys(x: np.ndarray, n: int, base: int) -> np.ndarray:
        """Numbers of the n-grams of numbered words; negative where a word has no number."""
        out = np.zeros(len(x) - n + 1, np.int64)
        for k in range(n):
            part = x[k : len(x) - n + 1 + k]
            out = np.where((out < 0) | (part < 0), -1, out * base + part)
        return out

    def found(self, words: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By item the hits of a text: (place in the text, place in the item, number of the place's n-gram)."""
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for n, known, start, item, place, first in self.grams:
            if len(words) < n:
                continue
            keys = self.keys(words, n, self.base)
            at = np.flatnonzero(keys >= 0)
            slot = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            hit = known[slot] == keys[at]
            for where, k in zip(at[hit].tolist(), slot[hit].tolist()):
                for p in range(start[k], start[k + 1]):
                    hits[item[p]].append((where, int(place[p]), first + p))
        return hits

    def shared(self, item: int, words: np.ndarray) -> int:
        """How many of an item's words a passage has, each as often as both have it."""
        own, times = self.times[item]
        found, counts = np.unique(words[words >= 0], return_counts=True)
        at = np.minimum(np.searchsorted(own, found), len(own) - 1)
        return int(np.minimum(counts, times[at])[own[at] == found].sum())


def _passages(docs: DataFrame, items: list[tuple], id_type: str, least: float) -> DataFrame:
    """(id, item, grams, at, words): for each document and item that share an n-gram, the shared n-grams and the words near them.

    A passage whose words cannot reach the score is left out. Rows without words say how many passages (at) have an n-gram.
    """
    spark: SparkSession = docs.sparkSession
    sent = spark.sparkContext.broadcast(Block(items))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        passages = np.zeros(block.size, np.int64)

        def found(text: str) -> Iterator[tuple[int, list[int], int, list[str]]]:
            words = words_of(text)
            numbers = np.fromiter(map(block.number.get, words, repeat(-1)), np.int64, len(words))
            for i, own in block.found(numbers).items():
                own.sort()
                size = len(block.items[i])
                slack = size // 4 + 2
                spans: list[list] = []
                for at, k, gram in own:
                    low, high = max(0, at - k - slack), min(len(words), at - k + size + slack)
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                        spans[-1][2].add(gram)
                    else:
                        spans.append([low, high, {gram}])
                for low, high, grams in spans:
                    grams = sorted(grams)
                    passages[grams] += 1
                    if block.shared(i, numbers[low:high]) >= least * size:
                        yield int(i), grams, low, words[low:high]

        def batch(kind: pa.DataType, out: list[list]) -> pa.RecordBatch:
            kinds = (kind, pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["id", "item", "grams", "at", "words"])

        kind = None
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            kind = b.schema.field(0).type
            for id_, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in found(text):
                    for to, v in zip(out, (id_, *row)):
                        to.append(v)
            yield batch(kind, out)
        if kind is not None:
            owner = np.concatenate([g[3] for g in block.grams])
            seen = np.flatnonzero(passages)
            for k in range(0, len(seen), 1 << 14):
                part = seen[k : k + (1 << 14)]
                yield batch(kind, [[None] * len(part), owner[part].tolist(), [[g] for g in part.tolist()], passages[part].tolist(), [None] * len(part)])

    return docs.mapInArrow(rows, f"id {id_type}, item int, grams array<int>, at bigint, words array<string>")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", least: float = CONTAMINATED, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item, score, n_seeds, first_word, end_word): documents and the items that they leak, best passage each.

    score is the alignment score divided by that of the whole item unchanged; n_seeds counts the passage's rare n-grams,
    none of which may be left (0). Null and empty texts match nothing, items
    that are null or have no words are left out, repeated items count once, rows that share an id are judged together
    and a null id is an id like others. Equal scores go to the earliest passage. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType.simpleString()
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    result = spark.createDataFrame([], f"id {id_type}, item {item_type}, score double, n_seeds int, first_word bigint, end_word bigint")
    for items in blocks(benchmark, item_col, item_text_col, block_chars):
        passages = stored(_passages(texts, items, id_type, least), "passages")
        result = result.union(_aligned(passages, items, id_type, item_type, least))
    return result.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "n_seeds", "first_word", "end_word")


def rare_seeds(passages: DataFrame) -> set[int]:
    """Gram numbers that are seeds: of each item's grams found in the corpus, those not far above the median of passages.

    At most as many numbers as the benchmark block has n-grams.
    """
    spread = passages.where("words is null").select("item", "at", F.get("grams", F.lit(0)).alias("gram")).groupBy("item", "gram").agg(F.sum("at").alias("df"))
    of_item = W.Window.partitionBy("item")
    kept = spread.withColumn("middle", F.expr("percentile(df, 0.5)").over(of_item)).where(F.col("df") <= RARE[0] * F.col("middle") + RARE[1])
    return {r[0] for r in kept.select("gram").toLocalIterator()}


def _aligned(passages: DataFrame, items: list[tuple], id_type: str, item_type: str, least: float) -> DataFrame:
    sent = passages.sparkSession.sparkContext.broadcast((items, rare_seeds(passages)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seeds = sent.value
        codes: dict[int, tuple[dict, np.ndarray]] = {}
        done: dict[tuple, tuple[int, int, int]] = {}
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for id_, item, grams, at, words in zip(*(c.to_pylist() for c in b.columns)):
                n = sum(g in seeds for g in grams)
                if item not in codes:
                    own = block[item][1]
                    table = {w: k for k, w in enumerate(dict.fromkeys(own))}
                    codes[item] = table, np.array([table[w] for w in own])
                table, coded = codes[item]
                passage = np.array([table.get(w, -1) for w in words])
                key = item, passage.tobytes()
                if key not in done:
                    if len(done) >= KEPT_ALIGNMENTS:
                        done.clear()
                    done[key] = align(coded, passage)
                best, begin, end = done[key]
                for to, v in zip(out, (id_, block[item][0], best / (MATCH * len(coded)), n, at + begin, at + end)):
                    to.append(v)
            kinds = (b.schema.field(0).type, item_arrow, pa.float64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], ["id", "item", "score", "n_seeds", "first_word", "end_word"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    item_arrow = to_arrow_type(_parse_datatype_string(item_type))
    scored = passages.where("words is not null").mapInArrow(rows, f"id {id_type}, item {item_type}, score double, n_seeds int, first_word bigint, end_word bigint")
    best = F.max(F.struct("score", (-F.col("first_word")).alias("back"), "n_seeds", "end_word")).alias("b")
    return scored.where(F.col("score") >= least).groupBy("id", "item").agg(best).select(
        "id", "item", "b.score", "b.n_seeds", (-F.col("b.back")).alias("first_word"), "b.end_word")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """The documents that leak no benchmark item, all columns as they were.

    Each row is judged by its own text: rows that share an id with a leaking one, or that have none, stay if they are clean.
    """
    id_, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    # The id's length ends it, so no two rows of different id or text are hashed from one string.
    own = F.unhex(F.substring(F.sha2(F.concat(F.coalesce(F.concat(F.length(id_), F.lit(":"), id_), F.lit("-")), text), 256), 1, 32))
    rows = docs.select(own.alias("id"), text.alias("text"))
    bad = stored(matches(rows, benchmark, "id", "text", **how).select(F.col("id").alias("__landsight_id")).distinct(), "leaks")
    return docs.join(sendable(bad), own == F.col("__landsight_id"), "left_anti")
