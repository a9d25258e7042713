"""SimHash near-duplicates: byte-position inverted index with count filtering.

A fingerprint has some positional bytes. Postings are keyed by three byte positions at once, as the scheme's triples name
them. With 8 bytes and up to 3 differing bits (``STRICT``), two fingerprints that link share at least 5 positional bytes, and
so at least 3 of the 24 triples: the four bytes of a half, each way to cut the positions in halves below, hold 4 triples,
and any 5 positions hold 3 of one half. Pairs with fewer shared triples than this guaranteed minimum go unread; the others are
verified by their bits. ``NEAR`` finds texts whose sets of five-word shingles are 0.8 similar or more: such texts differ
in 15 % of the bits of a long fingerprint, and nearly always share one of its triples.

Two rounds. In the first, every member of a posting list is compared with the list's least one, each with the few that it
shares most lists with, which settles dense groups with a few comparisons a member. Components come from rounds of star contraction with each round's edges written
to the shared folder. The second round takes the lists that still hold several components and tallies the shared triples of
pairs from different ones (with ``NEAR``, whose links need share but one, a list's pairs are verified in it); long lists
are dealt into chunks, each pair of chunks a task's group of bounded size that returns a spanning forest of its links. Lists over ``extend_over`` are first split by two more byte positions where the
scheme guarantees these. Equal fingerprints are one node from the start. Nothing is collected to the driver but row counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, forget, stored


@dataclass(frozen=True)
class Scheme:
    """Shingle words, bytes of a fingerprint (a multiple of 8), triples of positions, the least of them that a linked pair shares, differing bits."""

    words: int
    size: int
    triples: tuple[tuple[int, int, int], ...]
    least_shared: int
    max_bits: int
    #: Whether a linked pair shares two more positions than those of a shared triple.
    extends: bool


SEED = 42
#: Ways to cut eight positions in halves of which no two share a triple.
_HALVES = [((0, 1, 2, 3), (4, 5, 6, 7)), ((0, 1, 4, 5), (2, 3, 6, 7)), ((0, 2, 4, 6), (1, 3, 5, 7))]
STRICT = Scheme(3, 8, tuple(t for way in _HALVES for half in way for t in combinations(half, 3)), 3, 3, True)


def spread_triples(size: int, n: int, seed: int = 1) -> tuple[tuple[int, int, int], ...]:
    """n triples of positions that use all positions about equally often."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < n:
        p = rng.permutation(size).tolist()
        out += [tuple(sorted(p[k : k + 3])) for k in range(0, size - 2, 3)]
    return tuple(out[:n])


#: At similarity 0.8 the expected angle gives 77.6 of 512 differing bits, with a standard deviation of 8.
NEAR = Scheme(5, 64, spread_triples(64, 96), 1, 80, False)
#: Least members that a node is compared with in the first round.
COMPARED = 3
#: A text's shingle hashes are tallied so many at a time: bounds memory on very long texts.
TALLY_BLOCK = 1 << 13
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _words_of_hash(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of so many 64-bit words out of 64-bit hashes: the hash itself, then mixes of it."""
    with np.errstate(over="ignore"):
        x = h[:, None] + np.arange(1, words, dtype=np.uint64) * _STEP
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.concatenate((h[:, None], x ^ (x >> np.uint64(31))), 1)


def fingerprint(text: bytes | None, scheme: Scheme = STRICT, seed: int = SEED) -> np.ndarray:
    """The SimHash of a UTF-8 text as 64-bit words; a text without words has zeros.

    Lower-cases A-Z only and splits at ASCII white space. Shingles count as often as they occur; a text of fewer words
    is one shingle. A bit is set if over half of the shingles' hashes have it (the first word's: XXH64).
    """
    w = (text or b"").lower().split()
    if not w:
        return np.zeros(scheme.size // 8, np.int64)
    if len(w) <= scheme.words:
        shingles = [b" ".join(w)]
    else:
        shingles = list(map(b" ".join, zip(*(w[k:] for k in range(scheme.words)))))
    ones = np.zeros(8 * scheme.size, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(shingles), TALLY_BLOCK):
        h = np.array([digest(s, seed) for s in shingles[k : k + TALLY_BLOCK]], np.uint64)
        bits = np.unpackbits(_words_of_hash(h, scheme.size // 8).view(np.uint8), axis=1, bitorder="little")
        for at in range(0, len(bits), 255):  # so many fit a byte's count
            ones += bits[at : at + 255].sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(shingles), bitorder="little").view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = STRICT) -> DataFrame:
    """(id, fp, node): one row per row of docs. Null and empty texts have zeros; a null id stays null.

    fp holds 64-bit words. node names the fingerprint: its one word, or a hash of its words.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary() if b.column(1).type == pa.string() else pa.large_binary())
            fps = [fingerprint(t.as_py(), scheme) for t in texts]
            flat = np.concatenate(fps) if fps else np.zeros(0, np.int64)
            ends = np.arange(len(fps) + 1) * (scheme.size // 8)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["id", "fp"])

    picked = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = picked.mapInArrow(rows, f"id {kind}, fp array<bigint>")
    return found.withColumn("node", F.get("fp", F.lit(0)) if scheme.size == 8 else F.xxhash64("fp"))


def postings(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, node): every node under each of its byte triples."""
    at = np.array(scheme.triples)
    tags = np.arange(len(at), dtype=np.int64) << 24

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, scheme.size // 8).view(np.uint8).astype(np.int64)
            keys = tags + (fp[:, at[:, 0]] << 16) + (fp[:, at[:, 1]] << 8) + fp[:, at[:, 2]]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(b.column(0).to_numpy(), len(at)))], ["key", "node"])

    return nodes.select("node", "fp").mapInArrow(rows, "key bigint, node bigint")


def byte_at(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255))


def extended(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Long lists of one-word fingerprints by two further positions: the key's triple stays, all pairs of other positions are taken."""
    tag = F.shiftrightunsigned("key", 24)
    out = []
    for n, triple in enumerate(scheme.triples):
        ways = [*combinations([k for k in range(scheme.size) if k not in triple], 2)]
        more = [F.shiftleft(F.lit(16 + m).cast("bigint"), 48).bitwiseOR(F.shiftleft(F.col("key"), 16)).bitwiseOR(F.shiftleft(byte_at(F.col("node"), p), 8)).bitwiseOR(byte_at(F.col("node"), q)) for m, (p, q) in enumerate(ways)]
        out.append(F.when(tag == n, F.array(*more)))
    return rows.select("node", "root", F.explode(F.coalesce(*out)).alias("key"))


def differing(one: Column, two: Column, scheme: Scheme) -> Column:
    """In how many bits two arrays of words differ."""
    return reduce(Column.__add__, (F.bit_count(F.get(one, F.lit(k)).bitwiseXOR(F.get(two, F.lit(k)))) for k in range(scheme.size // 8)))


def verified(pairs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) whose fingerprints differ in few enough bits."""
    if scheme.size == 8:
        return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= scheme.max_bits)
    one, two = (nodes.select(F.col("node").alias(n), F.col("fp").alias(f"fp_{n}")) for n in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").where(differing(F.col("fp_a"), F.col("fp_b"), scheme) <= scheme.max_bits).select("a", "b")


def forest(left: np.ndarray, right: np.ndarray, roots: tuple[np.ndarray, np.ndarray], max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links between the rows of two arrays of words that have different roots."""
    close = np.empty((len(left), len(right)), bool)
    for k in range(0, len(left), 64):
        close[k : k + 64] = np.bitwise_count(left[k : k + 64, None] ^ right[None]).sum(2) <= max_bits
    close &= roots[0][:, None] != roots[1][None, :]
    out, waiting, todo = [], close.any(1), np.ones(len(right), bool)
    for root in range(len(left)):
        if waiting[root]:
            waiting[root], ahead = False, [(0, root)]
            while ahead:
                side, at = ahead.pop()
                row, free = (close[at], todo) if side == 0 else (close[:, at], waiting)
                for k in np.flatnonzero(row & free):
                    free[k] = False
                    out.append((at, int(k)) if side == 0 else (int(k), at))
                    ahead.append((1 - side, int(k)))
    return out


def _chunk_links(max_bits: int):
    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        node, root = pdf["node"].to_numpy(np.int64), pdf["root"].to_numpy(np.int64)
        first = pdf["mine"].to_numpy() == i
        second = first if i == j else ~first
        pairs: list[tuple[int, int]] = []
        if first.any() and second.any() and root.min() != root.max():
            fps = np.array([*pdf["fp"]], np.int64).view(np.uint64)
            pairs = forest(fps[first], fps[second], (root[first], root[second]), max_bits)
        at = np.array(pairs, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[first][at[:, 0]], "b": node[second][at[:, 1]]})

    return found


def links(nodes: DataFrame, scheme: Scheme = STRICT, pair_up_to: int = 48, chunk: int = 1024, extend_over: int = 1 << 14) -> tuple[DataFrame, DataFrame]:
    """(node, root) of nodes that the first round linked, and (a, b): further links, between nodes of different roots.

    Together they join what any chain of links joins. nodes: node, fp.
    """
    key = stored(postings(nodes, scheme), "postings")
    sizes = key.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("least")).where("m > 1")
    lists = stored(key.join(sizes, "key"), "lists")
    forget(key)
    # Of the least members of its lists, a node is compared with those that it shares most lists with.
    tally = lists.where("node != least").groupBy("node", "least").agg(F.count("*").alias("shared"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("back"), "least"))), 1, COMPARED)  # of a list for each triple
    star = tally.groupBy("node").agg(best.alias("best")).select(F.explode("best.least").alias("a"), F.col("node").alias("b"))
    near = verified(star, nodes, scheme)
    none = nodes.sparkSession.createDataFrame([], "node bigint, root bigint")
    roots = components(near)
    roots = none if roots is None else stored(roots, "roots")
    tagged = lists.join(roots, "node", "left").select("key", "node", "m", F.coalesce("root", "node").alias("root"))
    mixed = tagged.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    rest = stored(tagged.join(mixed, "key", "left_semi"), "mixed")
    forget(lists)

    def paired(rows: DataFrame) -> DataFrame:
        # Where one shared triple is enough, a list's pairs are verified where they meet, and only links leave it; else they are tallied over all lists.
        at_once = scheme.least_shared == 1
        apart = lambda a, b: (a["node"] < b["node"]) & (a["root"] != b["root"])
        linked = lambda a, b: apart(a, b) & (differing(a["fp"], b["fp"], scheme) <= scheme.max_bits)
        other = lambda a: F.filter("own", lambda b: (linked if at_once else apart)(a, b))
        pairs = F.flatten(F.transform("own", lambda a: F.transform(other(a), lambda b: F.struct(a["node"].alias("a"), b["node"].alias("b")))))
        if at_once:
            rows = rows.join(nodes.select("node", "fp"), "node")
        held = rows.groupBy("key").agg(F.collect_list(F.struct(*(x for x in rows.columns if x in ("node", "root", "fp")))).alias("own"))  # pair_up_to at most
        if at_once:
            return held.select(F.explode(pairs).alias("p")).select("p.a", "p.b")
        tally = held.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("shared"))
        return verified(tally.where(F.col("shared") >= scheme.least_shared).select("a", "b"), nodes, scheme)

    def dealt(rows: DataFrame) -> DataFrame:
        n = F.ceil(F.col("m") / chunk).cast("int")
        mine = F.pmod(F.xxhash64("node"), n).cast("int")
        spread = rows.join(nodes.select("node", "fp"), "node").select("key", "node", "root", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
        spread = spread.select("key", "node", "root", "fp", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
        return spread.groupBy("key", "i", "j").applyInPandas(_chunk_links(scheme.max_bits), "a bigint, b bigint")

    long = F.col("m") > pair_up_to
    over = long & (F.col("m") > extend_over) if scheme.extends else F.lit(False)
    # A pair that shares a long list is verified there, so the tally misses none of a pair that shares short ones only.
    parts = [paired(rest.where(~long))]
    if not rest.where(long & ~over).isEmpty():
        parts.append(dealt(rest.where(long & ~over)))
    if scheme.extends and not rest.where(over).isEmpty():
        more = stored(extended(rest.where(over), scheme), "extended")
        parts.append(dealt(more.join(more.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key")))
    more = stored(reduce(DataFrame.union, parts).distinct(), "links")
    forget(rest)
    return roots, more


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame | None:
    """(node, root) for every node of an edge: root is the least node that it reaches. None if there are no edges.

    Alternating large-star and small-star contraction. A node's least neighbour is an aggregate joined back, so a hub's
    neighbours are split among tasks like any skewed join.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    if now.isEmpty():
        forget(now)
        return None

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u")
        out = moved.where("v > u" if not small else "v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        if small:
            out = out.union(least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = None
    for _ in range(most_rounds):
        after = stored(star(star(now, False), True), "edges")
        forget(now)
        now, sign = after, mark(after)
        if sign == before:
            roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
            tops = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return roots.union(tops)
        before = sign
    raise RuntimeError(f"components not settled in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = STRICT, **sizes: int) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    component_id is the smallest id among all rows reachable by links of at most the scheme's differing bits. Null or empty
    texts share a fingerprint of zeros and link like any other. Rows with a null id take part and get their component's
    smallest id (null if it has none). Repeated rows are all returned. Other columns of docs are ignored. An empty table
    gives an empty result.
    """
    prints = stored(fingerprints(docs, id_col, text_col, scheme), "prints")
    nodes = stored(prints.groupBy("node").agg(F.first("fp").alias("fp"), F.min("id").alias("first")), "nodes")
    roots, more = links(nodes, scheme, **sizes)
    rooted = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    top = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    last = components(more.join(top[0], "a", "left").join(top[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    if last is not None:
        rooted = rooted.join(last.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left").select("node", "first", F.coalesce("last", "root").alias("root"))
    rooted = stored(rooted, "rooted")
    owner = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id")
    whole = F.concat_ws("", F.transform("fp", lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))))
    return prints.join(owner, "node").select(F.col("id").alias(id_col), whole.alias("fingerprint"), "component_id")
