"""Exact top-k by inner product with pivot-table elimination.

Vectors become integer vectors. Distances of every vector to a few dozen pivots are computed once and kept with it: the
pivot table. By the triangle inequality each pivot bounds the distance of a query to a candidate from below by the
difference of their distances to the pivot; the largest such bound limits the inner product from above, since
<q,c> = (|q|^2 + |c|^2 - |q-c|^2) / 2. Candidates are evaluated exactly in the order of their bounds until the bound
falls under the k-th best score, so nothing that could be among the best is passed over.

Candidates lie in chunks of bounded size by nearest pivot, queries in blocks of bounded size, and a task compares one block
with one chunk. Every query brings a floor, its k-th best score in a small sample of the candidates. The ranges of a
chunk's distances bound all its members at once: a query goes only to chunks that can reach its floor. The chunks' results
are merged by a window. Pivots and floors come out of one bounded sample and only affect speed. What reaches the driver is
that sample, and the row counts of the pivots' cells.

Inner products are exact: in doubles where no sum can leave their integers, in integers of any size elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator


import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import bounded_batches, forget, stored

SCALE, PIVOTS, SAMPLE = 1024, 24, 1_024
#: Rows of a chunk of candidates at most (on the average) and at least, how many chunks are wanted, rows of a block of queries.
CHUNK, LEAST_CHUNK, CHUNKS, QUERY_BLOCK = 1 << 16, 1 << 10, 64, 1 << 15
#: Candidates that are evaluated at once, in the order of their bounds.
EVALUATED_AT_ONCE = 256
#: Integers up to here are exact as doubles; scores beyond a long are given as the nearest long.
EXACT, LONG = 1 << 53, (1 << 63) - 1
NO_FLOOR = -(1 << 63)


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def integral(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component, as doubles that hold integers exactly; unusable rows are left out.

    A component whose scaled value is no finite double makes its vector unusable.
    """
    scaled = F.transform(F.col(f"`{vector_col}`"), lambda x: F.lit(float(scale)) * x.cast("double"))
    # floor() of a double is a long in Spark: larger ones are whole numbers as they are.
    v = F.transform(scaled, lambda x: F.when(F.abs(x) < float(EXACT), F.floor(x).cast("double")).otherwise(x))
    rows = df.where(F.col(f"`{id_col}`").isNotNull() & usable(vector_col)).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.alias("v"))
    return rows.where(~F.exists("v", lambda x: F.abs(x) == float("inf")))


def sampled(vectors: DataFrame, size: int = SAMPLE) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and vectors of at most ``size`` rows, drawn by a hash of id and vector."""
    rows = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(size).toPandas()
    return rows["id"].to_numpy(np.int64), [np.array(v, float) for v in rows["v"]]


def choose_pivots(vectors: list[np.ndarray], n: int = PIVOTS) -> np.ndarray:
    """Up to n pivots, farthest first, among vectors of the first one's dimension whose squares are exact."""
    rows = [r for r in vectors if len(r) == len(vectors[0]) and _small(r)]
    if not rows or not len(rows[0]):
        return np.zeros((0, 0))
    x = np.array(rows)
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < min(n, len(x)):
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        if far.max() <= 0:
            break
        chosen.append(int(far.argmax()))
    return x[chosen]


def _small(v: np.ndarray) -> bool:
    """Whether distances to vectors like this one are exact under the root."""
    return bool(np.abs(v).max(initial=0) < np.sqrt(EXACT / 8 / max(1, len(v))))


def pivot_distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors held as doubles; exact, and clamped to the range of a long."""
    if len(q) * np.abs(x).max(initial=0) * np.abs(q).max(initial=0) < EXACT:
        return (x @ q).astype(np.int64)
    whole = [int(b) for b in q.tolist()]
    sums = (sum(int(a) * b for a, b in zip(row, whole)) for row in x.tolist())
    return np.array([min(LONG, max(-LONG, s)) for s in sums], np.int64)


def best_of(q: np.ndarray, qd: np.ndarray, q_id: int, floor: int, x: np.ndarray, xd: np.ndarray, squares: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best scores of one query among candidates and their ids, an id once with its best score; how many were evaluated.

    They are evaluated in bound order until no bound reaches the k-th best score or the floor. No distances, no bounds.
    """
    if xd.shape[1]:
        # The bound is slackened by more than the rounding of the distances.
        low = np.maximum(np.abs(xd - qd).max(1) - 1e-6 * (1 + np.abs(qd).max()), 0)
        high = (squares + (q**2).sum() - low**2) / 2 + 1e-6 * (1 + squares)
        order = np.flatnonzero(high >= floor)
        order = order[np.argsort(-high[order])]
    else:
        high, order = np.full(len(x), np.inf), np.arange(len(x))
    scores, owners, done = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for at in range(0, len(order), EVALUATED_AT_ONCE):
        part = order[at : at + EVALUATED_AT_ONCE]
        if len(scores) >= k and high[part[0]] < scores[k - 1]:
            break
        done += len(part)
        part = part[ids[part] != q_id]
        found = products(x[part], q)
        reach = found >= max(floor, scores[k - 1] if len(scores) >= k else NO_FLOOR)
        scores, owners = np.concatenate((scores, found[reach])), np.concatenate((owners, ids[part][reach]))
        top = np.lexsort((owners, -scores))
        top = top[np.sort(np.unique(owners[top], return_index=True)[1])[:k]]
        scores, owners = scores[top], owners[top]
    return scores, owners, done


def with_pivot_table(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(id, v, d, cell): vectors with their distances to the pivots and the number of the nearest; none and -1 without distances."""
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for b in batches:
            vs = [np.array(v, float) for v in b.column(1).to_pylist()]
            at = [k for k, v in enumerate(vs) if len(p) and len(v) == p.shape[1] and _small(v)]
            out, cells = [[] for _ in vs], np.full(len(vs), -1)
            if at:
                d = pivot_distances(np.array([vs[k] for k in at]), p)
                cells[at] = d.argmin(1)
                for k, row in zip(at, d.tolist()):
                    out[k] = row
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64())), pa.array(cells, pa.int32())], ["id", "v", "d", "cell"])

    return vectors.mapInArrow(rows, "id bigint, v array<double>, d array<double>, cell int")


def with_floors(queries: DataFrame, sample: tuple[np.ndarray, list[np.ndarray]], k: int) -> DataFrame:
    """Queries with the k-th best score that each has in the sample (of other ids, each once); NO_FLOOR for fewer."""
    sent = queries.sparkSession.sparkContext.broadcast(sample)
    schema = queries.schema

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors = sent.value
        by = {n: np.flatnonzero([len(v) == n for v in vectors]) for n in {len(v) for v in vectors}}
        packed = {n: (names[at], np.array([vectors[j] for j in at])) for n, at in by.items()}
        for b in batches:
            floors = []
            for q_id, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist()):
                found = ()
                if len(v) in packed:
                    ids, x = packed[len(v)]
                    found = best_of(np.array(v, float), np.zeros(0), q_id, NO_FLOOR, x, np.zeros((len(x), 0)), np.zeros(0), ids, k)[0]
                floors.append(int(found[k - 1]) if len(found) >= k else NO_FLOOR)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(floors, pa.int64())], [*b.schema.names, "floor"])

    from pyspark.sql.types import LongType, StructField, StructType

    return queries.mapInArrow(rows, StructType([*schema.fields, StructField("floor", LongType())]))


def chunked(table: DataFrame, chunk: int) -> tuple[DataFrame, int]:
    """The table with a number of a chunk for each row, cells kept apart, and how many chunks there are."""
    sizes = {r["cell"]: r["count"] for r in table.groupBy("cell").count().collect()}  # a row for each pivot, and one
    first, number = 0, F.lit(0)
    for cell in sorted(sizes):
        parts = -(-sizes[cell] // chunk)
        number = F.when(F.col("cell") == cell, F.lit(first) + F.pmod(F.col("deal"), F.lit(parts)).cast("int")).otherwise(number)
        first += parts
    return table.withColumn("chunk", number.cast("int")), first


def search(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
           pivots: int = PIVOTS, query_block: int = QUERY_BLOCK, chunk: int = CHUNK, least_chunk: int = LEAST_CHUNK) -> DataFrame:
    """(query_id, rank, id, score): the k candidates of highest integer inner product of every query row; ties to the smaller id.

    ``queries`` is a condition on the id column. Every usable row with another id is a candidate (rows that repeat the
    query's id are the query itself). Rows with a null id or an unusable vector (null, or with a null or non-finite
    component, scaled or not) take no part; vectors of different dimensions are never compared. Repeated rows are
    candidates each, but an id is returned once a query, with its best score. Scores beyond a long are given and ranked as
    the nearest long. An empty table gives an empty result.
    """
    bounded_batches(vectors.sparkSession)
    whole = integral(vectors, id_col, vector_col, scale)
    sample = sampled(whole)
    # Rows are dealt by their place too: an id or vector may repeat without bound.
    table = stored(with_pivot_table(whole, choose_pivots(sample[1], pivots)).withColumn("deal", F.xxhash64("id", F.monotonically_increasing_id())), "pivots")
    rows = table.count()
    size = max(1, min(chunk, max(least_chunk, rows // CHUNKS)))
    candidates, chunks = chunked(table, size)
    wanted = table.withColumnRenamed("id", id_col).where(queries).withColumnRenamed(id_col, "id").select("id", "v", "d").distinct()
    wanted = stored(with_floors(wanted, sample, k), "queries")
    blocks = -(-max(1, wanted.count()) // query_block)
    width = table.agg(F.max(F.size("d"))).first()[0] or 0
    spread = _reaching(wanted.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), _ranges(candidates, width), chunks, width)
    dealt = candidates.select("id", "v", "d", "chunk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    found = spread.groupBy("block", "chunk").cogroup(dealt.groupBy("block", "chunk")).applyInPandas(_compare(k), "query bigint, id bigint, score bigint")
    top = stored(found.groupBy("query", "id").agg(F.max("score").alias("score")), "found")
    forget(table, wanted)
    rank = F.row_number().over(W.Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id")))
    top = top.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return top.select(F.col("query").alias("query_id"), "rank", F.col("id").alias(id_col), "score")


def _ranges(candidates: DataFrame, width: int) -> DataFrame:
    """(chunk, low, high, top): of each chunk, the ranges of its distances to the pivots and its largest square; no ranges without distances."""
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    at = lambda p: F.get("d", F.lit(p))
    got = candidates.groupBy("chunk").agg(
        F.array(*(F.min(at(p)) for p in range(width))).alias("low"), F.array(*(F.max(at(p)) for p in range(width))).alias("high"),
        F.max(square).alias("top"), F.min(F.size("d")).alias("known"))
    bare = F.array().cast("array<double>")
    return got.select(F.col("chunk"), *(F.when(F.col("known") > 0, F.col(n)).otherwise(bare).alias(n) for n in ("low", "high")), "top") if width else got.select("chunk", bare.alias("low"), bare.alias("high"), "top")


def _reaching(queries: DataFrame, ranges: DataFrame, chunks: int, width: int) -> DataFrame:
    """Queries by the chunks that may hold a candidate of theirs: those whose ranges let the bound reach the query's floor."""
    spread = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(max(0, chunks - 1))))).join(ranges, "chunk")
    gaps = F.zip_with(F.zip_with("d", "low", lambda d, low: F.struct(d.alias("d"), low.alias("low"))), "high", lambda x, high: F.greatest(x["low"] - x["d"], x["d"] - high, F.lit(0.0)))
    low = F.greatest(F.array_max(gaps) - F.lit(1e-6) * (F.lit(1.0) + F.array_max("d")), F.lit(0.0))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    bound = (F.col("top") + square - low * low) / 2 + F.lit(1e-6) * (F.lit(1.0) + F.col("top"))
    bounded = (F.size("d") > 0) & (F.size("low") > 0)
    return spread.where(~bounded | (bound >= F.col("floor").cast("double"))).select("id", "v", "d", "floor", "block", "chunk")


def _compare(k: int):
    """The comparison of one block of queries with one chunk of candidates."""

    def arrays(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, vectors and distances by dimension and number of distances."""
        sizes = pd.DataFrame({"v": pdf["v"].map(len), "d": pdf["d"].map(len)})
        for (_, n), at in sizes.groupby(["v", "d"]).indices.items():
            yield pdf["id"].to_numpy(np.int64)[at], np.array([*pdf["v"].iloc[at]], float), np.array([*pdf["d"].iloc[at]], float).reshape(len(at), n)

    def compared(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        groups = [(ids, x, d, (x**2).sum(1)) for ids, x, d in arrays(candidates)] if len(queries) else []
        for q_id, v, qd, floor in zip(queries["id"], queries["v"], queries["d"], queries["floor"]):
            q = np.asarray(v, float)
            for ids, x, d, squares in groups:
                if x.shape[1] == len(q):
                    known = len(qd) == d.shape[1]
                    scores, owners, _ = best_of(q, np.asarray(qd, float), q_id, floor, x, d if known else d[:, :0], squares, ids, k)
                    out.append((np.full(len(scores), q_id), owners, scores))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("query", "id", "score"), cols)))

    return compared
