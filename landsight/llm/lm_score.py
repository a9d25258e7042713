"""Language-model scores by cross-entropy difference.

Two bigram models of the same form, one of the target texts and one of all texts, share one vocabulary: all words of the
corpus (runs of letters, digits, underscores and non-ASCII bytes, as they are spelt, and every other sign that is no space).
As a history every word stands for itself, and the start of a text is another; ``histories`` can join all words but the most
frequent ones into one history, for a coarser model. Smoothing is additive: p(w|h) = (c(h,w) + ADDED) / (c(h) + ADDED * V). The loss of a token thus
is a sum over two events, the word after its history and the history alone, and a document's loss one over its events. Every document is left
out of the counts that score it, from the background's always, from the target's if it is a target text. A document's score
is the mean over its tokens of target loss minus background loss in bits: the lower, the more it is like the target. Against
the uniform model, an event counts only where other documents have it.

The counts are taken over every document and grow with the corpus, so no one holds them. A first pass counts the words. Texts
are then dealt to chunks of some millions of tokens. A chunk sends each of its events once, with how often its texts have it, to the
task that counts a range of events, and gets back in the same order how often all texts have it; no document and no event
travels back. Each text's loss is then summed where the text is, so what is shuffled is the texts once, and the different events of each
chunk: it follows the corpus, however long the texts are and however many ranges there are. Targets, if a broadcast may not hold them,
are joined with ids alone and dealt to the chunks beside the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, bounded_batches, forget, stored, text_of

#: What is added to each count.
ADDED = 0.001
#: Tokens whose events make a partition, and tokens of the texts of a chunk (on the average).
PER_PARTITION, PER_CHUNK = 1 << 22, 1 << 22
#: Bytes of texts that are cut into words together (a longer text is taken alone), and words that a task tallies together.
TOGETHER, TALLIED = 1 << 20, 1 << 22

# Sorts of bytes; 0 white space and control, 1 of words, 2 signs.
_SORT = np.array([1 if b >= 128 or chr(b).isalnum() or b == 95 else 0 if b <= 32 or b == 127 else 2 for b in range(256)], np.uint8)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_START, _RARE = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC949D7C7509E6557)  # histories


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the rolling hash's base and of its inverse, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)))) for b in (_BASE, _INVERSE))
        return self.up, self.down


_powers = Powers()


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after another, and how many each text has."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sort = _SORT[raw]
    word, sign = sort == 1, sort == 2
    other = ~word
    starts = np.flatnonzero(sign | word & np.concatenate(([True], other[:-1])))
    ends = np.flatnonzero(sign | word & np.concatenate((other[1:], [True]))) + 1
    up, down = _powers.to(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])))
        hashes = _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    edges = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
    return hashes, np.diff(np.searchsorted(starts, edges), prepend=0)


def alone(histories: np.ndarray) -> np.ndarray:
    """Events of histories: odd numbers."""
    return (_mixed(histories ^ _START) | np.uint64(1)).view(np.int64)


def after(histories: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Events of words after their histories: even numbers."""
    with np.errstate(over="ignore"):
        return (_mixed(histories * np.uint64(0x9E3779B97F4A7C15) + words) & ~np.uint64(1)).view(np.int64)


def histories_of(words: np.ndarray, sizes: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """The history of each word: the word before, or the joint one unless that is among the sorted ``own`` ones; at a text's start that of starts."""
    before = words if own is None else np.where(_places(own, words) >= 0, words, _RARE)
    out = np.concatenate((np.full(1, _START), before[:-1])) if len(words) else words
    ends = np.cumsum(sizes)
    out[(ends - sizes)[sizes > 0]] = _START
    return out


def _places(known: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The place of each number among the sorted known ones, -1 for others."""
    if not len(known):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(known, found), len(known) - 1)
    return np.where(known[at] == found, at, -1)


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > TOGETHER:
            yield at, k
            at, size = k, 0
        size += len(t)
    if texts:
        yield at, len(texts)


def _as_bytes(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary() if column.type == pa.string() else pa.large_binary()).to_pylist()


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(number, n): how often each word occurs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def tally() -> Iterator[pa.RecordBatch]:
            found, n = np.unique(np.concatenate(held), return_counts=True)
            for k in range(0, len(found), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(found[part].view(np.int64)), pa.array(n[part])], ["number", "n"])

        for b in batches:
            texts = _as_bytes(b.column(0))
            for at, to in _blocks(texts):
                held.append(words_of(texts[at:to])[0])
                size += len(held[-1])
                if size >= TALLIED:
                    yield from tally()
                    held.clear()
                    size = 0
        if held:
            yield from tally()

    return docs.select(text).mapInArrow(rows, "number bigint, n bigint").groupBy("number").agg(F.sum("n").alias("n"))


def _events_of(words: np.ndarray, sizes: np.ndarray, own: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its events and how often it has each."""
    histories = histories_of(words, sizes, own)
    both = np.stack((after(histories, words), alone(histories)))
    at = 0
    for n in sizes.tolist():
        yield np.unique(both[:, at : at + n].ravel(), return_counts=True)
        at += n


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: what they have in common is then easily compressed."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _numbers(data: bytes, n: int, kind: type | None = None) -> np.ndarray:
    """What ``_planes`` was given; without a kind, unsigned numbers of as many bytes as there are."""
    flat = np.frombuffer(data, np.uint8).reshape(-1, n).T
    return np.ascontiguousarray(flat).view(kind or f"u{flat.shape[1]}").ravel()


def _least(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def packed(event: np.ndarray, doc: np.ndarray, n: np.ndarray, keys: np.ndarray, flags: np.ndarray, parts: int) -> Iterator[tuple]:
    """(part, size, event, n, doc, keys, flags): a row for each of ``parts`` ranges of events, which are sent by their differences.

    doc: of each event the place of its document among keys and flags.
    """
    order = np.argsort(event.view(np.uint64))
    event, doc, n = event.view(np.uint64)[order], doc[order], n[order]
    part = part_of(event, parts)
    at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else []
    for k, to in zip(at, [*at[1:], len(part)]):
        met, place = np.unique(doc[k:to], return_inverse=True)
        yield int(part[k]), int(to - k), _planes(np.diff(event[k:to], prepend=np.uint64(0))), _planes(_least(n[k:to])), _planes(_least(place)), _planes(keys[met]), flags[met].tobytes()


def part_of(event: np.ndarray, parts: int) -> np.ndarray:
    """The range, one of ``parts``, that each unsigned event is in."""
    return ((event >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def unpacked(size: int, event: bytes, n: bytes, doc: bytes, keys: bytes, flags: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(event, n, in_target, key) of a row of ``packed``."""
    place, n = _numbers(doc, size), _numbers(n, size).astype(np.int64)
    target = np.frombuffer(flags, bool)
    return np.cumsum(_numbers(event, size, np.uint64), dtype=np.uint64).view(np.int64), n, np.where(target[place], n, 0), _numbers(keys, len(target), np.int64)[place]


def _pressed(data: bytes) -> bytes:
    """Fewer bytes than the shuffle's own compression makes of these, which knows repetitions only."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpressed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _summed(events: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different events, and the sums of their numbers."""
    event, n = np.concatenate(events), np.concatenate(n)
    if not len(event):
        return event, n
    order = np.argsort(event)
    event, n = event[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], event[1:] != event[:-1])))
    return event[first], np.add.reduceat(n, first)


def _chunk(table: pa.Table) -> pa.Table:
    """The texts of a chunk. A row without a text says that those of its id are target texts."""
    no_text = pc.is_null(table["text"])
    marked, table = table.filter(no_text)["id"], table.filter(pc.invert(no_text))
    if not len(marked):
        return table
    return table.set_column(table.schema.get_field_index("inside"), "inside", pc.is_in(table["id"], value_set=marked.combine_chunks()))


def _texts(table: pa.Table) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Blocks of a chunk's texts, which of these are target texts, and how many rows each stands for."""
    for b in table.select(["text", "inside", "copies"]).to_batches():
        texts, inside, copies = _as_bytes(b.column(0)), *(b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        for at, to in _blocks(texts):
            yield texts[at:to], inside[at:to].astype(bool), copies[at:to]


def chunk_events(dealt: DataFrame, own: np.ndarray | None, parts: int) -> DataFrame:
    """The different events of each chunk as ``packed`` has them; for documents there are two of one key, the chunk: its other texts and its target texts."""
    sent = dealt.sparkSession.sparkContext.broadcast(own)
    names, kinds = ["part", "size", "event", "n", "doc", "keys", "flags"], [pa.int32(), pa.int32(), *[pa.binary()] * 5]

    def rows(table: pa.Table) -> pa.Table:
        held: tuple[list, list] = ([], [])
        for texts, inside, copies in _texts(_chunk(table)):
            words, sizes = words_of(texts)
            histories, of_target = histories_of(words, sizes, sent.value), np.repeat(inside, sizes)
            both, times = np.stack((after(histories, words), alone(histories))), np.repeat(copies, sizes)
            for k in (0, 1):
                event, n = both[:, of_target == k], times[of_target == k]
                held[k].append(np.unique(event.ravel(), return_counts=True) if (n == 1).all() else _summed([*event], [n, n]))
        each = [_summed(*zip(*h)) for h in held]
        held[0].clear(), held[1].clear()
        event, n = (np.concatenate(x) for x in zip(*each))
        doc = np.repeat(np.arange(2), [len(x) for x, _ in each])
        found = [(*r[:2], *map(_pressed, r[2:])) for r in packed(event, doc, n, np.full(2, table["chunk"][0].as_py()), np.array([False, True]), parts)]
        return pa.table([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names)

    return dealt.groupBy("chunk").applyInArrow(rows, "part int, size int, event binary, n binary, doc binary, keys binary, flags binary")


TOTALS = ["chunk", "part", "size", "n", "in_target"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For whole ranges, sorted: to each chunk, of its different events of a range in their order, how often all texts and the target texts have them."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and row["part"] != held[0]["part"]:
                yield from _counts(held)
                held = []
            held.append(row)
    if held:
        yield from _counts(held)


def _counts(held: list[dict]) -> Iterator[pa.RecordBatch]:
    part, ends = held[0]["part"], np.cumsum([r["size"] for r in held])
    event, n, t, chunk = (np.concatenate(x) for x in zip(*(unpacked(r["size"], *(_unpressed(r[x]) for x in ("event", "n", "doc", "keys", "flags"))) for r in held)))
    held.clear()
    new = np.concatenate(([True], event[1:] != event[:-1]))  # the first of the two that a chunk may have of an event
    new[ends[:-1]] = True
    order = np.argsort(event)
    first = np.concatenate(([True], event[order[1:]] != event[order[:-1]]))
    group = np.empty(len(event), np.int64)
    group[order] = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    sums, found = [np.add.reduceat(x[order], at) for x in (n, t)], []
    for begin, end in zip([0, *ends[:-1]], ends):
        mine = group[begin:end][new[begin:end]]
        found.append((int(chunk[begin]), part, len(mine), *(_pressed(_planes(_least(x[mine]))) for x in sums)))
    for k in range(0, len(found), 1 << 10):
        columns = zip(*found[k : k + (1 << 10)])
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], TOTALS)


def change(events: np.ndarray, others: np.ndarray, vocabulary: int) -> np.ndarray:
    """Bits that one occurrence of an event adds to the loss of the uniform model, if other documents have it so often."""
    single = (events & 1).astype(bool)
    return np.where(single, 1.0, -1.0) * np.log2(1 + others / (ADDED * np.where(single, max(1, vocabulary), 1)))


def losses(dealt: DataFrame, totals: DataFrame, own: np.ndarray | None, vocabulary: int) -> DataFrame:
    """(id, copies, n_tokens, target_loss, background_loss) of the texts of each chunk, from the totals of its events."""
    sent = dealt.sparkSession.sparkContext.broadcast(own)
    kind = dealt.schema["id"].dataType.simpleString()
    uniform = float(np.log2(max(1, vocabulary)))

    def rows(table: pa.Table, counted: pa.Table) -> pa.Table:
        events, times, sizes, tokens, inside = [], [], [], [], []
        table = _chunk(table)
        for texts, flags, _ in _texts(table):
            words, of_text = words_of(texts)
            each = [*_events_of(words, of_text, sent.value)]
            events.append(np.concatenate([x for x, _ in each]))
            times.append(np.concatenate([_least(n) for _, n in each]))
            sizes.append(np.array([len(x) for x, _ in each], np.int64))
            tokens.append(of_text)
            inside.append(flags)
        n_tokens = np.concatenate(tokens)
        known, place = np.unique(np.concatenate(events).view(np.uint64), return_inverse=True)
        found = sorted(counted.to_pylist(), key=lambda r: r["part"])
        in_all, in_target = (np.concatenate([np.zeros(0, np.int64), *(_numbers(_unpressed(r[x]), r["size"]).astype(np.int64) for r in found)]) for x in ("n", "in_target"))
        if len(in_all) != len(known):
            raise ValueError(f"a chunk had {len(in_all)} events when they were counted and has {len(known)} now: its texts have changed meanwhile")
        del known, found, counted
        sums, at = [], 0
        for event, n, size, flags in zip(events, times, sizes, inside):
            mine, n = place[at : at + len(event)], n.astype(np.int64)
            at += len(event)
            row = np.repeat(np.arange(len(size)), size)
            others = in_target[mine] - np.where(flags[row], n, 0), in_all[mine] - n
            sums.append([np.bincount(row, n * change(event, x, vocabulary), len(size)) for x in others])
        target, background = (np.where(n_tokens > 0, uniform + np.concatenate(x) / np.maximum(n_tokens, 1), 0.0) for x in zip(*sums))
        return pa.table([table["id"], table["copies"], pa.array(n_tokens), pa.array(target), pa.array(background)], ["id", "copies", "n_tokens", "target_loss", "background_loss"])

    return dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(rows, f"id {kind}, copies bigint, n_tokens bigint, target_loss double, background_loss double")


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_targets: int = SENT_ROWS, histories: int | None = None, frequent: int | None = None) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score): one row per row of docs, mean bits a token.

    ``targets`` names the ids of the target texts in a column of the same name (null or repeated ids add nothing). Null and
    empty texts have no tokens and zeros. Ids may be null or repeated; every row is a text of its own, also one that repeats
    another. Without target texts the target model is uniform. Other columns are ignored. ``histories``: how many words are
    histories of their own, the others being one together; None: all. ``frequent`` is for older callers: frequent events are
    counted like all others.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    id_, text = F.col(f"`{id_col}`"), text_of(text_col)

    counts = stored(word_counts(docs.select(text.alias("text")), "text"), "words")
    vocabulary, tokens = counts.agg(F.count("*"), F.sum("n")).first()
    tokens = tokens or 0
    own = None
    if histories is not None:
        own = np.sort(counts.orderBy(F.desc("n"), "number").limit(histories).select("number").toPandas()["number"].to_numpy(np.int64).view(np.uint64))
    forget(counts)

    at_least = spark.sparkContext.defaultParallelism
    parts, chunks = (max(at_least, -(-tokens // n)) for n in (PER_PARTITION, PER_CHUNK))
    marks = stored(targets.select(id_.alias("marked")).where("marked is not null").distinct(), "targets")
    picked = docs.select(F.pmod(F.xxhash64(id_, text), F.lit(chunks)).cast("int").alias("chunk"), id_.alias("id"), text.alias("text"))
    if marks.limit(sent_targets + 1).count() <= sent_targets:
        flagged = picked.join(F.broadcast(marks), F.col("id") == F.col("marked"), "left").select("chunk", "id", "text", F.col("marked").isNotNull().alias("inside"))
    else:
        told = picked.select("chunk", "id").join(marks.hint("merge"), F.col("id") == F.col("marked")).select("chunk", "id").distinct()
        flagged = picked.withColumn("inside", F.lit(False)).union(told.select("chunk", "id", F.lit(None).cast("string"), F.lit(True)))
    # Both uses of the dealt texts read one shuffle. Rows of one id and one text come to one chunk, as a row and a number.
    dealt = flagged.repartitionById(chunks, F.col("chunk")).groupBy("chunk", "id", "text").agg(F.max("inside").alias("inside"), F.count("*").alias("copies"))
    events = chunk_events(dealt, own, parts).repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    totals = events.mapInArrow(_counted, "chunk int, part int, size int, n binary, in_target binary").repartitionById(chunks, F.col("chunk"))
    out = losses(dealt, totals, own, vocabulary).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    out = stored(out.select(F.col("id").alias(id_col), "n_tokens", "target_loss", "background_loss"), "scores")
    forget(marks)
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
