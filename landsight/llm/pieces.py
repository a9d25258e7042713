"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The vocabulary is read from a public merge-type SentencePiece model; its path is a parameter. A text is the model's
space mark, then the text with spaces turned into that mark. No piece holds a mark after another character (checked when a
model is read), so the text falls into chunks (marks and what follows them) whose merges cannot interact, and each chunk
has its own agenda: the possible merges, best score first, leftmost first among equals. A merge that comes up is skipped if
a keyed hash is under the dropout rate; a skipped merge may be proposed again when a neighbour changes. The hash is keyed by
seed, the document's id, the chunk's ordinal and the candidate's number in the agenda (the chunk and the steps before settle
which merge that is), so each occurrence of a word is cut anew while results depend on nothing but seed, id and text. With
rate 0 the ids are those of the model's own library.

What a worker keeps does not depend on the draw: of a chunk, its cut without skips and how many candidates that takes. If no
skip falls among these, the cut is the result. The other occurrences of a batch run their agendas together, those of one
chunk with the same skips once: one row each in arrays of symbols and of the ranks of adjacent pairs, in which every step
takes each row's best candidate. Long chunks and those with characters outside the vocabulary have a heap each.

Characters outside the vocabulary, and marks that stand in the text itself, become byte pieces, so every text decodes
to itself.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import repeat
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

MARK = "▁"
RATE, SEED = 0.1, 17
#: Chunks kept per worker, and the length from which none is.
KEPT, KEPT_CHARS = 400_000, 24
#: Characters of texts that are encoded together: bounds a worker's memory (a longer text is taken alone).
TOGETHER = 4_000_000
#: Rows of one array of agendas (what a processor's cache holds); fewer chunks of a length than the least have a heap each.
ROWS, LEAST_ROWS = 8_192, 24
#: Candidates past those of the cut without skips whose skips are drawn at once, and the bits that hold a chunk's skips.
AHEAD, SKIP_BITS = 4, KEPT_CHARS + 4
#: Rank of a pair that is no piece.
NEVER = 1 << 30
#: How ids are kept.
ID = np.dtype("<i4")
_CHUNK = re.compile(" +[^ ]*|[^ ]+")


class Vocabulary:
    """Pieces with their scores, byte pieces and the text of each id, from a model file's bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, int] = {}
        self.bytes_at = [0] * 256
        self.text: list[str] = []
        self.byte_of: dict[int, int] = {}  # of bytes that are part of a character only
        scores: dict[str, float] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.text.append(piece.replace(MARK, " "))
            if sp.is_byte(i):
                value = int(piece[1:-1], 16)
                self.bytes_at[value] = i
                if value < 128:
                    self.text[i] = chr(value)
                else:
                    self.byte_of[i] = value
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece.replace(MARK, " ")], scores[piece.replace(MARK, " ")] = i, sp.get_score(i)
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {piece: place[s] for piece, s in scores.items()}
        if 0 in self.bytes_at:
            raise ValueError("the model has no byte pieces: texts would not decode to themselves")
        if any(" " in piece.lstrip(" ") for piece in self.ids):
            raise ValueError("a piece holds a space mark after another character: chunks would not be independent")

    def bytes_of(self, text: str) -> list[int]:
        return [self.bytes_at[b] for b in text.encode()]


def _agenda(chunk: str, score: dict[str, int], skip: Callable[[int, int], int]) -> tuple[list[str], int]:
    """The pieces of a chunk and the number of candidates that came up; skip says by rank and number, from 1, which are skipped."""
    n, turn = len(chunk), 0
    end, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # of the symbol that starts at a place; end 0: merged away
    agenda = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := score.get(chunk[i : i + 2])) is not None]
    heapq.heapify(agenda)
    while agenda:
        rank, a, b, c = heapq.heappop(agenda)
        if end[a] != b or end[b] != c:
            continue
        turn += 1
        if skip(rank, turn):
            continue
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
            if (r := score.get(chunk[a : end[c]])) is not None:
                heapq.heappush(agenda, (r, a, c, end[c]))
        if a and (r := score.get(chunk[before[a] : c])) is not None:
            heapq.heappush(agenda, (r, before[a], a, c))
    out, i = [], 0
    while i < n:
        out.append(chunk[i : end[i]])
        i = end[i]
    return out, turn


_M64, _STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_at(key: int, turn: int) -> int:
    """The keyed hash of a chunk's candidate, as ``_hashes`` gives it."""
    x = key + turn * _STEP & _M64
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & _M64
    x = (x ^ x >> 27) * 0x94D049BB133111EB & _M64
    return x ^ x >> 31


def _hashes(keys: np.ndarray, turn: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(keys + turn.astype(np.uint64) * np.uint64(_STEP))


class Pairs:
    """The pairs of pieces that merge to a piece: an open-addressing table that arrays are looked up in."""

    def __init__(self, v: Vocabulary) -> None:
        self.none = len(v.text)  # no symbol: in no pair
        self.width = self.none + 1
        found = {}
        for piece, rank in v.rank.items():
            for k in range(1, len(piece)):
                if (a := v.ids.get(piece[:k])) is not None and (b := v.ids.get(piece[k:])) is not None:
                    found[a * self.width + b] = (rank, v.ids[piece])
        self.bits = (2 * len(found)).bit_length() + 1
        size = 1 << self.bits
        self.key, self.rank, self.made = np.full(size, -1, np.int64), np.full(size, NEVER, np.int32), np.zeros(size, np.int32)
        keys = np.array([*found], np.int64)
        for key, at, (rank, made) in zip(keys.tolist(), self._slot(keys).tolist(), found.values()):
            while self.key[at] >= 0:
                at = (at + 1) & (size - 1)
            self.key[at], self.rank[at], self.made[at] = key, rank, made
        points = [(ord(p), i) for p, i in v.ids.items() if len(p) == 1]
        self.char = np.full(max((c for c, _ in points), default=128) + 2, self.none, np.int64)
        self.char[:128] = v.bytes_at[:128]  # a byte piece merges with nothing
        for c, i in points:
            self.char[c] = i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(_STEP)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; NEVER where it is none."""
        keys = a * self.width + b
        at = self._slot(keys)
        got = self.key[at]
        rest = np.flatnonzero((got != keys) & (got >= 0))
        while len(rest):
            at[rest] = (at[rest] + 1) & (len(self.key) - 1)
            got = self.key[at[rest]]
            rest = rest[(got != keys[rest]) & (got >= 0)]
        return np.where(self.key[at] == keys, self.rank[at], np.int32(NEVER)), self.made[at]

    def cut(self, chunks: list[str], skip: Callable[[np.ndarray, int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks of one length: the ids of all one after another, how many each has, the candidates that came up in each.

        ``skip`` says of numbers of chunks and a candidate's number, from 1, which are skipped. A chunk with a character
        outside the vocabulary has no ids and -1 candidates.
        """
        parts = [self._cut(chunks[k : k + ROWS], k, skip) for k in range(0, len(chunks), ROWS)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _cut(self, chunks: list[str], first: int, skip: Callable[[np.ndarray, int], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, size = len(chunks), len(chunks[0])
        wide = size + 2  # every row stands between two places without a symbol
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(n, size)
        symbols = np.full((n, wide), self.none, np.int64)
        symbols[:, 1:-1] = self.char[np.minimum(points, len(self.char) - 1)]
        strange = (symbols[:, 1:-1] == self.none).any(1)
        symbols[strange] = self.none
        turns = np.where(strange, -1, 0)
        ranks, made = np.full((n, wide), NEVER, np.int32), np.zeros((n, wide), np.int32)
        s, r, m = symbols.ravel(), ranks.ravel(), made.ravel()
        after = np.arange(1, n * wide + 1)  # the symbols beside each one
        before = after - 2
        if size > 1:
            ranks[:, 1:-2], made[:, 1:-2] = (x.reshape(n, size - 1) for x in self.find(symbols[:, 1:-2].ravel(), symbols[:, 2:-1].ravel()))
        live, turn = np.flatnonzero(~strange), 0
        while len(live):
            at = ranks[live].argmin(1) + live * wide
            some = r[at] < NEVER
            live, at, turn = live[some], at[some], turn + 1
            turns[live] = turn
            if skip is not None:
                skipped = skip(live + first, turn)
                r[at[skipped]] = NEVER
                at = at[~skipped]
            gone = after[at]
            nxt = after[gone]
            s[at], s[gone], r[gone] = m[at], self.none, NEVER
            after[at], before[nxt] = nxt, at
            left, right = np.concatenate((before[at], at)), np.concatenate((at, nxt))
            r[left], m[left] = self.find(s[left], s[right])
        kept = symbols != self.none
        return symbols[kept].astype(ID), kept.sum(1), turns


class Encoder:
    """Encodes and decodes texts; keeps the cuts without skips of short chunks. A chunk is named by what follows its first space."""

    def __init__(self, model: bytes, rate: float = RATE, seed: int = SEED) -> None:
        if not 0 <= rate < 1:
            raise ValueError("the dropout rate is at least 0 and under 1")
        self.vocabulary, self.seed, self.limit = Vocabulary(model), seed, int(rate * (1 << 64))
        self.pairs = Pairs(self.vocabulary)
        self.mark = np.array(self.vocabulary.bytes_of(MARK), ID)
        self._forget()

    def _forget(self) -> None:
        """Keeps nothing but an empty cut, number 0."""
        self.number: dict[str, int] = {}
        self.ids, self.start, self.count, self.steps = np.zeros(0, ID), *(np.zeros(1, np.int64) for _ in range(3))

    def _coded(self, parts: list[str]) -> np.ndarray:
        v = self.vocabulary
        out: list[int] = []
        for p in parts:
            i = v.ids.get(p)
            out += v.bytes_of(p) if i is None else (i,)
        return np.array(out, ID)

    def hashed(self, chunk: str, key: int) -> np.ndarray:
        """Ids of one whole chunk, its skips hashed one by one."""
        return self._coded(_agenda(chunk, self.vocabulary.rank, lambda _, turn: _hash_at(key, turn) < self.limit)[0])

    def _learn(self, names: list[str]) -> None:
        """Keeps the cuts without skips of the chunks of these names, none of which is kept yet."""
        by: dict[int, list[str]] = {}
        for name in names:
            by.setdefault(len(name), []).append(name)
        order, ids, counts, steps = [], [self.ids], [], []
        for group in by.values():
            flat, n, turns = self.pairs.cut([" " + name for name in group])
            known = turns >= 0
            ids.append(flat)
            counts.append(n[known])
            steps.append(turns[known])
            order += group if known.all() else [x for x, ok in zip(group, known) if ok]
            for k in np.flatnonzero(~known):
                parts, n = _agenda(" " + group[k], self.vocabulary.rank, lambda _, turn: 0)
                ids.append(self._coded(parts))
                counts.append([len(ids[-1])])
                steps.append([n])
                order.append(group[k])
        first = len(self.start)
        count = np.concatenate(counts)
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(count) - count))
        self.count, self.steps, self.ids = np.concatenate((self.count, count)), np.concatenate((self.steps, *steps)), np.concatenate(ids)
        self.number.update(zip(order, range(first, first + len(order))))

    def _named(self, text: str) -> Iterator[tuple[str | None, str | None]]:
        """The items of a text in order: (name of a chunk, None), or (None, a chunk without a space), or (None, None) for a mark."""
        for k, part in enumerate(text.split(MARK)):
            if k:
                yield None, None
                first = _CHUNK.match(part)
                if first and first[0][0] != " ":
                    yield None, first[0]
                    part = part[first.end() :]
                if not part:
                    continue
            else:
                part = " " + part
            for c in _CHUNK.findall(part):
                yield c[1:], None

    def encode(self, texts: list[str | None], docs: list[Any]) -> list[np.ndarray]:
        """Ids of each text; none for a null or empty one. docs: the ids that the skips are keyed by."""
        if len(self.number) > KEPT:
            self._forget()
        names: list[str | None] = []  # of all texts; None: an item of its own sort
        bare: dict[int, str | None] = {}
        edges, states = [0], []
        for text, doc in zip(texts, docs):
            states.append(xxhash.xxh64_intdigest(f"doc:{doc}", self.seed))
            if text and MARK in text:
                for name, chunk in self._named(text):
                    if name is None:
                        bare[len(names)] = chunk
                    names.append(name)
            elif text:
                names += [c[1:] for c in _CHUNK.findall(" " + text)] if "  " in text or text[0] == " " else text.split(" ")
            edges.append(len(names))
        n, bounds = len(names), np.array(edges, np.int64)
        sizes = np.diff(bounds)
        with np.errstate(over="ignore"):
            keys = _mixed(np.repeat(np.array(states, np.uint64), sizes) + (np.arange(n) - np.repeat(bounds[:-1], sizes)).astype(np.uint64))
        got = np.fromiter(map(self.number.get, names, repeat(0)), np.int64, n)
        lacking = np.flatnonzero(got == 0).tolist()
        if new := dict.fromkeys(x for k in lacking if (x := names[k]) is not None and len(x) < KEPT_CHARS):
            self._learn([*new])
        alone: dict[int, np.ndarray] = {}
        for k in lacking:
            if (name := names[k]) is None:
                alone[k] = self.mark if bare[k] is None else self.hashed(bare[k], int(keys[k]))
            elif len(name) < KEPT_CHARS:
                got[k] = self.number[name]
            else:
                alone[k] = self.hashed(" " + name, int(keys[k]))
        start, count = self.start[got], self.count[got]
        pool = [self.ids]
        if self.limit:
            self._skip(names, keys, got, start, count, pool, alone)
        at = sum(map(len, pool))
        for k, ids in alone.items():
            start[k], count[k] = at, len(ids)
            at += len(ids)
        end = np.cumsum(count)
        where = np.repeat(start - end + count, count) + np.arange(end[-1] if n else 0)
        whole = np.concatenate((*pool, *alone.values()))[where]
        cuts = np.concatenate(([0], end))[bounds].tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]

    def _skip(self, names: list, keys: np.ndarray, got: np.ndarray, start: np.ndarray, count: np.ndarray, pool: list[np.ndarray], alone: dict[int, np.ndarray]) -> None:
        """Draws the skips of all chunks; the cuts of those that have any go to the pool (or stand alone), their places to start and count."""
        limit, steps, bits = np.uint64(self.limit), self.steps[got], np.zeros(len(got), np.int64)
        rows, turn = np.flatnonzero(steps), 0
        while len(rows):
            hit = rows[_hashes(keys[rows], np.full(1, turn + 1)) < limit]
            bits[hit] |= 1 << turn
            turn += 1
            rows = rows[steps[rows] > turn]
        some = np.flatnonzero(bits)
        for k in range(AHEAD):
            turns = steps[some] + k
            bits[some] |= (_hashes(keys[some], turns + 1) < limit).astype(np.int64) << turns
        # Occurrences of a chunk that skip the same candidates share a cut.
        _, heads, owner = np.unique(got[some] << SKIP_BITS | bits[some], return_index=True, return_inverse=True)
        heads = some[heads]
        skips, drawn = bits[heads], steps[heads] + AHEAD
        wanted = [" " + names[k] for k in heads.tolist()]
        lengths = np.fromiter(map(len, wanted), np.int64, len(wanted))
        place, size, short = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64), np.ones(len(heads), bool)
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(group) < LEAST_ROWS:
                continue

            def skip(k: np.ndarray, turn: int, own: np.ndarray = group) -> np.ndarray:
                k = own[k]
                return (drawn[k] >= turn) & (skips[k] >> min(turn - 1, 62) & 1 > 0)

            flat, n, turns = self.pairs.cut([wanted[k] for k in group.tolist()], skip)
            place[group] = sum(map(len, pool)) + np.cumsum(n) - n
            size[group], short[group] = n, (turns < 0) | (turns > drawn[group])
            pool.append(flat)
        start[some], count[some] = place[owner], size[owner]
        for k in some[short[owner]].tolist():
            alone[k] = self.hashed(" " + names[k], int(keys[k]))

    def decode(self, ids: list[int]) -> str:
        """The text of ids that ``encode`` made."""
        v = self.vocabulary
        if v.byte_of.keys().isdisjoint(ids):
            return "".join(map(v.text.__getitem__, ids))[1:]
        out, raw = [], bytearray()
        for i in ids:
            if (b := v.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(v.text[i])
        if raw:
            out.append(raw.decode(errors="replace"))
        return "".join(out)[1:]


@cache
def _encoder(model: bytes, rate: float, seed: int) -> Encoder:
    """One per worker process: what it keeps outlives a task."""
    return Encoder(model, rate, seed)


def _together(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t or "") > TOGETHER:
            yield at, k
            at, size = k, 0
        size += len(t or "")
    if texts:
        yield at, len(texts)


def model_bytes(path: str) -> bytes:
    """A model file, read by the driver; the executors get its bytes, of at most some megabytes."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE, seed: int = SEED) -> DataFrame:
    """(id, n_tokens, ids, lossless): one row per row of docs; lossless says that the ids decode to the whole text.

    A null text counts as empty and has no ids. Ids may be null (all draw the same skips) or repeated. Other columns
    of docs are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(model_bytes(model_path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(model.value, rate, seed)
        for b in batches:
            sizes, whole, flat = [0], [], []
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for at, to in _together(texts):
                gc.disable()  # many small objects, none in a cycle
                try:
                    coded = e.encode(texts[at:to], names[at:to])
                finally:
                    gc.enable()
                for t, ids in zip(texts[at:to], coded):
                    whole.append(e.decode(ids.tolist()) == (t or ""))
                    flat.append(ids)
                    sizes.append(sizes[-1] + len(ids))
                del coded
            ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))
            counts = pa.array(np.diff(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), counts, ids, pa.array(whole, pa.bool_())], [id_col, "n_tokens", "ids", "lossless"])

    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(rows, f"`{id_col}` {kind}, n_tokens bigint, ids array<int>, lossless boolean")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded rows. Null or no ids give the empty text."""
    spark = encoded.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(model_bytes(model_path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(model.value, RATE, SEED)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.decode(x.as_py() or []) for x in b.column(1)], pa.string())], [id_col, "text"])

    picked = encoded.select(F.col(f"`{id_col}`"), F.col(f"`{ids_col}`"))
    return picked.mapInArrow(rows, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")
