"""Packing tokenised documents into sequences by patterns.

The histogram of piece lengths has as many cells as a sequence has tokens, whatever the
corpus, so the plan is made on the driver: patterns of two and three lengths that fill a
sequence exactly are fitted to the histogram by non-negative least squares, their repeat
counts rounded, and what is left is packed by best fit, whole groups of equal bins at a
time. A piece finds its place by its rank among the pieces of its length, which comes from
counts per partition; no piece passes through the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, store
from .common import slices, texts_of

SEQUENCE = 1024
END = 2
VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json, several times faster; the added tokens are only in the JSON
LONGEST_SPACE = 100_000  # tiktoken fails on runs of white space of about a million characters


def library(vocabulary: str = VOCABULARY, added_tokens: bool = True):
    """The JSON of the same name in the tokenizers library, with its defaults; without ``added_tokens`` special strings are ordinary text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(vocabulary.replace(".tiktoken", ".json")))
    whole.encode_special_tokens = not added_tokens
    return whole


def long_space(text: str) -> bool:
    """Whether a run of white space is longer than LONGEST_SPACE."""
    return len(text) > LONGEST_SPACE and any(m.end() - m.start() > LONGEST_SPACE for m in re.finditer(r"\s{2,}", text))


def encoder(vocabulary: str = VOCABULARY, added: tuple[str, ...] = ()):
    """Text to ids; the ``added`` tokens are one id each, all else is ordinary text.

    A text that holds an added token, or a run of white space on which the regex of tiktoken
    would overflow its stack, goes through the library.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    plain = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = cache(lambda: library(vocabulary, bool(added)))  # read for the first text that needs it

    def encode(text: str) -> list[int]:
        if any(token in text for token in added) or long_space(text):
            return whole().encode(text, add_special_tokens=False).ids
        return plain(text)

    return encode


def cuts(n: int, limit: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, and a shorter first one if they do not come out even."""
    start, length = 0, n % limit or min(n, limit)
    while start < n:
        yield start, length
        start, length = start + length, limit


def _pieces(limit: int, vocabulary: str, added: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, added)
        part = TaskContext.get().partitionId()
        seen = np.zeros(limit + 1, np.int64)
        for batch in slices(batches):
            out: list[tuple] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.array(encode(text) + [END], "<u4")
                for piece, (start, length) in enumerate(cuts(len(ids), limit)):
                    out.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    return run


def pieces(docs: DataFrame, limit: int = SEQUENCE, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the row's place among those of its length in its partition."""
    added = tuple(t.content for t in library(vocabulary).get_added_tokens_decoder().values()) if added_tokens else ()
    return texts_of(docs, id_col, text_col).mapInArrow(_pieces(limit, vocabulary, added), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long")


def patterns(limit: int, present: np.ndarray) -> np.ndarray:
    """All pairs and triples of present lengths that fill ``limit`` exactly, as rows (a >= b >= c, c = 0 for pairs)."""
    out = []
    for c in range(limit // 3 + 1):
        if c == 0 or present[c]:
            b = np.arange(max(c, 1), (limit - c) // 2 + 1)
            a = limit - c - b
            ok = present[a] & present[b]
            out.append(np.stack([a[ok], b[ok], np.full(ok.sum(), c)], axis=1))
    return np.concatenate(out)


def fit(limit: int, histogram: np.ndarray, rounds: int = 16, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and their fitted repeat counts: min |A x - histogram|, x >= 0, by an active set.

    Starting from the pairs, the patterns that the residual asks for most are let in a few
    dozen at a time; the passive set is solved by conjugate gradients, and patterns that turn
    negative leave it on the way, as in Lawson and Hanson's method.
    """
    rows = patterns(limit, histogram > 0)
    if not len(rows):
        return rows, np.empty(0)
    scale = max(float(histogram.max()), 1.0)
    goal = histogram / scale
    goal[0] = 0.0
    used = (rows > 0).astype(float)

    def forward(some: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.bincount(rows[some].ravel(), (used[some] * x[:, None]).ravel(), limit + 1)

    def back(some: np.ndarray, r: np.ndarray) -> np.ndarray:
        return (r[rows[some]] * used[some]).sum(axis=1)

    def solve(some: np.ndarray, x: np.ndarray) -> np.ndarray:
        r = back(some, goal - forward(some, x)) - 1e-9 * x
        p, rr = r.copy(), r @ r
        for _ in range(60):
            if rr < 1e-12:
                break
            q = back(some, forward(some, p)) + 1e-9 * p
            step = rr / (p @ q)
            x, r = x + step * p, r - step * q
            new = r @ r
            p, rr = r + new / rr * p, new
        return x

    everything = np.arange(len(rows))
    active = np.flatnonzero(rows[:, 2] == 0)
    x = np.zeros(len(active))
    for _ in range(rounds):
        for _ in range(6):
            z = solve(active, x)
            low = z <= 0
            if not low.any():
                x = z
                break
            step = np.min(np.where(low, x / np.maximum(x - z, 1e-300), 1.0))
            x = x + min(step, 1.0) * (z - x)
            stay = ~(low & (x <= 1e-9))
            active, x = active[stay], np.maximum(x[stay], 0)
        gain = back(everything, goal - forward(active, x))
        gain[active] = -1
        best = np.argpartition(gain, -min(batch, len(gain)))[-batch:]
        best = best[gain[best] > 1e-4]
        if not len(best):
            break
        active, x = np.concatenate([active, best]), np.concatenate([x, np.zeros(len(best))])
    return rows[active], x * scale


def plan(limit: int, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences; the lengths use up the histogram exactly. At most a few thousand entries."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    if left[limit]:
        out.append(((limit,), int(left[limit])))
        left[limit] = 0
    rows, x = fit(limit, left.astype(float))
    for i in np.argsort(-x, kind="stable"):
        lengths = tuple(int(v) for v in rows[i] if v)
        most = min(int(left[v]) // lengths.count(v) for v in lengths)
        repeats = min(int(round(x[i])), most)
        if repeats > 0:
            out.append((lengths, repeats))
            for v in lengths:
                left[v] -= repeats

    # best fit, longest first, equal bins together: room -> [(lengths, bins)]
    rooms: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(limit + 1)]
    for length in range(limit, 0, -1):
        count, room = int(left[length]), length
        while count and room <= limit:
            moved: list[tuple[tuple[int, ...], int]] = []
            while count and rooms[room]:
                lengths, bins = rooms[room].pop()
                take = min(count, bins)
                if take < bins:
                    rooms[room].append((lengths, bins - take))
                moved.append(((*lengths, length), take))
                count -= take
            rooms[room - length].extend(moved)
            room += 1
        if count:
            each = limit // length
            if count // each:
                rooms[limit - each * length].append(((length,) * each, count // each))
            if count % each:
                rooms[limit - count % each * length].append(((length,) * (count % each), 1))
    return out + [entry for room in rooms for entry in room]


def _slots(limit: int, entries: list[tuple[tuple[int, ...], int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first rank, first sequence and offset of every run of places."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(limit + 1)]
    filled = [0] * (limit + 1)
    sequence = 0
    for lengths, repeats in entries:
        offset = 0
        for length in lengths:
            runs[length].append((filled[length], sequence, offset))
            filled[length] += repeats
            offset += length
        sequence += repeats
    return [tuple(np.array([r[i] for r in run], np.int64) for i in range(3)) for run in runs]


def _placed(slots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths):
                at = np.flatnonzero(lengths == length)
                first, start, place = slots[length]
                run = np.searchsorted(first, ranks[at], "right") - 1
                sequence[at] = start[run] + ranks[at] - first[run]
                offset[at] = place[run]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, limit: int = SEQUENCE, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece.

    A document is its ids and one end id; only documents longer than ``limit`` are cut. A null
    or empty text is the end id alone. Repeated rows and null ids are packed like any other
    row, each with its own pieces. Other columns are ignored; an empty table gives none.
    With ``added_tokens`` the ids are those of the library's defaults: an added token of the
    vocabulary that stands in a text is one id. Without it such a string is ordinary text.
    """
    cut = store(pieces(docs, limit, vocabulary, id_col, text_col, added_tokens), "pieces")
    counts = materialize(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(limit + 1)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # as many rows as a sequence has tokens, at most
        histogram[length] = n
    along = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(counts.select("part", "length", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before")))
    ranked = cut.join(before, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))
    slots = _slots(limit, plan(limit, histogram))
    return ranked.mapInArrow(_placed(slots), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
