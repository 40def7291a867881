"""Language-model scores by deleted interpolation.

Words are scored by a mixture of a bigram, a unigram and a uniform estimate. The maximum
likelihood estimates come from counts over all training texts; the weights depend on how
often the context was seen, in powers of two, and are learned by expectation maximisation
on the texts of a deleted part, against the counts of the others. The final scores then
use the counts of both parts.

The corpus becomes a table of blocks of tokens. A block asks for the counts of its own
distinct n-grams, whose hashes are dealt to buckets; a bucket adds up what all blocks have
counted and answers each block. So a frequent n-gram travels once per block, not once per
place, whatever its share of the corpus. Hashes have 64 bits.

Blocks and buckets grow with the square root of the corpus, so the messages between them
grow with the corpus and not with its square, and each carries some MESSAGE n-grams. Where
tasks can hold no larger ones, from some 40 GB of text on, messages get shorter instead, in
the end down to one n-gram, which is what a plain count by n-gram ships.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import new_folder
from .bbit_minhash import _mixed
from .common import slices, texts_of, words_of

HELD_OUT = (7, 2)  # crc32 of the id as text, modulo the first, is the second: never learned from
DELETED = 10  # of the training texts, one in so many is the deleted part that the weights are learned on
MESSAGE = 2_000  # n-grams that a block asks of a bucket, about
BLOCK = (200_000, 1_500_000)  # least and most tokens of a block; a longer text is a block of its own
BUCKET = (200_000, 4_000_000)  # least and most n-grams of a bucket
BYTES_PER_TOKEN = 6  # for the sizes only
LEVELS = 48  # context frequencies, in powers of two
STEPS = 96  # estimates in the summary of the deleted part, in half powers of two

END = xxhash.xxh3_64_intdigest(b"\n")  # no word holds a line break
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def part_of(doc_id: int | None) -> int:
    """0: counts, 1: deleted part, 2: held out. A null id counts as the empty text."""
    code = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if code % HELD_OUT[0] == HELD_OUT[1]:
        return 2
    return int(code // HELD_OUT[0] % DELETED == 0)


class _Block:
    def __init__(self) -> None:
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.tokens: list[int] = []
        self.words: dict[bytes, int] = {b"\n": 0}
        self.hashes: list[int] = [END]

    def add(self, doc: int | None, words: list[bytes]) -> None:
        known, tokens = self.words, self.tokens
        for w in words:
            at = known.get(w)
            if at is None:
                at = known[w] = len(known)
                self.hashes.append(xxhash.xxh3_64_intdigest(w))
            tokens.append(at)
        tokens.append(0)
        self.docs.append(doc)
        self.lengths.append(len(words) + 1)

    def row(self, block: int, part: int) -> pa.RecordBatch:
        # frequent words get small numbers, the end keeps 0
        tokens, hashes = np.array(self.tokens, np.int64), np.array(self.hashes, np.uint64)
        order = np.r_[0, 1 + np.argsort(-np.bincount(tokens, minlength=len(hashes))[1:], kind="stable")]
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        as_bytes = lambda v: pa.array([_packed(v)], pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([self.docs], pa.list_(pa.int64())), pa.array([len(tokens)], pa.int64()),
             as_bytes(np.array(self.lengths)), as_bytes(hashes[order]), as_bytes(number[tokens])],
            ["block", "part", "docs", "n_tokens", "lengths", "hashes", "tokens"],
        )


BLOCKS = "block long, part int, docs array<long>, n_tokens long, lengths binary, hashes binary, tokens binary"


def sizes(tokens: int) -> tuple[int, int]:
    """Tokens of a block and n-grams of a bucket for a corpus of so many tokens."""
    clip = lambda x, ends: int(min(max(x, ends[0]), ends[1]))
    block = clip((MESSAGE * tokens) ** 0.5, BLOCK)
    return block, clip(MESSAGE * tokens / block, BUCKET)


def _blocks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        open_ = [_Block() for _ in range(3)]
        for batch in slices(batches):
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                part = part_of(doc)
                open_[part].add(doc, words_of(text))
                if len(open_[part].tokens) >= size:
                    yield open_[part].row(first + made, part)
                    made, open_[part] = made + 1, _Block()
        for part, block in enumerate(open_):
            if block.docs:
                yield block.row(first + made, part)
                made += 1

    return run


class _Grams:
    """The n-grams of a block: unigrams by word, bigrams by token; the context of a first word is the end."""

    def __init__(self, hashes: bytes, tokens: bytes) -> None:
        words = _unpacked(hashes)
        self.tokens = _unpacked(tokens).astype(np.int64)
        self.before = np.r_[0, self.tokens[:-1]]
        codes = _mixed(words)
        pairs = _mixed(codes[self.before] * _PAIR + codes[self.tokens])
        self.pairs, self.pair_of = np.unique(pairs, return_inverse=True)
        self.order = np.argsort(codes)
        self.words = codes[self.order]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.tokens, minlength=len(self.order))[self.order], np.bincount(self.pair_of, minlength=len(self.pairs))


def _packed(values: np.ndarray) -> bytes:
    """Numbers in as few bytes as the largest needs, bytes of equal rank together, which compresses well; the width comes first."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    return bytes([width]) + np.ascontiguousarray(values.astype(f"<u{width}").view(np.uint8).reshape(len(values), width).T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T).view(f"<u{width}").ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Ascending hashes as their differences."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data).astype(np.uint64))


@lru_cache(maxsize=4)
def _bucket_edges(n: int) -> np.ndarray:
    """Upper ends of ``n`` equal ranges of the hashes."""
    return np.array([(i + 1) * 2**64 // n - 1 for i in range(n)], np.uint64)


def _requests(n_words: int, n_pairs: int):
    """Per block and bucket the sorted hashes and how often the block counts them. Word buckets come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, hashes, tokens in zip(*[batch[c].to_pylist() for c in ("block", "part", "hashes", "tokens")]):
                grams = _Grams(hashes, tokens)
                rows: list[tuple] = []
                for base, n, keys, counts in zip((0, n_words), (n_words, n_pairs), (grams.words, grams.pairs), grams.counts()):
                    ends = np.searchsorted(keys, _bucket_edges(n), "right")
                    starts = np.r_[0, ends[:-1]]
                    for i in np.flatnonzero(ends > starts):
                        s, e = starts[i], ends[i]
                        rows.append((base + int(i), block, part, _steps(keys[s:e]), None if part == 2 else _packed(counts[s:e])))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "block", "part", "keys", "counts"])

    return run


REQUESTS = "bucket long, block long, part int, keys binary, counts binary"
ANSWERS = "bucket long, block long, kept binary, total binary, kinds long"


def _answer(n_words: int):
    """Adds up a bucket. Besides the answers, one row with block -1 holds the number of distinct words learned from."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        blocks, parts = table["block"].to_pylist(), table["part"].to_pylist()
        keys = [_from_steps(k) for k in table["keys"].to_pylist()]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        ends = np.cumsum([len(k) for k in keys])
        totals = np.zeros((2, len(distinct)), np.int64)
        for part, counts, e, k in zip(parts, table["counts"].to_pylist(), ends, keys):
            if counts is not None:
                totals[part, place[e - len(k) : e]] += _unpacked(counts).astype(np.int64)  # the hashes of a block are distinct
        both = totals.sum(axis=0)
        # only the deleted part asks for the counts without itself
        kept = [_packed(totals[0, place[e - len(k) : e]]) if part == 1 else None for part, e, k in zip(parts, ends, keys)]
        total = [_packed(both[place[e - len(k) : e]]) for e, k in zip(ends, keys)]
        kinds = [None] * len(blocks)
        if bucket < n_words:
            blocks, kept, total, kinds = [*blocks, -1], [*kept, None], [*total, None], [*kinds, int((both > 0).sum())]
        return pa.table({"bucket": pa.array([bucket] * len(blocks), pa.int64()), "block": pa.array(blocks, pa.int64()), "kept": pa.array(kept, pa.binary()), "total": pa.array(total, pa.binary()), "kinds": pa.array(kinds, pa.int64())})

    return run


class _Counts:
    """Counts for the tokens of a block, from the answers to it."""

    def __init__(self, row: dict) -> None:
        grams = _Grams(row["hashes"], row["tokens"])
        counts = np.concatenate([_unpacked(a["counts"]) for a in sorted(row["answers"], key=lambda a: a["bucket"])]).astype(np.float64)
        of_word = np.empty(len(grams.order))
        of_word[grams.order] = counts[: len(grams.order)]
        self.word, self.context = of_word[grams.tokens], of_word[grams.before]
        self.pair = counts[len(grams.order) :][grams.pair_of]

    def estimates(self, total: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level of the context, bigram and unigram estimate."""
        level = np.minimum(np.floor(np.log2(self.context + 1)), LEVELS - 1).astype(np.int64)
        return level, self.pair / np.maximum(self.context, 1), self.word / max(total, 1)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _step(p: np.ndarray) -> np.ndarray:
    """0 for none, else half powers of two below 1, counted from 1."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-2 * np.log2(np.maximum(p, 1e-300))) + 1, 1, STEPS - 1), 0).astype(np.int64)


def _summary(total: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                level, pair, word = _Counts(row).estimates(total)
                cells, counts = np.unique((level * STEPS + _step(pair)) * STEPS + _step(word), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(counts, pa.int64())], ["cell", "n"])

    return run


def learn_weights(cells: np.ndarray, counts: np.ndarray, uniform: float, rounds: int = 100) -> np.ndarray:
    """Weights (bigram, unigram, uniform) for each level by expectation maximisation over the summary."""
    value = lambda step: np.where(step > 0, 2.0 ** (-(step - 1) / 2), 0.0)
    level = cells // STEPS**2
    p = np.stack([value(cells // STEPS % STEPS), value(cells % STEPS), np.full(len(cells), uniform)], axis=1)
    weights = np.full((LEVELS + 1, 3), 1 / 3)  # the last row is learned on all levels, for those without data
    for _ in range(rounds):
        for rows, of in ((level, slice(0, LEVELS)), (np.full(len(level), LEVELS), slice(LEVELS, LEVELS + 1))):
            share = weights[rows] * p
            share *= (counts / np.maximum(share.sum(axis=1), 1e-300))[:, None]
            sums = np.stack([np.bincount(rows, share[:, k], LEVELS + 1) for k in range(3)], axis=1)[of] + 1e-3
            weights[of] = sums / sums.sum(axis=1, keepdims=True)
    seen = np.bincount(level, counts, LEVELS)[:LEVELS] > 0
    weights[:LEVELS][~seen] = weights[LEVELS]
    return weights[:LEVELS]


def _score(total: float, kinds: int, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                counts = _Counts(row)
                level, pair, word = counts.estimates(total)
                w = weights[level]
                model = np.log10(w[:, 0] * pair + w[:, 1] * word + w[:, 2] / (kinds + 1))
                base = np.log10((counts.word + 1) / (total + kinds + 1))
                lengths = _unpacked(row["lengths"]).astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["docs"], pa.int64()), pa.array([row["part"] == 2] * n, pa.bool_()), pa.array(lengths), pa.array(np.add.reduceat((counts.word > 0).astype(np.int64), starts)),
                     pa.array([int(total)] * n, pa.int64()), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(model, starts))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Every row is scored, repeated rows too, and every row outside the held-out part is learned
    from. A null or empty text is its end alone. A null id counts as the empty text where the
    parts are decided. Without training texts all counts are 0 and the uniform estimate is left.
    Other columns are ignored; an empty table gives none. The summary that the weights are
    learned on has at most LEVELS * STEPS * STEPS cells.
    """
    texts = texts_of(docs, id_col, text_col)
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    block, bucket = sizes(size // BYTES_PER_TOKEN)
    blocks = _written(texts.mapInArrow(_blocks(block), BLOCKS), "lm-blocks")
    tokens, total = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("part") < 2, F.col("n_tokens"))), F.lit(0))).first()
    n_pairs = max(1, -(-tokens // bucket))
    n_words = max(1, n_pairs // 4)
    asked = blocks.select("block", "part", "hashes", "tokens").mapInArrow(_requests(n_words, n_pairs), REQUESTS)
    answers = _written(asked.groupBy("bucket").applyInArrow(_answer(n_words), ANSWERS), "lm-answers")
    kinds = answers.where("block = -1").agg(F.coalesce(F.sum("kinds"), F.lit(0))).first()[0]
    kept = total - (blocks.where("part = 1").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])

    def answered(part: str, counts: str) -> DataFrame:
        """Blocks with the answers to them, as many as they asked for."""
        some, given = blocks.where(part), answers.where(f"block >= 0 and {counts} is not null")
        return some.join(given.groupBy("block").agg(F.collect_list(F.struct("bucket", F.col(counts).alias("counts"))).alias("answers")), "block")

    cells = answered("part = 1", "kept").mapInArrow(_summary(kept), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(np.array([r["cell"] for r in cells], np.int64), np.array([r["n"] for r in cells], np.float64), 1 / (kinds + 1))
    return answered("true", "total").mapInArrow(_score(float(total), int(kinds), weights), SCORES)
