"""Text quality by the votes of nearest labelled texts in a latent space.

A text becomes weighted counts of hashed terms: its words, their shapes (letters, capitals,
digits and the signs between them), pairs of neighbouring shapes, and words repeated at
once. Weights fall with the number of documents that hold a term, counted over all
documents. The leading singular vectors of a labelled sample span the latent space. The
sample's vectors, at most MOST x RANK numbers, go to every task; each text is compared with
all of them, in blocks, and the labels of the nearest ones vote by their similarity.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

FOLDS, HELD_OUT = 5, 0  # crc32 of the id as text, modulo the first, is the second: its label is never learned
MOST = 4_000  # labelled texts at most that the space and the votes are fitted on
RANK = 48
NEIGHBOURS = 15
KEEP_AT = 0.3
KINDS = {"word": 2048, "shape": 1024, "pair": 1024}  # hashed terms of each kind
WEIGHT = {"word": 0.5, "shape": 1.0, "pair": 1.0}
FIRST = dict(zip(KINDS, np.r_[0, np.cumsum(list(KINDS.values()))].tolist()))
TERMS = sum(KINDS.values())

_CLASS = bytes(ord("A") if chr(c) in string.ascii_uppercase else ord("0") if chr(c) in string.digits else ord("a") if chr(c) in string.ascii_lowercase or c >= 128 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
AGAIN = b" "  # stands for a word that repeats the one before it; no shape has a space


def shape(word: bytes) -> bytes:
    """Classes of the characters, runs as one: ``Ab1$$`` is ``Aa0$``."""
    return _RUN.sub(rb"\1", word.translate(_CLASS))


@lru_cache(maxsize=1 << 16)
def _bucket(kind: str, term: bytes) -> int:
    return FIRST[kind] + zlib.crc32(term) % KINDS[kind]


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (text, term, count) of some texts, by text and term."""
    lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # space at either end of a text leaves an empty word
    row, coded = row[full], flat.filter(pa.array(full)).dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    if not words:
        return (np.zeros(0, np.int64),) * 3
    shapes = [shape(w) for w in words]
    kinds = {s: i for i, s in enumerate(dict.fromkeys([*shapes, AGAIN]))}
    names = list(kinds)
    follows = np.r_[False, row[1:] == row[:-1]]
    own = np.array([kinds[s] for s in shapes], np.int64)[code]
    own = np.where(follows & np.r_[False, code[1:] == code[:-1]], kinds[AGAIN], own)
    pairs, pair = np.unique(own[:-1][follows[1:]] * len(names) + own[1:][follows[1:]], return_inverse=True)
    of_pair = np.array([_bucket("pair", names[p // len(names)] + b"\n" + names[p % len(names)]) for p in pairs.tolist()], np.int64)
    of_word = np.array([_bucket("word", w) for w in words], np.int64)
    of_shape = np.array([_bucket("shape", n) for n in names], np.int64)
    cells = np.concatenate([row * TERMS + of_word[code], row * TERMS + of_shape[own], row[1:][follows[1:]] * TERMS + of_pair[pair]])
    cells, counts = np.unique(cells, return_counts=True)
    return cells // TERMS, cells % TERMS, counts


def weighted(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    """Term vectors: damped counts times weights, each kind of term brought to its own length."""
    row, term, count = term_counts(texts)
    out = np.zeros((len(texts), TERMS), np.float32)
    out[row, term] = np.log1p(count) * idf[term]
    for kind, n in KINDS.items():
        part = out[:, FIRST[kind] : FIRST[kind] + n]
        part *= WEIGHT[kind] / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return out


def latent(vectors: np.ndarray, basis: np.ndarray) -> np.ndarray:
    out = vectors @ basis
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and rows that hold each term, over all rows of (doc_id, text); a task sends one row per term at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(TERMS + 1, np.int64), 0
        for batch in slices(batches):
            total[:TERMS] += np.bincount(term_counts(batch["text"])[1], minlength=TERMS)
            total[TERMS] += batch.num_rows
            rows += batch.num_rows
        if rows:
            term = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(total[term])], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for term, n in texts.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return int(out[TERMS]), out[:TERMS]


def singular_vectors(matrix: np.ndarray, rank: int, rounds: int = 6) -> np.ndarray:
    """Leading right singular vectors by subspace iteration from a fixed start."""
    rank = min(rank, *matrix.shape)
    basis = np.linalg.qr(np.random.default_rng(7).standard_normal((matrix.shape[1], rank)).astype(np.float32))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(matrix.T @ (matrix @ basis))[0]
    return basis.astype(np.float32)


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray  # of the labelled texts, each of length one
    labels: np.ndarray

    def votes(self, texts: pa.Array) -> np.ndarray:
        """Share of label 1 among the nearest labelled texts, each weighted by its cosine.

        Similarities count to six places; all that tie with the last of the nearest vote too.
        Where nothing is similar, as for an empty text, the share over all labels stands.
        """
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(texts), prior)
        cosine = np.round(latent(weighted(texts, self.idf), self.basis) @ self.vectors.T, 6).clip(0)
        k = min(NEIGHBOURS, len(self.labels))
        least = np.partition(cosine, -k, axis=1)[:, [-k]]
        cosine[cosine < least] = 0
        total = cosine.sum(axis=1, dtype=np.float64)
        return np.where(total > 0, (cosine.astype(np.float64) @ self.labels) / np.maximum(total, 1e-12), prior).clip(0, 1)


def held_out(id_col: str = "doc_id") -> Column:
    """A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def learn(texts: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """The space and the labelled vectors, from the ``most`` labelled rows outside the held-out part with the smallest hashes.

    A document with several labels counts as 1 if any is 1. Null ids and null labels teach nothing.
    """
    total, found = document_frequencies(texts)
    idf = (np.log((1 + total) / (1 + found)) + 1).astype(np.float32)
    known = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).cast("int").alias("label"))
    order = F.xxhash64("doc_id", F.lit(11))
    few = known.orderBy(order, "doc_id").limit(most)  # ids and labels only; their texts are fetched by a join with few ids
    rows = texts.join(F.broadcast(few), "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            row, term, count = term_counts(batch["text"])
            ends = np.searchsorted(row, np.arange(batch.num_rows + 1))
            parts = [(term[s:e].astype(np.int32).tobytes(), count[s:e].astype(np.float32).tobytes()) for s, e in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["label"], pa.array([p for p, _ in parts], pa.binary()), pa.array([p for _, p in parts], pa.binary())], ["doc_id", "label", "terms", "counts"])

    # at most ``most`` rows, but for repeated ids, of which the least vector stays; a vector has at most TERMS cells
    taken = rows.mapInArrow(vectors, "doc_id long, label int, terms binary, counts binary").groupBy("doc_id", "label").agg(F.min(F.struct("terms", "counts")).alias("v")).orderBy("doc_id").collect()
    matrix = np.zeros((len(taken), TERMS), np.float32)
    for i, r in enumerate(taken):
        term = np.frombuffer(r["v"]["terms"], np.int32)
        matrix[i, term] = np.log1p(np.frombuffer(r["v"]["counts"], np.float32)) * idf[term]
    for kind, n in KINDS.items():
        part = matrix[:, FIRST[kind] : FIRST[kind] + n]
        part *= WEIGHT[kind] / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    if not len(taken):
        return Model(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    basis = singular_vectors(matrix, RANK)
    return Model(idf, basis, latent(matrix, basis).astype(np.float32), np.array([r["label"] for r in taken], np.float64))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    A null or empty text has no terms and gets the share of label 1 in the sample, as does
    any text where nothing is similar; without labels that is 0.5. Repeated rows and null
    ids give a row each, other columns are ignored, an empty table gives none.
    """
    texts = texts_of(docs, id_col, text_col)
    model = model or learn(texts, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1_000_000):
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(model.votes(part["text"]))], ["doc_id", "score"])

    scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= KEEP_AT, 1).otherwise(0).alias("predicted"))
