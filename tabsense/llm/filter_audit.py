"""How text filters interact, read off a sparse document-term matrix.

The texts become shards of a document-term matrix in compressed sparse rows, with the words
of each shard beside them. A word's global number in the dictionary is its 64-bit hash; the
dictionary lists the distinct words of all shards by that number, which shows the numbers
that two words share, and those words get numbers of their own. So shards are numbered
where they lie: only distinct words travel, a frequent word once per shard, and no word's
documents ever meet in one task. A row's sum is the number of words of a text, its nonzero
count the number of distinct words.

Flags that are no matter of words are attached per document. From there on only counts
travel: documents per part and pattern of failed filters, of which there are at most 32
in a part, and each pattern is laid out over all orders of the filters.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import arrow_batches, store

SHARD_BYTES = 4_000_000  # text of a shard, about; a longer text is a shard of its own
BATCH_BYTES = 4_000_000  # of a batch on its way to or from Python; by default Spark gathers 64 MiB, in the JVM and in Python
SHARD_FILES = {"parquet.block.size": "8000000", "parquet.page.size.row.check.min": "1"}  # a row is megabytes: by default 100 are written before their size is looked at
FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 50, 65, 5
SYMBOLS = b"#$%&*|"
_UPPER = string.ascii_uppercase.encode()

SHARD = "shard long, doc_ids array<long>, parts array<string>, flags array<int>, digests array<binary>, indptr array<int>, indices array<int>, counts array<int>, words array<binary>"
MATRIX = "shard long, doc_ids array<long>, parts array<string>, flags array<int>, digests array<binary>, indptr array<int>, indices array<long>, counts array<int>"
MATRIX_NAMES = [f.split(" ")[0] for f in MATRIX.split(", ")]


def _one(values: pa.Array | np.ndarray | list, kind: pa.DataType) -> pa.Array:
    """A column of one row that holds all the values."""
    values = values if isinstance(values, pa.Array) else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))


def _encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """indptr, indices, counts and words of some texts, the words numbered as they come."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    full = pc.not_equal(flat, "")  # space at either end of a text leaves an empty word
    coded = flat.filter(full).dictionary_encode()
    n = max(len(coded.dictionary), 1)
    cells = np.sort(row[full.to_numpy(zero_copy_only=False)] * n + coded.indices.to_numpy())
    first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, np.int64)
    row, column = np.divmod(cells[first], n)
    counts = np.diff(np.r_[first, len(cells)])
    return np.r_[0, np.cumsum(np.bincount(row, minlength=len(texts)))], column, counts, coded.dictionary


def _shard(number: int, ids: list, parts: list, texts: list[bytes], lengths: list[int]) -> pa.RecordBatch:
    flags = [
        (BIT["C"] if 100 * (len(t) - len(t.translate(None, _UPPER))) > MAX_UPPER * n else 0) + (BIT["D"] if len(t.translate(None, SYMBOLS)) < len(t) else 0)
        for t, n in zip(texts, lengths)
    ]
    indptr, indices, counts, words = _encode(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    digests = [hashlib.sha256(t).digest() for t in texts]
    columns = [pa.array([number]), _one(ids, pa.int64()), _one(parts, pa.string()), _one(flags, pa.int32()), _one(digests, pa.binary())]
    columns += [_one(v, pa.int32()) for v in (indptr, indices, counts)] + [_one(words, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in SHARD.split(", ")])


def _shards(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 32, 0, ([], [], [], [])
        for batch in batches:
            lengths = pc.utf8_length(batch["text"]).to_pylist()
            for row in zip(batch["doc_id"].to_pylist(), batch["part"].to_pylist(), batch["text"].cast(pa.binary()), lengths):
                text = row[2].as_py()
                for column, value in zip(held, (row[0], row[1], text, row[3])):
                    column.append(value)
                size += len(text)
                if size >= shard_bytes:
                    yield _shard(number, *held)
                    number, size, held = number + 1, 0, ([], [], [], [])
                    pa.default_memory_pool().release_unused()  # else a worker keeps a third more than it uses
        if held[0]:
            yield _shard(number, *held)

    return run


def dictionary(shards: DataFrame) -> DataFrame:
    """(number, word) of the distinct words of all shards, equal numbers in one partition."""
    words = shards.select(F.explode("words").alias("word")).select(F.xxhash64("word").alias("number"), "word")
    return words.repartition("number").distinct()


def shared_numbers(words: DataFrame) -> dict[bytes, int]:
    """New numbers for words that share theirs with another word: about one pair in 2**64 pairs of words."""
    twice = words.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("number")
    found = sorted(bytes(r["word"]) for r in words.join(F.broadcast(twice), "number").select("word").collect()) if twice.limit(1).count() else []
    return {word: i for i, word in enumerate(found)}  # a hash below 2**20 that they could meet is one in 2**44


def _rewrite(shared: dict[bytes, int]):
    """Puts the global numbers in place of the shard's own ones, one shard at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                get = lambda c: batch[c][at].values
                numbers = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in get("words").to_pylist()), np.uint64, len(get("words"))).view(np.int64)
                if shared:
                    numbers = np.array([shared.get(w, n) for w, n in zip(get("words").to_pylist(), numbers.tolist())], np.int64)
                shard = batch.slice(at, 1)
                indices = _one(numbers[np.asarray(get("indices"))], pa.int64())
                yield pa.RecordBatch.from_arrays([indices if c == "indices" else shard[c] for c in MATRIX_NAMES], MATRIX_NAMES)
                pa.default_memory_pool().release_unused()

    return run


def _stored_shards(docs: DataFrame, id_col: str, text_col: str, part_col: str, shard_bytes: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return store(rows.mapInArrow(_shards(shard_bytes), SHARD), "shards", **SHARD_FILES)


def term_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """The dictionary (number, word) and the shards of the matrix.

    A shard has the doc_id, part, flags (bits of C and D) and text digest of its rows, and
    indptr, indices (numbers of words) and counts of its cells. A null text is a row without cells.
    """
    shards = _stored_shards(docs, id_col, text_col, part_col, shard_bytes)
    words = dictionary(shards)
    shared = shared_numbers(words)
    other = F.create_map(*[F.lit(x) for pair in shared.items() for x in pair])[F.col("word")] if shared else F.lit(None).cast("long")
    return words.select(F.coalesce(other, "number").alias("number"), "word"), shards.mapInArrow(_rewrite(shared), MATRIX)


def _row_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words (sum) and n_distinct (nonzero cells) of every row of the matrix."""
    for batch in batches:
        for at in range(batch.num_rows):
            get = lambda c: batch[c][at].values
            indptr, counts = np.asarray(get("indptr")), np.asarray(get("counts")).astype(np.int64)
            sums, filled = (np.diff(np.r_[0, np.cumsum(v, dtype=np.int64)][indptr]) for v in (counts, counts != 0))
            yield pa.RecordBatch.from_arrays(
                [get("doc_ids"), get("parts"), get("flags"), get("digests"), pa.array(sums), pa.array(filled)], ["doc_id", "part", "flags", "digest", "n_words", "n_distinct"])


ROWS = "doc_id long, part string, flags int, digest binary, n_words long, n_distinct long"


def row_counts(matrix: DataFrame) -> DataFrame:
    return matrix.mapInArrow(_row_counts, ROWS)


def _counted(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``row_counts`` of the matrix, numbering and counting a shard in the same task."""
    shards = _stored_shards(docs, id_col, text_col, part_col, SHARD_BYTES)
    number = _rewrite(shared_numbers(dictionary(shards)))
    return shards.mapInArrow(lambda batches: _row_counts(number(batches)), ROWS)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic; a row without a label, or without an id, has neither."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    named = rows.where("doc_id is not null").join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    return named.unionByName(rows.where("doc_id is null").withColumns({"good": F.lit(False), "toxic": F.lit(False)}))


def patterns(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, pattern (bits of the failed filters), n, n_good and n_toxic.

    Of rows with one text, those with the smallest id pass E, as do rows without an id; all
    others fail it. So E needs the smallest id per text, and the rows that hold it are
    taken off the counts of all rows: a text that fills a third of the table is a counter.
    """
    fails = F.col("flags") + F.when(F.col("n_words") < MIN_WORDS, BIT["A"]).otherwise(0) + F.when(100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"), BIT["B"]).otherwise(0)
    rows = _counted(docs, id_col, text_col, part_col).select("doc_id", "part", "digest", fails.alias("pattern")).groupBy("doc_id", "part", "digest", "pattern").agg(F.count(F.lit(1)).alias("n"))
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        rows = store(rows, "counted-rows")
    rows = store(_labelled(rows, labels), "filter-rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    passing = rows.where("doc_id is not null").join(first, ["digest", "doc_id"], "left_semi").unionByName(rows.where("doc_id is null"))
    kinds = rows.withColumn("pattern", F.col("pattern") + BIT["E"]).unionByName(passing).unionByName(passing.withColumns({"pattern": F.col("pattern") + BIT["E"], "n": -F.col("n")}))
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).alias
    return kinds.groupBy("part", "pattern").agg(F.sum("n").alias("n"), total(F.col("good"))("n_good"), total(F.col("toxic"))("n_toxic"))


def _layout(spark) -> DataFrame:
    """What one document of a pattern adds to each step of each order: 32 x 600 rows, whatever the data."""
    rows = []
    for pattern in range(1 << len(FILTERS)):
        failed = [f for f in FILTERS if pattern & BIT[f]]
        for order in permutations(FILTERS):
            before = False
            for step, f in enumerate(order, 1):
                fails = f in failed
                removed = fails and not before
                share = factorial(len(FILTERS)) // len(failed) if fails else 0  # orders in which f comes first of the failed ones
                rows.append((pattern, "".join(order), step, int(not (before or fails)), int(removed), int(fails and before), int(failed == [f]), share))
                before = before or fails
    names = ["pattern", "filter_order", "step", "_kept", "_removed", "_redundant", "_only", "_share"]
    # as an Arrow table it is part of the plan; as a list it would start Python workers beside the ones that wait
    return spark.createDataFrame(pa.table([pa.array(c, pa.string() if n == "filter_order" else pa.int32()) for n, c in zip(names, zip(*rows))], names))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    One row, zeros included, per part, order of the five filters and step. A null text is
    empty, a null part the empty string. Repeated rows count each; rows with the same text
    and the same smallest id all pass E, and a row without an id passes it and has no
    label. Of repeated labels any 1 counts. Other columns are ignored; an empty table has no
    parts and gives no rows.
    """
    counts = patterns(docs, labels, id_col, text_col, part_col)
    laid = counts.join(F.broadcast(_layout(docs.sparkSession)), "pattern")
    total = lambda n, unit, name: F.sum(F.col(n) * F.col(unit)).cast("long").alias(name)
    return laid.groupBy("part", "filter_order", "step").agg(
        total("n", "_kept", "kept"), total("n", "_removed", "removed"), total("n", "_redundant", "redundant"), total("n", "_only", "unique_fails"),
        total("n_good", "_removed", "good_lost"), total("n_toxic", "_removed", "toxic_lost"), total("n", "_share", "shapley"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x
    WHEN 'A' THEN len(ws) < 50 WHEN 'B' THEN 100 * len(list_distinct(ws)) < 65 * len(ws)
    WHEN 'C' THEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g'))) > 5 * length(t)
    WHEN 'D' THEN regexp_matches(t, '[#$%&*|]') ELSE coalesce(doc_id > first, false) END) AS failed FROM w LEFT JOIN l USING (doc_id)),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
g AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
r AS (SELECT part, failed, n, good, toxic, o, step, list_contains(failed, o[step]) AS fails, list_has_any(failed, o[1 : step - 1]) AS gone FROM g, s),
q AS (SELECT part, array_to_string(o, '') AS filter_order, CAST(step AS INTEGER) AS step, o[step] AS letter,
  CAST(sum(CASE WHEN fails OR gone THEN 0 ELSE n END) AS BIGINT) AS kept, CAST(sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN fails AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant, CAST(sum(CASE WHEN fails AND len(failed) = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost, CAST(sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, o, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM q
"""
