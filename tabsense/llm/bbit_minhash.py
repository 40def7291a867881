"""Near duplicates by b-bit MinHash.

Each text becomes the minima of PERMUTATIONS hash functions over its word shingles. Full
minima make the band keys that find candidates; of every minimum only the lowest B bits
are kept, stored as bit planes, and a candidate's similarity is estimated by counting
equal positions and taking out the share that b bits agree by chance. What passes the
estimate is confirmed on the whole shingle sets.

Links are needed only as far as they decide the groups. Texts with the same shingle set
become one class first. In each bucket all classes are compared with the smallest one;
buckets that still hold several groups after that have their members compared across
groups, in tiles of bounded size; such a tile confirms its own pairs, each pair in the first
band it shares, and gives back links only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, store
from .common import join_by_size, sized_side, slices, texts_of, words_of
from .components import connected

SHINGLE = 5
BANDS = 32
ROWS = 6
PERMUTATIONS = BANDS * ROWS
B = 4  # bits kept of each minimum
TILE = 512  # classes of one bucket that are compared with each other in one go

PLANE_LONGS = PERMUTATIONS // 64


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """The distinct shingles of a text as 64-bit hashes, ascending; fewer words than a shingle are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    codes = []
    for w in words:
        code = known.get(w)
        if code is None:
            code = known[w] = xxhash.xxh3_64_intdigest(w)
        codes.append(code)
    codes = np.array(codes, np.uint64)
    width = min(SHINGLE, len(codes))
    factors = _constants(SHINGLE, 5)
    total = np.full(len(codes) - width + 1, width, np.uint64)
    for i in range(width):
        total = _mixed(total * factors[i] + codes[i : len(codes) - width + 1 + i])
    return np.unique(total)


def _minima(shingles: np.ndarray) -> np.ndarray:
    factors, shifts = _constants(PERMUTATIONS, 1)[:, None], _constants(PERMUTATIONS, 2)[:, None]
    out = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 512):
        np.minimum(out, (shingles[None, at : at + 512] * factors + shifts).min(axis=1), out=out)
    return out


def _bands(minima: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + minima[i::ROWS])
    return keys.view(np.int64)


def _planes(minima: np.ndarray) -> np.ndarray:
    """B planes of PERMUTATIONS bits, 64 to a long."""
    bits = (_mixed(minima)[None, :] >> np.arange(B, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(B * PLANE_LONGS, 64), axis=1).view(np.int64).ravel()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in slices(batches):
        if len(known) > 500_000:
            known.clear()
        counts, digests, bands, planes = [], [], [], []
        for text in batch["text"].to_pylist():
            shingles = shingle_hashes(words_of(text), known)
            counts.append(len(shingles))
            if len(shingles):
                minima = _minima(shingles)
                digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                bands.append(_bands(minima))
                planes.append(_planes(minima))
            else:
                digests.append(None)
                bands.append(None)
                planes.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_key"], pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(planes, pa.list_(pa.int64()))],
            ["doc_id", "text_key", "n_shingles", "digest", "bands", "planes"],
        )


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and a hash of the text, so that an id that comes with several texts names each of them."""
    return texts_of(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hash of the text, n_shingles, digest of the shingle set, band keys and bit planes of every row; nulls where there is no word."""
    return _keyed(docs, id_col, text_col).mapInArrow(_sketch, "doc_id long, text_key long, n_shingles long, digest binary, bands array<long>, planes array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity by bit counts over two plane columns: the share of equal positions without those equal by chance."""
    differ = []
    for i in range(PLANE_LONGS):
        per_bit = [f"({a}[{p * PLANE_LONGS + i}] ^ {b}[{p * PLANE_LONGS + i}])" for p in range(B)]
        differ.append(f"bit_count({' | '.join(per_bit)})")
    chance = 2.0**-B
    return F.expr(f"(1 - ({' + '.join(differ)}) / {float(PERMUTATIONS)}D - {chance}D) / {1 - chance}D")


def slack(threshold: float, sigmas: float = 5.5) -> float:
    """The least estimate that is confirmed: so many standard deviations of the estimate below the threshold."""
    equal = threshold + (1 - threshold) * 2.0**-B
    return threshold - sigmas * float(np.sqrt(equal * (1 - equal) / PERMUTATIONS)) / (1 - 2.0**-B)


TILED = "key long, i long, j long, tile long, id long, component long"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by (key, i, j)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        starts = _starts(table)
        for s, e in zip(starts[:-1], starts[1:]):
            yield table.slice(s, e - s)
        held = table.slice(starts[-1]).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _starts(table: pa.Table) -> np.ndarray:
    keys = np.stack([table[c].to_numpy() for c in ("key", "i", "j")], axis=1)
    return np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])


def _likely(table: pa.Table, low: float) -> Iterator[tuple[int, np.ndarray]]:
    """Pairs (row, rows) of one group: of different components, the estimate reaches ``low``, and no earlier band holds them both."""
    groups, tiles = table["component"].to_numpy(), table["tile"].to_numpy()
    key, first, second = (table[c][0].as_py() for c in ("key", "i", "j"))
    flat = lambda c, kind: table[c].combine_chunks().flatten().to_numpy().view(kind)
    planes = flat("planes", np.uint64).reshape(len(groups), B, PLANE_LONGS)
    bands = flat("bands", np.int64).reshape(len(groups), BANDS)
    right = np.flatnonzero(tiles == second)
    for x in np.flatnonzero(tiles == first):
        others = right[right > x] if first == second else right
        others = others[groups[others] != groups[x]]
        if len(others):
            differ = np.bitwise_count(np.bitwise_or.reduce(planes[others] ^ planes[x], axis=1)).sum(axis=1)
            others = others[(1 - differ / PERMUTATIONS - 2.0**-B) / (1 - 2.0**-B) >= low]
            others = others[bands[x][(bands[others] == bands[x]).argmax(axis=1)] == key]
            if len(others):
                yield int(x), others


def _involved(low: float):
    """The rows that are in a likely pair of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches):
            mark = np.zeros(table.num_rows, bool)
            for x, others in _likely(table, low):
                mark[x] = True
                mark[others] = True
            if mark.any():
                yield from table.select(["key", "i", "j", "tile", "id", "component"]).filter(pa.array(mark)).combine_chunks().to_batches()

    return run


def _joining(low: float, percent: int):
    """Confirmed links between components of a group; a pair whose components are joined already is not looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(slices(batches)):
            ids, groups, texts = table["id"].to_pylist(), table["component"].to_pylist(), table["text"]
            sets: dict[int, set] = {}
            parent = {g: g for g in groups}

            def root(g: int) -> int:
                while parent[g] != g:
                    parent[g] = parent[parent[g]]
                    g = parent[g]
                return g

            def of(i: int) -> set:
                if i not in sets:
                    sets[i] = shingle_set(words_of(texts[i].as_py()))
                return sets[i]

            found = []
            for x, others in _likely(table, low):
                for y in others.tolist():
                    if root(groups[x]) != root(groups[y]) and similar(of(x), of(y), percent):
                        parent[root(groups[x])] = root(groups[y])
                        found.append((ids[x], ids[y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return run


def similar(a: set, b: set, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_id, last_set = None, frozenset()
        for batch in slices(batches):
            keep = []
            for a, text_a, text_b in zip(batch["a"].to_pylist(), batch["text_a"].to_pylist(), batch["text_b"].to_pylist()):
                if a != last_id:
                    last_id, last_set = a, shingle_set(words_of(text_a))
                keep.append(similar(last_set, shingle_set(words_of(text_b)), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def shingle_set(words: list[bytes]) -> set:
    if len(words) < SHINGLE:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(SHINGLE)]))


PAIRS_PER_TASK = 1_000  # of one text, which is sent to so many parts of its pairs


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes (a, b) whose whole shingle sets are similar enough; the pairs of a frequent ``a`` are dealt over tasks."""
    parts = F.ceil(F.col("n") / PAIRS_PER_TASK).cast("long")
    sizes = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", parts))
    dealt = join_by_size(pairs, sizes, "a", "n").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    left = texts.join(sizes, texts["id"] == sizes["a"]).select("a", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return dealt.join(right, "b").join(left, ["a", "part"]).select("a", "b", "text_a", "text_b").mapInArrow(_confirm(percent), "a long, b long").distinct()


def _linked(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles and component_id of every row."""
    low = slack(percent / 100)
    rows = store(sketches(docs, id_col, text_col), "minhash")
    filled = rows.where("digest is not null and doc_id is not null")

    # one class for each distinct shingle set, with the text of any of its rows; classes have numbers of their own
    of_set = materialize(filled.groupBy("digest").agg(F.min("doc_id").alias("smallest"), F.count(F.lit(1)).alias("n")))
    classes = store(filled.dropDuplicates(["digest"]).select(F.monotonically_increasing_id().alias("id"), "digest", "doc_id", "text_key", "bands", "planes"), "classes")
    heads = classes.select("id", "bands", "planes")
    texts = _keyed(docs, id_col, text_col)

    def texts_of_classes(ids: DataFrame) -> DataFrame:
        wanted = sized_side(classes.select("id", "doc_id", "text_key").join(ids.select("id").distinct(), "id"))
        return store(texts.join(wanted, ["doc_id", "text_key"]).select("id", "text"), "class-texts")

    # buckets of at least two classes, and their smallest member
    spread = heads.select("id", F.explode("bands").alias("key"))
    pivots = materialize(spread.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    buckets = store(join_by_size(spread, pivots, "key", "size"), "buckets")
    planes = heads.select("id", "planes")
    side = lambda c: planes.select(F.col("id").alias(c), F.col("planes").alias(f"planes_{c}"))
    stars = buckets.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    likely = materialize(stars.join(side("a"), "a").join(side("b"), "b").where(estimate("planes_a", "planes_b") >= low).select("a", "b"))
    links = materialize(_confirmed(likely, texts_of_classes(likely.select(F.col("a").alias("id")).union(likely.select("b"))), percent))

    # buckets that still hold several groups
    groups = materialize(connected(links))
    split = buckets.join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = split.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).where("low != high and members > 2").select("key", "members")
    tiles = F.ceil(F.col("members") / TILE).cast("long")
    dealt = (
        join_by_size(split.select("key", "id", "component"), materialize(mixed), "key", "members")
        .withColumn("tiles", tiles).withColumn("tile", F.expr("pmod(xxhash64(id), tiles)"))
        .withColumn("other", F.explode(F.expr("sequence(0L, tiles - 1)")))
        .select("key", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "id", "component")
    )
    grouped = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    involved = materialize(grouped(dealt.join(heads, "id")).mapInArrow(_involved(low), TILED))
    more = grouped(involved.join(heads, "id").join(texts_of_classes(involved), "id")).mapInArrow(_joining(low, percent), "a long, b long")
    final = materialize(connected(links.union(more)))

    # components are named by the smallest id of their rows, and brought back to the rows
    small = classes.select("id", "digest").join(of_set, "digest").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of_component = small.groupBy("component").agg(F.min("smallest").alias("component_id"))
    named = materialize(small.join(of_component, "component").select("digest", "component_id", "n"))
    slim = rows.select("doc_id", "text_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    whole = join_by_size(slim, named, "digest", "n", "left")
    return whole.select("doc_id", "text_key", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Rows are linked when 100 * shared shingles >= ``percent`` * all shingles; component_id is
    the smallest id reached, kept is doc_id = component_id. Rows without words (null or empty
    texts too) have no shingles, link with nothing and stay. A row with a null id stays by
    itself with a null component. An id that comes with several texts links as each of them,
    and does not link them by itself; repeated rows share a component, and each of them has
    kept as its id says. Other columns are ignored. Rows with the same shingle set, told by 128
    bits over the 64-bit hashes of all its shingles, are one class; links between classes are
    confirmed on whole sets. A pair right at the threshold of 0.8 goes unseen in every band
    with probability 5e-5, at 0.85 with 3e-7.
    """
    linked = _linked(docs, id_col, text_col, percent)
    return linked.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows that stay, one for each group, with their columns as they came; repeated rows stay repeated."""
    gone = _linked(docs, id_col, text_col, percent).where("doc_id != component_id").select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_key")).distinct()
    same = (F.col(id_col).cast("long") == F.col("_gone")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_key"))
    return docs.join(gone, same, "left_anti")
