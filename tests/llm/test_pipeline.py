"""The stages of the pipeline one after another against plain Python, and the rows that mixing picks."""

from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_mixing_packing import targets
from tokenizers import Tokenizer

from oracle_check import connect
from tabsense.llm import mixing, quality_ledger
from tabsense.llm.common import word_count, words_of
from tabsense.llm.queries import DOMAIN, MIXTURE, PATH
from tabsense.storage import load, store

FOLDER = "/root/testdata/sf0.001"


def picked(rows, weights, budget, epochs, slice_rows):
    """(epoch, tokens taken) -> ids, by reading every leaf in its seeded order. ``rows``: leaf, id, tokens, order by epoch."""
    leaves = defaultdict(list)
    for leaf, i, n, order in rows:
        leaves[leaf].append((i, n, order))
    want = targets({k: sum(n for _, n, _ in v) for k, v in leaves.items() if sum(n for _, n, _ in v)}, weights, budget, epochs)
    out = set()
    for leaf, target in want.items():
        docs = leaves[leaf]
        whole, rest = divmod(target, sum(n for _, n, _ in docs)) if target else (0, 0)
        if not target:
            continue
        out |= {(i, e, n) for e in range(whole) for i, n, _ in docs}
        slices = -(-len(docs) // slice_rows)
        start = 0
        for i, n, order in sorted(docs, key=lambda d: (d[2][whole] % slices, d[2][whole], d[0])):
            if start < rest:
                out.add((i, whole, min(n, rest - start)))
            start += n
    return out


@pytest.mark.parametrize("epochs,slice_rows", [(4, 10_000), (1, 3), (3, 20)])
def test_mixing_reads_the_seeded_order(spark, monkeypatch, epochs, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    docs = load(spark, "/root/testdata/sf0.01", "documents").withColumn("domain", F.expr(DOMAIN))
    order = F.array(*[F.xxhash64(F.lit(7), F.lit(e).cast("long"), F.col("doc_id")) for e in range(epochs + 1)])
    rows = [((r[0], r[1], r[2]), r["doc_id"], r["n"], r["o"]) for r in docs.select(*PATH, "doc_id", word_count("text").alias("n"), order.alias("o")).collect()]
    got = mixing.mix(docs, PATH, MIXTURE, word_count("text"), F.expr("total * 3 div 4"), epochs).collect()
    want = picked(rows, MIXTURE, sum(r[2] for r in rows) * 3 // 4, epochs, slice_rows)
    assert {(r["doc_id"], r["epoch"], r["tokens_taken"]) for r in got if r["tokens"]} == {x for x in want if x[2]}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = words_of(text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_stages_end_to_end(spark):
    docs = load(spark, FOLDER, "documents")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    table = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = store(stage(spark, table, FOLDER), "stage")
        assert table.columns == docs.columns
        kept[name] = {r["doc_id"] for r in table.select("doc_id").collect()}

    good = {r[0] for r in connect(FOLDER).execute(f"SELECT doc_id FROM ({quality_ledger.SQL}) WHERE kept").fetchall()}
    assert kept["quality rules"] == good and len(good) < len(text)

    groups = defaultdict(list)
    for d in good:
        groups[lowered(text[d])].append(d)
    single = {max(g) for g in groups.values()}
    assert kept["exact dedup"] == single

    ids, sets, root = sorted(single), {d: shingles(text[d]) for d in single}, {d: d for d in single}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    apart = {d for d in ids if find(d) == d}
    assert kept["near dedup"] == apart

    tree = docs.where(F.col("doc_id").isin(list(apart))).withColumn("domain", F.expr(DOMAIN))
    order = F.array(*[F.xxhash64(F.lit(7), F.lit(e).cast("long"), F.col("doc_id")) for e in range(2)])
    rows = [((r[0], r[1], r[2]), r["doc_id"], r["n"], r["o"]) for r in tree.select(*PATH, "doc_id", word_count("text").alias("n"), order.alias("o")).collect()]
    want = picked(rows, MIXTURE, sum(r[2] for r in rows) * 4 // 5, 1, mixing.SLICE_ROWS)
    assert kept["mixture"] == {i for i, _, _ in want}

    pieces = corpus_pipeline.STAGES[-1][1](spark, table, FOLDER).collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = {d: len(coder.encode(text[d] or "", add_special_tokens=False).ids) + 1 for d in kept["mixture"]}
    own, room = defaultdict(int), defaultdict(list)
    for r in pieces:
        own[r["doc_id"]] += r["length"]
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    assert own == lengths
    for places in room.values():
        places.sort()
        assert all(o == sum(n for _, n in places[:k]) for k, (o, _) in enumerate(places)) and sum(n for _, n in places) <= 1024


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_tables(spark, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, _row string, epoch string, piece string"
    odd = [(1, None), (1, None), (None, None), (2, ""), (3, " \n"), (4, "a b c d e " * 30_000), (4, "a b c d e " * 30_000), (None, "word " * 12), (6, " ".join(f"w{i}" for i in range(60))), (6, "x")]
    rows = [(d, t, None if d == 2 else "en", None if d in (None, 3) else "src1", None, "k", None, "e", "p") for d, t in odd]
    table = spark.createDataFrame(rows, schema)
    out, none = stage(spark, table, FOLDER), stage(spark, table.where("false"), FOLDER)
    assert none.count() == 0 and out.count() <= max(len(rows), 1000)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == none.columns == table.columns
        # the mixture leaves rows out by its budget, the other stages have no reason to drop this text
        assert name == "mixture" or (" ".join(f"w{i}" for i in range(60)),) in {(r["text"],) for r in out.collect()}
