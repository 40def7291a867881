"""Mixing and packing against plain Python."""

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsense.llm import mixing, packing
from tabsense.llm.common import word_count
from tabsense.llm.queries import DOMAIN, MIXTURE, PATH, QUERIES
from tabsense.storage import load

FOLDER = "/root/testdata/sf0.01"


def shared(budget, children):
    """name -> tokens by filling the children with the least cap per weight first."""
    got, left, weight = {}, budget, sum(w for w, _ in children.values())
    for name, (w, cap) in sorted(children.items(), key=lambda kv: (Fraction(kv[1][1], kv[1][0]), kv[0])):
        if cap * weight <= w * left:
            got[name], left, weight = cap, left - cap, weight - w
        else:
            break
    open_ = {n: w for n, (w, _) in children.items() if n not in got}
    for n, w in open_.items():
        got[n] = w * left // weight
    spare = left - sum(got[n] for n in open_)
    for n in sorted(open_, key=lambda n: (-(open_[n] * left % weight), n))[:spare]:
        got[n] += 1
    return got


def targets(leaves, weights, budget, epochs):
    weight = lambda path: weights.get(path, 1)

    def cap(path):
        if path in leaves:
            return leaves[path] * epochs
        kids = {p[: len(path) + 1] for p in leaves if p[: len(path)] == path}
        return sum(cap(k) for k in kids if weight(k) > 0)

    def down(path, got):
        if path in leaves:
            return {path: got}
        kids = {p[: len(path) + 1] for p in leaves if p[: len(path)] == path}
        kids = {k: (weight(k), cap(k)) for k in kids if weight(k) > 0 and cap(k) > 0}
        out = {}
        for k, g in shared(got, kids).items():
            out |= down(k, g)
        return out

    return down((), min(budget, cap(())))


@pytest.mark.parametrize("epochs,slice_rows", [(4, 10_000), (1, 3)])
def test_mix_follows_the_tree(spark, monkeypatch, epochs, slice_rows):
    monkeypatch.setattr(mixing, "SLICE_ROWS", slice_rows)
    docs = load(spark, FOLDER, "documents").withColumn("domain", F.expr(DOMAIN))
    rows = docs.select(*PATH, word_count("text").alias("n")).collect()
    leaves = Counter()
    for r in rows:
        leaves[(r[0], r[1], r[2])] += r["n"]
    budget = sum(leaves.values()) // 2
    want = targets({k: v for k, v in leaves.items() if v}, MIXTURE, budget, epochs)
    got, read = Counter(), defaultdict(list)
    for r in mixing.mix(docs, PATH, MIXTURE, word_count("text"), F.expr("total div 2"), epochs).collect():
        leaf = (r["domain"], r["lang"], r["source"])
        got[leaf] += r["tokens_taken"]
        read[leaf].append(r)
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    per_leaf = Counter((r[0], r[1], r[2]) for r in rows)
    for leaf, chosen in read.items():
        last = max(r["epoch"] for r in chosen)
        for e in range(last):  # all but the last epoch are whole
            assert sum(r["epoch"] == e for r in chosen) == per_leaf[leaf]
        assert sum(r["tokens_taken"] < r["tokens"] for r in chosen) <= 1


def test_shortage_goes_to_siblings_first():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("b", "y", "3"): 1000}
    assert targets(leaves, {}, 400, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("b", "y", "3"): 200}


def test_mix_edges(spark):
    schema = "doc_id long, domain string, lang string, source string, epoch string, _id string"
    size = F.lit(5)
    assert mixing.mix(spark.createDataFrame([], schema), PATH, {}, size, F.expr("total")).count() == 0
    rows = [(1, None, None, None, "e", "i"), (1, None, None, None, "e", "i"), (None, "a", None, "s", None, None), (3, "a", "en", "s", "e", "i")]
    got = mixing.mix(spark.createDataFrame(rows, schema), PATH, {("a", "en"): 0}, size, F.expr("total"), epochs=1).collect()
    assert sum(r["tokens_taken"] for r in got) == 15 and not any(r["lang"] == "en" for r in got)
    assert mixing.mix(spark.createDataFrame(rows, schema), PATH, {}, F.lit(None), F.expr("total")).count() == 0


def ids_of(texts):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.encode_special_tokens = True
    return [e.ids + [2] for e in own.encode_batch(texts, add_special_tokens=False)]


def check_packing(docs, rows):
    limit = 1024
    want = Counter()
    for doc, ids in zip((d for d, _ in docs), ids_of([t or "" for _, t in docs])):
        first = len(ids) % limit or limit
        edges = [0, len(ids)] if len(ids) <= limit else [0, *range(first, len(ids) + 1, limit)]
        for i, (s, e) in enumerate(zip(edges, edges[1:])):
            want[(doc, i, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    inside = defaultdict(list)
    for r in rows:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in inside.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    return len(inside), -(-sum(r["length"] for r in rows) // limit)


def test_packing_against_the_tokenizer(spark):
    docs = load(spark, FOLDER, "documents")
    rows = packing.pack(docs).collect()
    sequences, bound = check_packing([(r["doc_id"], r["text"]) for r in docs.collect()], rows)
    assert sequences <= bound * 1.01 + 1


def test_packing_edges(spark):
    schema = "doc_id long, text string, rank string, part string, length string"
    docs = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "<|endoftext|>"), (4, " x" * 1023), (5, " x" * 1024), (6, "é中" * 3000), (7, " " * 20000)]
    rows = packing.pack(spark.createDataFrame([(*d, "r", "p", "l") for d in docs], schema)).collect()
    check_packing(docs, rows)
    assert packing.pack(spark.createDataFrame([], schema)).count() == 0


def test_queries_take_the_ids_of_the_library_defaults(spark, tmp_path):
    texts = ["<|endoftext|>", "a  <|endoftext|> b<|endoftext|><|endoftext|>\n", "<|endoftext|" + "x y" * 2000, "x <|endoftext|> y" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = set()
    for doc, text in enumerate(texts):
        ids = own.encode(text, add_special_tokens=False).ids + [2]
        for piece, (start, length) in enumerate(packing.cuts(len(ids), 1024)):
            want.add((doc, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
    for rows in (QUERIES["op6_packing"](spark, str(tmp_path)), corpus_pipeline.best_fit_packing(spark, docs, str(tmp_path))):
        assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows.collect()} == want


def test_very_long_white_space(spark):
    docs = [(1, " " * 2_000_000), (2, "a" + "\n" * 1_200_000 + " b"), (3, " x" * 200_000 + " " * 100_001 + "x")]
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    check_packing(docs, rows)


def test_plan_uses_up_any_histogram():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 400, 20_000):
        histogram = np.bincount(rng.integers(1, 65, n), minlength=65).astype(float) * rng.integers(1, 50)
        used = np.zeros(65)
        for lengths, repeats in packing.plan(64, histogram):
            assert sum(lengths) <= 64
            for v in lengths:
                used[v] += repeats
        assert (used == histogram).all()
