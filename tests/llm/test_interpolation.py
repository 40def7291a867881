"""Deleted interpolation against plain counting."""

import math
from collections import Counter

import numpy as np
import pytest

from tabsense.llm import interpolation as lm
from tabsense.llm.common import words_of
from tabsense.storage import load

FOLDER = "/root/testdata/sf0.01"


def plain(docs):
    """Scores by dictionaries; the weights from the same summary cells."""
    parts = {0: [], 1: [], 2: []}
    texts = [(d, lm.part_of(d), [*words_of(t or ""), b"\n"]) for d, t in docs]
    uni, pair = [Counter(), Counter()], [Counter(), Counter()]
    for d, part, tokens in texts:
        parts[part].append(tokens)
        if part < 2:
            uni[part].update(tokens)
            pair[part].update(zip([b"\n", *tokens], tokens))
    all_uni, all_pair = uni[0] + uni[1], pair[0] + pair[1]
    total, kept, kinds = sum(all_uni.values()), sum(uni[0].values()), len(all_uni)
    level = lambda c: min(int(math.floor(math.log2(c + 1))), lm.LEVELS - 1)
    step = lambda p: 0 if p == 0 else int(min(max(np.rint(-2 * np.log2(p)) + 1, 1), lm.STEPS - 1))
    cells = Counter()
    for tokens in parts[1]:
        for a, b in zip([b"\n", *tokens], tokens):
            c = uni[0][a]
            cells[(level(c) * lm.STEPS + step(pair[0][a, b] / max(c, 1))) * lm.STEPS + step(uni[0][b] / max(kept, 1))] += 1
    weights = lm.learn_weights(np.array(list(cells), np.int64), np.array(list(cells.values()), float), 1 / (kinds + 1))
    out = []
    for d, part, tokens in texts:
        base = model = 0.0
        for a, b in zip([b"\n", *tokens], tokens):
            c = all_uni[a]
            w = weights[level(c)]
            base += math.log10((all_uni[b] + 1) / (total + kinds + 1))
            model += math.log10(w[0] * all_pair[a, b] / max(c, 1) + w[1] * all_uni[b] / max(total, 1) + w[2] / (kinds + 1))
        out.append((d, part == 2, len(tokens), sum(all_uni[t] > 0 for t in tokens), total, base, model))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted([tuple(r) for r in got], key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9) if want else not got


@pytest.mark.parametrize("block,bucket", [((200_000, 1_500_000), (200_000, 4_000_000)), ((3_000, 3_000), (5_000, 5_000)), ((100, 10_000_000), (100, 10_000_000))])
def test_against_plain_counting(spark, monkeypatch, block, bucket):
    monkeypatch.setattr(lm, "BLOCK", block)
    monkeypatch.setattr(lm, "BUCKET", bucket)
    docs = load(spark, FOLDER, "documents")
    got = lm.score(docs).collect()
    same(got, plain([(r["doc_id"], r["text"]) for r in docs.collect()]))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edges(spark):
    schema = "doc_id long, text string, block string, tokens string, part string"
    docs = [(1, None), (1, None), (2, ""), (None, "a A a"), (4, "a b"), (5, "x " * 5000), (6, "a b"), (6, "a b")]
    frame = spark.createDataFrame([(*d, "b", "t", "p") for d in docs], schema)
    same(lm.score(frame).collect(), plain(docs))
    same(lm.score(frame.where("doc_id = 1")).collect(), plain(docs[:2]))
    assert lm.score(frame.where("false")).count() == 0


def test_weights_are_learned():
    # contexts of level 5 are always right about the next word, those of level 2 never
    cells = np.array([(5 * lm.STEPS + 1) * lm.STEPS + 21, (2 * lm.STEPS + 0) * lm.STEPS + 9])
    weights = lm.learn_weights(cells, np.array([100.0, 100.0]), 1e-6)
    assert weights[5, 0] > 0.98 and weights[2, 1] > 0.98 and np.allclose(weights.sum(axis=1), 1)


def test_messages_grow_with_the_corpus():
    """Blocks times buckets, for corpora from 0.1 GB to 40 GB."""
    messages = {}
    for tokens in (20_000_000, 100_000_000, 1_000_000_000, 6_000_000_000):
        block, bucket = lm.sizes(tokens)
        messages[tokens] = (tokens / block) * (tokens / bucket) / tokens
        assert lm.BLOCK[0] <= block <= lm.BLOCK[1] and lm.BUCKET[0] <= bucket <= lm.BUCKET[1]
    assert max(messages.values()) <= 2.1 * min(messages.values())
