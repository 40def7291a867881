"""Votes of neighbours, repaired conversations, filter orders: brute force, held-out accuracy and edges."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import TaskContext

from tabsense.llm import filter_audit, latent_neighbours, turn_repair
from tabsense.llm.queries import QUERIES
from tabsense.storage import load, store

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, good int, part string, n string, _p string"
LABELS = "doc_id long, quality int, toxic int, part string"


FILL = {0: 2, 1: 2, 2: 3, 3: 2}
KEEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}


def plain_repair(signature):
    """Cheapest (cost, audit), whole audits compared, by a table over places and states."""
    best = {}
    for i in range(len(signature), -1, -1):
        c = signature[i] if i < len(signature) else None
        for s in range(4):
            options = [(0, "")] if c is None and s in (0, 3) else []
            if c is not None:
                steps = [(3, "D", s)] + ([(2 + c.isupper(), "R", FILL[s])] if c != "d" else [])
                steps += [(int(c.isupper()), "K", KEEP[c.lower(), s])] if (c.lower(), s) in KEEP else []
                options += [(cost + best[i + 1, t][0], letter + best[i + 1, t][1]) for cost, letter, t in steps]
            best[i, s] = min(options, default=(10**9, ""))
        for _ in range(6):
            for s in range(4):
                best[i, s] = min(best[i, s], (2 + best[i, FILL[s]][0], "I" + best[i, FILL[s]][1]))
    return best[0, 0]


def enumerated(signature, most):
    """Every edit sequence up to a cost, without any table: the check on the check."""
    best = (10**9, "")
    todo = [(0, "", 0, 0)]
    while todo:
        cost, audit, i, s = todo.pop()
        if cost > min(most, best[0]):
            continue
        if i == len(signature) and s in (0, 3):
            best = min(best, (cost, audit))
        todo.append((cost + 2, audit + "I", i, FILL[s]))
        if i < len(signature):
            c = signature[i]
            todo.append((cost + 3, audit + "D", i + 1, s))
            if c != "d":
                todo.append((cost + 2 + c.isupper(), audit + "R", i + 1, FILL[s]))
                if (c.lower(), s) in KEEP:
                    todo.append((cost + c.isupper(), audit + "K", i + 1, KEEP[c.lower(), s]))
    return best


def test_every_short_signature(spark):
    every = ["".join(s) for n in range(4) for s in itertools.product("suaoSUAOd", repeat=n)]
    got = {r["signature"]: (r["cost"], r["audit"]) for r in turn_repair.cheapest_edits(spark.createDataFrame([(s,) for s in every], "signature string")).collect()}
    assert got == {s: plain_repair(s) for s in every}
    for s in every[::37]:
        assert got[s] == enumerated(s, 12), s


def test_nodes_are_made_once():
    rng = np.random.default_rng(3)
    signatures = {"".join(rng.choice(list("suaUd"), rng.integers(0, 9))) for _ in range(400)}
    shared = turn_repair.Suffixes()
    found = {r[::-1]: shared.repair(r) for r in sorted(s[::-1] for s in signatures)}
    assert found == {s: plain_repair(s) for s in signatures}
    assert shared.made == len({s[i:] for s in signatures for i in range(len(s) + 1)} | {""})


def plain_conversations(rows):
    """The contract, row by row."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv]
        show = lambda v: " " if v is None else str(v)
        role, text, kind = show(role), show(text), zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, lines in groups.items():
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, signature, count = set(), "", Counter()
        for _, role, text in lines:
            body = text.strip(" \t\n\v\f\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            known = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "d" if fault in ("blank", "duplicate") else known.upper() if fault else known
        cost, audit = plain_repair(signature)
        repaired, at, state = [], 0, 0
        for e in audit:
            if e in "IR":
                repaired.append(("assistant" if state == 2 else "user") + ":" + (lines[at][2] if e == "R" else ""))
                state = FILL[state]
            elif e == "K":
                repaired.append(f"{lines[at][1]}:{lines[at][2]}")
                state = {"s": 1, "u": 2, "a": 3}[lines[at][1][0]]
            at += e != "I"
        turns = [t for t, _, _ in lines if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(lines, lines[1:]))
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_conversations_by_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = ["Yes.", "No", "", " \n", None, "What?", "a.b. ", "x!\t", "é", "long " * 30_000]
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.integers(1, 9)):
            turn = None if rng.random() < 0.1 else int(rng.integers(-3, 12))
            rows.append((conv, turn, [None, "system", "user", "assistant", "tool", "user", "assistant"][rng.integers(7)], texts[rng.integers(len(texts))]))
    rows += [(777, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3_000)]
    rows += [(778, -(1 << 63), "user", "Far."), (778, (1 << 63) - 1, "assistant", "Away.")]
    data = spark.createDataFrame([(*r, 1, "k", "s") for r in rows], "conv_id long, turn long, role string, text string, gaps int, key string, signature string")
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in turn_repair.repair(data).collect()}
    want = plain_conversations(rows)
    want[778] = (min(want[778][0], (1 << 63) - 1), *want[778][1:])
    assert got == want
    assert turn_repair.repair(data.where("false")).count() == 0


def plain_audit(docs, labels):
    first = {}
    for d, text, *_ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    fails = []
    for d, text, part, *_ in docs:
        t = text or ""
        words = t.encode().split()
        f = "A" * (len(words) < 50) + "B" * (100 * len(set(words)) < 65 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t))
        f += "D" * any(c in "#$%&*|" for c in t) + "E" * (d is not None and d > first[t])
        own = [x for x in labels if x[0] is not None and x[0] == d]
        fails.append((part or "", f, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                gone = lambda x: any(e in x for e in order[: step - 1])
                removed = [x for x in own if f in x[0] and not gone(x[0])]
                shapley[f] += len(removed)
                kept = sum(not gone(x[0]) and f not in x[0] for x in own)
                out[part, "".join(order), step] = [kept, len(removed), sum(f in x[0] and gone(x[0]) for x in own), sum(x[0] == f for x in own), sum(x[1] for x in removed), sum(x[2] for x in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_by_brute_force(spark):
    rng = np.random.default_rng(9)
    pool = ["", None, " ", "a b c", "Word " * 60, " ".join(f"w{i}" for i in range(80)), "# x", "AB c", "é ü ß\x0bq", "w | " * 40, "same same " * 40_000, "a\u0000b c"]
    docs = [(None if rng.random() < 0.05 else int(rng.integers(0, 60)), pool[rng.integers(len(pool))], [None, "", "s1", "s2"][rng.integers(4)], 1, "x", "y", "z") for _ in range(150)]
    docs += [(1000 + i, "Word " * 60, "s1", 0, "x", "y", "z") for i in range(120)]
    labels = [(int(rng.integers(0, 60)), [None, 0, 1][rng.integers(3)], [None, 0, 1][rng.integers(3)], "p") for _ in range(60)] + [(None, 1, 1, "p")]
    got = filter_audit.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS)).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == plain_audit(docs, labels)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_words_that_share_a_number(spark):
    words = spark.createDataFrame([(5, b"c"), (5, b"a"), (6, b"d"), (7, b"b"), (7, b"e")], "number long, word binary")
    assert filter_audit.shared_numbers(words) == {b"a": 0, b"b": 1, b"c": 2, b"e": 3}
    assert filter_audit.shared_numbers(words.where("number = 6")) == {}


@pytest.mark.parametrize("shared", [{}, {b"the": 0, b"of": 1}])
def test_matrix_holds_every_word(spark, monkeypatch, shared):
    docs = load(spark, FOLDER, "documents").repartition(3)
    monkeypatch.setattr(filter_audit, "shared_numbers", lambda words: shared)
    words, matrix = filter_audit.term_matrix(docs, shard_bytes=50_000)
    listed = words.collect()
    name = {r["number"]: bytes(r["word"]) for r in listed}
    assert len(name) == len(listed) and len(set(name.values())) == len(name)
    rows = {}
    shards = matrix.collect()
    for r in shards:
        assert list(r["indptr"]) == sorted(r["indptr"]) and r["indptr"][-1] == len(r["indices"]) == len(r["counts"])
        for i, d in enumerate(r["doc_ids"]):
            cells = range(r["indptr"][i], r["indptr"][i + 1])
            rows[d] = Counter({name[r["indices"][c]]: r["counts"][c] for c in cells})
    assert len(shards) > 3 and all(w not in name.values() or n in name for w, n in shared.items())
    assert rows == {r["doc_id"]: Counter((r["text"] or "").encode().split()) for r in docs.collect()}


def test_audit_passes_shards_on_singly(spark, monkeypatch, tmp_path):
    """What is in memory at once follows a shard, not the rows of a partition."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"{w:x}" for w in rng.integers(0, 1 << 24, 110_000).tolist()) for _ in range(24)]  # some 750 kB each
    docs = spark.createDataFrame([(i, t, f"s{i % 2}", 0, "x", "y", "z") for i, t in enumerate(texts)], DOCS).coalesce(1)

    def noted(make, name):
        def wrapped(*args):
            run = make(*args)

            def seen(batches):
                for i, batch in enumerate(batches):
                    (tmp_path / f"{name}-{TaskContext.get().taskAttemptId()}-{i}").write_text(f"{batch.num_rows} {batch.nbytes}")
                    yield batch

            return lambda batches: run(seen(batches))

        return wrapped

    stored = []
    for name in ("_shards", "_rewrite"):
        monkeypatch.setattr(filter_audit, name, noted(getattr(filter_audit, name), name))
    monkeypatch.setattr(filter_audit, "store", lambda df, name, **options: stored.append((name, store(df, name, **options))) or stored[-1][1])
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    got = filter_audit.audit(docs, spark.createDataFrame([], LABELS)).where("filter_order = 'ABCDE' and step = 5").collect()
    assert {r["part"]: (r["kept"], r["unique_fails"]) for r in got} == {"s0": (12, 0), "s1": (12, 0)}
    assert spark.conf.get(key) == before
    for name, most in (("_shards", 6e6), ("_rewrite", 12e6)):
        sizes = [tuple(map(int, p.read_text().split())) for p in tmp_path.glob(f"{name}-*")]
        assert len(sizes) > 2 and all(n == 1 or size <= most for n, size in sizes)
    groups = [m.row_group(i) for f in dict(stored)["shards"].inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for i in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 3 and all(g.num_rows == 1 or g.total_byte_size < 20e6 for g in groups)


def test_votes_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in QUERIES["op11_quality_votes"](spark, folder).collect()}
    assert len(rows) == load(spark, folder, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for d, r in rows.items())
    known = [(rows[r["doc_id"]]["score"], r["quality"]) for r in load(spark, folder, "labels").collect() if rows[r["doc_id"]]["held_out"]]
    good, bad = [s for s, q in known if q == 1], [s for s, q in known if q == 0]
    assert len(bad) >= 3 and np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.98
    assert np.mean([s >= 0.3 for s in good]) > 0.97 and np.mean([s < 0.3 for s in bad]) > 0.8


def test_votes_equal_plain_votes(spark):
    docs = load(spark, FOLDER, "documents")
    labels = load(spark, FOLDER, "labels")
    texts = docs.selectExpr("doc_id", "coalesce(text, '') AS text")
    model = latent_neighbours.learn(texts, labels)
    held = {r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    assert len(model.labels) == len(held) and np.allclose(np.linalg.norm(model.vectors, axis=1), 1, atol=1e-4)
    total, found = latent_neighbours.document_frequencies(texts)
    plain = Counter()
    for r in docs.collect():
        plain.update(set(latent_neighbours.term_counts(pa.array([r["text"] or ""]))[1].tolist()))
    assert total == docs.count() and {i: int(n) for i, n in enumerate(found) if n} == dict(plain)
    got = {r["doc_id"]: r["score"] for r in latent_neighbours.score(docs, labels, model=model).collect()}
    for r in docs.limit(40).collect():
        v = latent_neighbours.latent(latent_neighbours.weighted(pa.array([r["text"] or ""]), model.idf), model.basis)[0]
        sims = sorted(((max(0.0, round(float(v @ w), 6)), y) for w, y in zip(model.vectors, model.labels)), reverse=True)
        near = [x for x in sims if x[0] >= sims[latent_neighbours.NEIGHBOURS - 1][0] and x[0] > 0]
        want = sum(s * y for s, y in near) / sum(s for s, _ in near) if near else model.labels.mean()
        assert got[r["doc_id"]] == pytest.approx(want, abs=2e-3)


def test_votes_edges(spark):
    odd = [(1, None, "s", 1, "p", "n", "q"), (1, "", "s", 1, "p", "n", "q"), (None, "x " * 200_000, None, 1, "p", "n", "q"), (2, " ", "s", 1, "p", "n", "q"), (3, "A!! B!!", "s", 1, "p", "n", "q")]
    docs = spark.createDataFrame(odd, DOCS)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, None, 0, "x"), (2, 0, 0, "x"), (3, 1, 1, "x"), (None, 1, 1, "x")], LABELS)
    assert latent_neighbours.score(docs, labels).count() == len(odd)
    assert {r["score"] for r in latent_neighbours.score(docs, labels.where("false")).collect()} == {0.5}
    assert latent_neighbours.score(docs.where("false"), labels).count() == 0
