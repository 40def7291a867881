"""Ledger, duplicates, licenses, personal data, preferences and web records: edges and brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from oracle_check import compare, connect
from tabsense.llm import bbit_minhash, content_sort, licenses, preferences, quality_ledger, skip_chain, warc
from tabsense.llm.queries import QUERIES, SQL
from tabsense.storage import load

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, n_words string, _row string, kept string"
ODD = [(1, None), (1, None), (None, None), (2, ""), (3, " \n\t "), (4, "a b c d e " * 40), (5, "x"), (6, "Y " * 30_000), (7, "Same text here"), (8, "same TEXT here"), (9, "Éa éa"), (None, "q w e r t")]


def odd(spark, rows=ODD):
    return spark.createDataFrame([(*r, "w", "r", "k") for r in rows], SCHEMA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    ok, detail, _, _ = compare(spark, connect(FOLDER), FOLDER, name, QUERIES[name], SQL[name])
    assert ok, detail


def plain_repeats(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(grams)
    return len({p for i, g in enumerate(grams) if count[g] > 1 for p in range(i, i + 5)})


def test_ledger_edges(spark):
    rows = quality_ledger.apply_policy(quality_ledger.ledger(odd(spark)), "base").collect()
    want = Counter()
    for d, t in ODD:
        words = (t or "").encode().split()
        want[(d, len(words), plain_repeats(words))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_repeat_words"]) for r in rows) == want
    assert all(r["kept"] == (r["n_words"] >= 10 and 100 * r["n_repeat_words"] <= 20 * r["n_words"]) for r in rows)
    assert quality_ledger.keep_good(odd(spark)).columns == odd(spark).columns
    assert quality_ledger.ledger(odd(spark, [])).count() == 0
    table = {(r["version"], r["rule"]): r for r in quality_ledger.ablations(quality_ledger.ledger(odd(spark))).collect()}
    assert table["base", "few_words"]["n_rows"] == len(ODD) and table["base", "repeated_windows"]["n_failed"] == 2


@pytest.mark.parametrize("part_rows", [1, 1_000])
def test_exact_duplicates_edges(spark, monkeypatch, part_rows):
    monkeypatch.setattr(content_sort, "PART_ROWS", part_rows)
    for keep in ("smallest", "largest"):
        rows = content_sort.duplicate_groups(odd(spark), keep=keep).collect()
        groups = defaultdict(list)
        for d, t in ODD:
            groups[re.sub("[A-Z]", lambda m: m.group().lower(), t or "")].append(d)
        assert len(rows) == len(ODD) and sum(r["kept"] for r in rows) == len(groups)
        for text, ids in groups.items():
            own = [r for r in rows if r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()]
            known = [i for i in ids if i is not None]
            best = (max if keep == "largest" else min)(known) if known else None
            assert {r["keep_id"] for r in own} == {best} and {r["group_size"] for r in own} == {len(ids)}
        assert content_sort.drop_copies(odd(spark), keep=keep).count() == len(groups)
    assert content_sort.duplicate_groups(odd(spark, [])).count() == 0


def test_neighbours_decide_all_copies(spark):
    docs = load(spark, "/root/testdata/sf0.01", "documents")
    by_sort = content_sort._neighbours(content_sort._source(docs, "doc_id", "text", F.col("text")), F.col("text"), True)
    texts = Counter(re.sub("[A-Z]", lambda m: m.group().lower(), r["text"] or "") for r in docs.select("text").collect())
    copies = sum(n - 1 for n in texts.values())
    assert copies > 50 and by_sort.where("_place > 1 and _parts is null").count() == copies


def test_large_groups_in_parts(spark, monkeypatch):
    monkeypatch.setattr(content_sort, "PART_ROWS", 7)
    rows = [(i % 90, "Same " * 50 if i % 3 else "other", "w", "r", "k") for i in range(300)] + [(None, "SAME " * 50, "w", "r", "k")] * 40 + [(500 + i, f"t{i}", "w", "r", "k") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    out = content_sort.duplicate_groups(docs, keep="largest").collect()
    assert Counter((r["group_size"], r["keep_id"]) for r in out if r["group_size"] > 1) == {(240, 89): 240, (100, 87): 100}
    assert sum(r["kept"] for r in out) == 22 and content_sort.drop_copies(docs, keep="largest").count() == 22


def test_a_large_group_of_copies_meets_across_salts(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("text"))
    rows = content_sort.duplicate_groups(docs, keep="largest").where("keep_id = 4998").agg(F.count(F.lit(1)), F.sum(F.col("kept").cast("int")), F.min("group_size")).first()
    assert tuple(rows) == (2500, 1, 2500)


def brute_components(docs, percent):
    sets = {d: bbit_minhash.shingle_set((t or "").encode().lower().split()) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize("tile", [512, 3])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(bbit_minhash, "TILE", tile)
    base = [f"w{i}" for i in range(120)]
    planted = [(10_000 + i, " ".join([*base[: 100 + i % 20], *(f"v{i}{j}" for j in range(i % 7))])) for i in range(40)]
    docs = [(r["doc_id"], r["text"]) for r in load(spark, FOLDER, "documents").collect()] + planted
    got = bbit_minhash.near_duplicates(odd(spark, docs), percent=85).collect()
    want = brute_components(docs, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(spark):
    rows = bbit_minhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] in (7, 8)} == {(7, 7), (8, 7)}
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert bbit_minhash.near_duplicates(odd(spark, [])).count() == 0
    assert bbit_minhash.drop_near_copies(odd(spark)).count() == len(ODD) - 1


def test_licenses_against_the_definition(spark):
    docs = [(r["doc_id"], r["text"]) for r in load(spark, FOLDER, "documents").collect()] + ODD
    docs += [(-1, "The MIT-License and the mit  license"), (-2, "Licensed under the Apahce License, Version 2.0"), (-3, "summit license"), (-4, "permission is hereby granted, free of charge, to any persn obtaining a copy")]
    got = Counter()
    labels = {}
    for r in licenses.scan(odd(spark, docs)).collect():
        got[(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])] += 1
        labels[r["doc_id"]] = (r["labels"], r["score"])
    want = Counter()
    for d, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        want[(d, len(words), len(hits), min(hits)[0] if hits else None, max(hits)[0] if hits else None, ",".join(sorted({x for _, x in hits})))] += 1
    assert got == want
    assert labels[-2][0] == "apache" and 0.9 < labels[-2][1] < 1 and labels[-4][0] == "mit" and labels[-3] == ("", 0.0)


def test_adjacent_notices_are_all_found():
    cases = {
        "mit lisense mit license": ["mit:0:2:1", "mit:2:4:0"],
        "mit lisense or mit license": ["mit:0:2:1", "mit:3:5:0"],
        "mit license mit lisense mit license": ["mit:0:2:0", "mit:2:4:1", "mit:4:6:0"],
        "genral public license general public license": ["gpl:0:3:1", "gpl:3:6:0"],
        "genrl public license genral public license general public license": ["gpl:0:3:2", "gpl:3:6:1", "gpl:6:9:0"],
        "all right reserved all rights reserved": ["reserved:0:3:1", "reserved:3:6:0"],
        "mit licens mit license": ["mit:0:2:1", "mit:2:4:0"],
        "mit license": ["mit:0:2:0"],
    }
    for text, want in cases.items():
        found = licenses.Matcher().find(text.split())
        assert [f"{f.label}:{f.start}:{f.end}:{f.errors}" for f in found] == want, text


def test_personal_data_against_the_patterns(spark):
    docs = [(r["doc_id"], r["text"]) for r in load(spark, "/root/testdata/sf0.01", "documents").collect()] + ODD
    docs += [(-1, "a@b.c, a@b@c.de x@y 1.2.3.4.5 256.1.1.1 001.02.3.4 " + "9" * 5000 + ".1.1.1"), (-2, "+1 (988) 555-2485 and later (988) 555-2485"), (-3, "4387 5130 3523 7269; 4387-5130-3523-7260"), (-4, "@" * 3000), (-5, "1 " * 3000)]
    card = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    want = Counter()
    for d, t in docs:
        t = t or ""
        found = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split(".") if len(p) < 4000) and len(m.group()) < 4000]
        found += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(re.sub("[ -]", "", m.group())) <= 19 and card(re.sub("[ -]", "", m.group()))]
        found += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))
        want[(d, *[sum(f[1] == i for f in found) for i in range(4)], hashlib.sha256(line.encode()).hexdigest())] += 1
    rows = skip_chain.find(odd(spark, docs)).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows) == want
    assert skip_chain.find(odd(spark, [])).count() == 0


AGAIN = [
    ("call +1 (988) 555-2485 now. Later 9885552485 again", "only 9885552485 here", "phone"),
    ("+1 (988) 555-2485 and later (988) 555-2485", "only (988) 555-2485 here", "phone"),
    ("id 97.51.17.173 y 97-51-17-173 z", "only 97-51-17-173 here", "ip"),
    ("und.34@mail7.example.com then und.34@mail7 twice", "only und.34@mail7 here", "email"),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" then 04dbebab91ab85687d33eeaaf9ac699e1188f962', "only 04dbebab91ab85687d33eeaaf9ac699e1188f962 here", "secret"),
]


@pytest.fixture(scope="module")
def weights(spark):
    return skip_chain.learn(load(spark, "/root/testdata/sf0.1", "documents"))


@pytest.mark.parametrize("text,bare,kind", AGAIN)
def test_ties_decide(spark, weights, text, bare, kind):
    """A token that repeats a sure one gets a span; it has none by itself, nor with the ties cut."""
    unary, table = weights
    cut = table.copy()
    cut[1] = 0
    spans = lambda t, w: [(skip_chain.KINDS[k], t[s:e]) for s, e, k in skip_chain.added_spans(t, skip_chain.base_spans(t), w)]
    with_ties, without = spans(text, weights), spans(text, (unary, cut))
    assert with_ties[-1][0] == kind and len(with_ties) == len(without) + 1 and not spans(bare, weights)
    head, _, tail = text.rpartition(" ")
    far = f"{head} {'word ' * 30_000}{tail}" if kind != "phone" else text
    assert [x[0] for x in spans(far, weights)] == [x[0] for x in with_ties]
    got = skip_chain.find(odd(spark, [(1, text), (2, bare)]), weights=weights).collect()
    assert [r["n_spans"] for r in sorted(got, key=lambda r: r["doc_id"])] == [len(with_ties) + len(skip_chain.base_spans(text)), 0]


def test_message_passing_is_exact_on_a_chain():
    import numpy as np

    rng = np.random.default_rng(1)
    field = skip_chain.Field("1 2 3")
    k = len(skip_chain.LABELS)
    unary, table = rng.normal(size=(skip_chain.N_FEATURES, k)), rng.normal(size=(2, k, k))
    table = table + table.transpose(0, 2, 1)
    for known in (None, np.array([0, 0, 2])):
        own = np.exp(field.features() @ unary)
        if known is not None:
            own[2] = np.eye(k)[2]
        joint = np.einsum("a,b,c,ab,bc->abc", own[0], own[1], own[2], np.exp(table[0]), np.exp(table[0]))
        joint /= joint.sum()
        want = [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]
        assert np.allclose(skip_chain.marginals(field, unary, table, known, 80), want, atol=1e-3)


def test_long_texts_of_numbers(weights):
    import time
    import tracemalloc

    text = "\n".join(str(10**9 + i * 7919) for i in range(100_000)) + " +1 (988) 555-2485 " + "x " * 200_000 + "9885552485"
    tracemalloc.start()
    start = time.time()
    found = skip_chain.added_spans(text, skip_chain.base_spans(text), weights)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert [text[s:e] for s, e, _ in found] == ["9885552485"]
    assert peak < 100e6 and time.time() - start < 120


def test_preferences_edges(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "a"), (1, 0, "user", None), (1, 1, "assistant", None), (1, 2, None, "x"), (2, 0, "user", "no reply"), (None, 0, "assistant", "n")]
    rows = preferences.format_pairs(preferences.swapped_replies(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    got = {r["pair_id"]: r for r in rows}
    assert set(got) == {0, 1} and got[0]["prompt"] == "<|user|>\nhi<|end|>\n" and got[0]["rejected"] == "<|assistant|>\n<|end|>\n"
    s, e = map(int, got[0]["chosen_mask"].split(":"))
    assert got[0]["chosen"][s:e] == "a<|end|>" and got[0]["usable"]
    same = spark.createDataFrame([(1, [("u", "x")], [("u", "x")]), (2, None, [("assistant", "y")])], "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    assert [(r["n_prompt_turns"], r["usable"]) for r in preferences.format_pairs(same).orderBy("pair_id").collect()] == [(1, False), (0, False)]


def test_web_records_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a/b", "<html lang='x'><p>Ünï &amp;lt; <b>b</b></p><a href=\"/x?a=1&amp;b=2\">l</a>"), (2, None, None), (None, "u\r\nv", "<!-- x"), (2, None, None)], "page_id long, url string, html string")
    made = warc.derive(warc.responses_of_pages(pages))
    back = warc.parse_records(warc.as_records(made)).collect()
    assert len(back) == 8
    for r in back:
        assert r["fields"]["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(r["block"].encode()).hexdigest()
    text = {(r["page_id"], r["record_type"]): r["block"] for r in made.collect()}
    assert text[1, "conversion"] == "Ünï &lt; b\nl" and "outlink: /x?a=1&b=2" in text[1, "metadata"] and text[2, "conversion"] == ""
    assert {r["refers_to"] for r in made.collect()} == {r["record_id"] for r in warc.responses_of_pages(pages).collect()}


def test_an_id_with_several_texts_links_as_each(spark):
    a, b = ("a%d" % i for i in range(60)), ("b%d" % i for i in range(60))
    a, b = " ".join(a), " ".join(b)
    docs = odd(spark, [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, a), (4, a), (9, "only this one text here now")])
    rows = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in bbit_minhash.near_duplicates(docs).collect())
    assert rows == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (4, 1, False), (9, 9, True)]
    more = odd(spark, [(5, a), (5, b), (2, a + " z"), (7, b + " z")])
    got = bbit_minhash.near_duplicates(more).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == {(5, 2): 1, (5, 5): 1, (2, 2): 1, (7, 5): 1}
    assert sorted((r["doc_id"], r["text"][:2]) for r in bbit_minhash.drop_near_copies(more).collect()) == [(2, "a0"), (5, "b0")]


def test_a_frequent_class_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(bbit_minhash, "PAIRS_PER_TASK", 3)
    from tabsense.llm import common

    monkeypatch.setattr(common.join_by_size, "__defaults__", ("inner", 5))
    base = [f"w{i}" for i in range(200)]
    near = [(100 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    docs = odd(spark, [(7, " ".join(base)), *near, *[(500 + i, " ".join(base)) for i in range(30)], (999, "far from all the others here")])
    rows = {r["doc_id"]: r["component_id"] for r in bbit_minhash.near_duplicates(docs).collect()}
    assert rows == {**{d: 7 for d in rows}, 999: 999} and len(rows) == 72


PAGES = [
    ("<html lang=de><title>A &amp; B\n c</title><body>x&copy;&#8212;&#xe9;&eacute;&nbsp;y &bogus; &amp;lt;<a class='k' href='/q?a=1&amp;b=2'>l</a><a href=/bare>m</a>",
     ("A & B c", "de", ["/q?a=1&b=2", "/bare"]), "A & B\nc\nx\u00a9\u2014\u00e9\u00e9\u00a0y &bogus; &lt;lm"),
    ("<HTML data-lang='no' LANG = 'fr'><head><title>T</title></head><p>one<p>two<br>three</p><a data-href='/no'>z</a>", ("T", "fr", []), "one\ntwo\nthree\nz"),
    ("a<script>b</script>c<script>d<p>e", ("", "", []), "a cd\ne"),
    ("x <!-- y --> z <!-- w > v", ("", "", []), "x z v"),
    ("<title>open <a href=\"u\nv\">t</a> 1 < 2", ("", "", ["u v"]), "open t 1 < 2"),
    ("", ("", "", []), ""),
]


@pytest.mark.parametrize("page,facts,text", PAGES)
def test_pages_by_hand(page, facts, text):
    assert warc.page_facts(page) == facts
    assert warc.plain_text(page) == text


@pytest.mark.parametrize("part", ["<script>", "<!--", "<style ", "<head><", "<", "<a ", "<title>", "<a href=\"", "</script ", "&amp", "<p ", "-->", "<script <"])
def test_unclosed_markup_is_read_once(part):
    import time

    start = time.time()
    for page in (part * (1_000_000 // len(part)), part * (500_000 // len(part)) + "></script></title>-->"):
        warc.plain_text(page)
        warc.page_facts(page)
    assert time.time() - start < 10


def test_web_records_edges(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, block string, record_id string")
    assert warc.derive(warc.responses_of_pages(empty)).count() == 0
    odd = spark.createDataFrame([(1, "u", "<p>" + "w " * 400_000, "b", "r"), (1, "u", "<p>" + "w " * 400_000, "b", "r")], empty.schema)
    made = warc.derive(warc.responses_of_pages(odd)).where("record_type = 'conversion'").collect()
    assert len(made) == 2 and {r["content_length"] for r in made} == {799_999} and len({r["record_id"] for r in made}) == 1


def plain_distance(phrase, words):
    """Edits between a phrase and words joined by spaces."""
    text = " ".join(words)
    row = list(range(len(text) + 1))
    for i, a in enumerate(phrase, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_fuzzy_spans_by_edit_distance():
    """Each reported span has the errors that the plain table says, and no run of words that is near enough is without a span."""
    import random

    rng = random.Random(8)
    notices = {"mit license": "mit", "general public license": "gpl", "all rights reserved": "reserved"}
    matcher = licenses.Matcher(notices)
    for _ in range(60):
        words = []
        for _ in range(12):
            phrase = list(rng.choice(list(notices)))
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                at = rng.randrange(len(phrase))
                phrase[at : at + rng.choice((0, 1))] = rng.choice(("", "x", "e", " "))
            words += "".join(phrase).split() + [rng.choice(("and", "or", "mit", "the", "all"))] * rng.choice((0, 1))
        found = matcher.find(words)
        for f in found:
            phrase = next(p for p, label in notices.items() if label == f.label)
            assert plain_distance(phrase, words[f.start : f.end]) <= f.errors <= len(phrase) // 10
        for phrase, label in notices.items():
            own = [f for f in found if f.label == label]
            assert all(a.end <= b.start for a, b in zip(own, own[1:]))
            n = phrase.count(" ") + 1
            for s in range(len(words)):
                for e in range(s + 1, min(len(words), s + n + 1) + 1):
                    d = plain_distance(phrase, words[s:e])
                    if d <= len(phrase) // 10:
                        assert any(f.start < e and s < f.end and f.errors <= d for f in own), (words, phrase, s, e, d, own)


@pytest.mark.parametrize("notice", ["mit license", "mit lisense", "genral public license", "permission is hereby granted free of charge to any persn obtaining a copy", "mit licens e x"])
def test_a_megabyte_of_notices(notice):
    import time

    words = (notice + " ") * (1_000_000 // (len(notice) + 1))
    start = time.time()
    places, found = licenses.exact_places(words.split()), licenses.Matcher().find(words.split())
    assert time.time() - start < 60
    n = words.count(notice)
    assert len(places) == (n if notice == "mit license" else 0)
    assert len(found) >= n
