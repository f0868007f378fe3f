"""Periodic runs, ranked search and personal data against brute force, with the defined odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codestrata.llm import periodic, pii, ranked

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SCHEMA = "doc_id long, text string, runs int, n_words string, collapsed int, query string, rank int, base_spans int, clean_text long, flagged string, text_key int, __pii_key string"
ODD = [(1, "a b " * 9), (1, "a b " * 9), (2, None), (3, ""), (None, "no id a b c a b c a b c a b c"), (4, " \t\n\x0b "), (5, "x " * 30_000), (6, "é 中\U0001f600 " * 13), (7, "</s> ~1 -" + "q" * 50_000)]


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, "q", 3, 4, 5, "f", 6, "k") for i, t in rows], SCHEMA)


# 11


def slow_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > at and end + q - at >= max(least, 2 * q):
                found.setdefault((at, end + q - at), q)
            at = max(end, at + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def slow_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = [b"w%d" % rng.randrange(rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(0, 60))]
            if words and rng.random() < 0.6:
                a, p = rng.randrange(len(words)), rng.randint(1, 9)
                words = [w if i < a else words[min(a + (i - a) % p, len(words) - 1)] for i, w in enumerate(words)]
            texts.append(words)
        for words, runs in zip(texts, periodic.search(texts, least)):
            got = [tuple(r) for r in runs.tolist()]
            assert got == sorted(slow_runs(words, least), key=lambda r: (r[0], r[2]))
            assert periodic.collapse(words, runs) == slow_kept(words, got)


def test_branching_repeats_are_few(monkeypatch):
    """Chunks of any size give the same repeats; smaller halves visit n log n leaves at most."""
    words = [b"%d" % (bin(i).count("1") % 2) for i in range(4000)]  # no cubes, many squares
    whole = periodic.search([words], 4)[0]
    monkeypatch.setattr(periodic, "CHUNK", 7)
    assert np.array_equal(whole, periodic.search([words], 4)[0])
    assert [tuple(r) for r in whole.tolist()][:50] == sorted(slow_runs(words[:600], 4), key=lambda r: (r[0], r[2]))[:50]


def test_runs_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc_id, text in docs:
        words, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = slow_runs(words) if n < 2500 else [tuple(r) for r in periodic.search([[w.encode() for w in words]])[0].tolist()]
        runs = sorted(runs, key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want[doc_id] = (
            len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(slow_kept(words, runs)).encode()).hexdigest(),
        )
    got = {r.doc_id: tuple(r)[1:] for r in periodic.op11_periodic_runs(spark, SF).collect()}
    assert got == want and sum(x[0] > 0 for x in want.values()) >= 10


def test_runs_odd_rows(spark):
    docs = clashing(spark, ODD)
    out = periodic.periodic_runs(docs)
    assert [c for c in docs.columns if c not in periodic.ADDED] == out.columns[:-3]
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(ODD)
    assert [tuple(x) for x in got[1].runs] == [(0, 18, 2)] and got[1].collapsed == "a b"
    assert [tuple(x) for x in got[5].runs] == [(0, 30_000, 1)] and got[5].collapsed == "x" and got[5].n_words == 30_000
    assert [tuple(x) for x in got[None].runs] == [(2, 12, 3)] and got[None].collapsed == "no id a b c"
    assert [tuple(x) for x in got[6].runs] == [(0, 13, 1)] and all(got[i].runs == [] for i in (2, 3, 4, 7)) and got[2].collapsed == ""
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = periodic.planted(spark.createDataFrame([(i, t) for i in (None, *range(60)) for t in (None, "", "one")], "doc_id long, text string"))
    assert {r.text for r in rows.collect()} == {None, "", "one"}


# 12


def slow_search(docs, items, k=20):
    words = [(i, TERM.findall("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t or ""))) for i, t in docs]
    words = [(i, w, Counter(w)) for i, w in words if w]
    n, total, df = len(words), sum(len(w) for _, w, _ in words), Counter(t for _, _, c in words for t in c)
    out = []
    for item, text in items:
        asked = TERM.findall("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
        scores = []
        for i, w, c in words:
            m = 75 + 25 * len(w) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in asked if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("docs_a_shard, cells", [(1 << 14, 1 << 16), (7, 1 << 16), (50, 16)])
def test_search_equals_brute_force(spark, monkeypatch, docs_a_shard, cells):
    monkeypatch.setattr(ranked, "SHARD_DOCS", docs_a_shard)
    monkeypatch.setattr(ranked, "CELLS", cells)
    rng = random.Random(docs_a_shard)
    word = lambda: "".join(rng.choices(["a", "B", "é", "7", "of", "the"], k=rng.randint(1, 3)))
    docs = [(rng.choice([i, i, 5, None]), " ".join(word() for _ in range(rng.choice([0, 3, 20, 60])))) for i in range(300)]
    docs += [(900, docs[10][1]), (901, docs[10][1]), (902, None), (903, "!?"), (904, "the " * 20_000)]
    items = [(1, "the of a the"), (1, "B-é 7"), (2, None), (3, ""), (None, "THE"), (4, "nowhere"), (5, " ".join(word() for _ in range(200)))]
    data = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, score int, query string").repartition(3)
    got = ranked.search(data, spark.createDataFrame(items, "item_id long, text string"), 20, 300)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == slow_search(docs, items)


def test_search_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.search(docs, items).collect() == [] and ranked.search(items.withColumnRenamed("item_id", "doc_id"), items.filter("false")).collect() == []


def test_walk_prunes():
    """A rare term's treap keeps the walk from documents that hold common terms only."""
    rng, n = np.random.default_rng(1), 20_000
    term = np.concatenate([np.full(n, 1), np.full(30, 2)])
    doc = np.concatenate([np.arange(n), np.sort(rng.choice(n, 30, False))])
    impact = np.concatenate([rng.integers(1, 900, n), np.full(30, 800)])
    treaps, seen = ranked.Treaps(term, doc, impact, n), []
    impacts = treaps.impacts
    treaps.impacts = lambda t, d: seen.append(len(d)) or impacts(t, d)
    best = ranked.walk(treaps, np.array([[1, 2, -1]]), np.array([[2, 90, 0]]), 20)
    score = np.bincount(doc, impact * np.where(term == 1, 2, 90), n).astype(int)
    order = np.lexsort((np.arange(n), -score))[:20]
    assert best.doc.tolist() == order.tolist() and best.score.tolist() == score[order].tolist()
    assert sum(seen) < 200


# 13


def luhn(digits):
    return sum((x := int(c) * (1 + i % 2)) - 9 * (x > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def slow_base(text):
    out, digits = [], lambda m: re.sub("[^0-9]", "", m)
    for k, pattern, good in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ):
        out += [(k, *m.span(), m[0]) for m in re.finditer(pattern, text or "") if good(m[0])]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_base_spans_equal_the_patterns():
    rng, n = random.Random(5), 0
    for _ in range(40_000):
        text = "".join(rng.choices(rng.choice(["a@.b1-_", "1.2 ", "01 -", "+1 (2).-", "a@.+1 -", "12.@aé\U0001f600 +"]), k=rng.randint(0, 40)))
        got = [x[:3] for x in pii.base_spans(text)]
        n += len(got)
        assert got == [x[:3] for x in slow_base(text)], text
    assert n > 1000 and pii.base_spans(None) == []


def test_base_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pii.op13_pii(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        base = slow_base(text)
        line = ",".join(f"{k}:{s}:{e}" for k, s, e, _ in base)
        assert tuple(got[i])[1:6] == (*(sum(x[0] == k for x in base) for k in pii.KINDS), hashlib.sha256(line.encode()).hexdigest())
        assert [x for x in got[i].spans.split(",") if x and not x.startswith(("general", "removed"))] == [x for x in line.split(",") if x]


def slow_disclosing(texts, threshold, least):
    """Flagged terms of each different text, by counting all pairs."""
    texts = {t for t in texts if t}
    held, every = {}, defaultdict(set)
    for t in texts:
        words = {m.lower() for m in TERM.findall(t)}
        for w in words | {w[:4] + "*" for w in words if len(w) > 4}:
            every[w].add(t)
        base = pii.base_spans(t)
        if base:
            words = {m.lower() for m in TERM.findall(pii.masked(t, base))}
            held[t] = {f"{k}:{v}" for k, _, _, v in base}, words | {w[:4] + "*" for w in words if len(w) > 4}
    at = defaultdict(set)
    for t, (entities, _) in held.items():
        for e in entities:
            at[e].add(t)
    flagged = defaultdict(set)
    for t, (entities, words) in held.items():
        for e in entities:
            for w in words:
                both, n = sum(w in held[x][1] for x in at[e]), len(texts)
                if len(at[e]) >= least and both >= least and len(at[e]) < n:
                    if math.log(both * n / (len(every[w]) * len(at[e]))) / math.log(n / len(at[e])) >= threshold - 1e-9:
                        flagged[t].add(w)
    return flagged


@pytest.mark.parametrize("most", [100_000, 0])
def test_disclosing_terms_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "BROADCAST_ROWS", most)
    rng = random.Random(9)
    common, rows = [f"word{i}" for i in range(30)], []
    for i in range(150):
        words = rng.choices(common, k=12)
        if i % 5 == 0:
            who = i % 4
            words += [f"boss{who}@firm.example", f"falcon{who}", "projekt" if who == 1 else "other", rng.choice(["+1 (212) 555-0199", ""])]
        if i % 29 == 0:
            words += ["falcon0"]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(500 + i, rows[5][1]) for i in range(9)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, entity string, flagged int")
    want = slow_disclosing([t for _, t in rows], 0.9, 3)
    got = {bytes(r.text_key): set(r.flagged) for r in pii.disclosing(docs)[1].collect()}
    assert got == {hashlib.md5(t.encode()).digest(): w for t, w in want.items()} and want
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert len(out) == len(rows) and pii.sanitise(docs).columns == [*docs.columns, *pii.ADDED]
    for i, text in rows:
        spans = [(x.kind, text[x.start : x.end].lower()) for x in out[i].added_spans]
        words = {w for w in want.get(text, ()) if not w.endswith("*")}
        assert {w for _, w in spans} == words
        assert all((k == "general") == (len(w) > 4 and w[:4] + "*" not in want[text]) for k, w in spans)
        if not pii.base_spans(text):
            assert out[i].clean_text == text and not spans
        assert not any(e.split(":", 1)[1] in out[i].clean_text for e in {f"x:{v}" for k, _, _, v in pii.base_spans(text) if k == "email"})


def test_sanitise_odd_rows(spark):
    docs = clashing(spark, [*ODD, (8, "a@b.c " * 20_000), (9, "+1 555 555 5555, 1.2.3.4, 4111 1111 1111 1111")])
    got = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert len(got) == 10 and got[2].clean_text is None and got[3].base_spans == [] and len(got[8].base_spans) == 20_000
    assert got[9].clean_text == "[phone], [ip], [card]" and got[7].clean_text == ODD[8][1]
    assert pii.sanitise(spark.createDataFrame([], "doc_id long, text string")).collect() == []
