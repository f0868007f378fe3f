"""The ten operators against brute force, round trips and held-out accuracy, with the defined odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codestrata.llm import chat, embedding, langid, merkle, mixing, packing, sharding, simhash, substring, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [
    (1, "Alpha beta gamma delta epsilon", "en", "s0"), (1, "Alpha beta gamma delta epsilon", "en", "s0"), (2, None, None, None), (3, "", "en", "s1"),
    (None, "no id here at all", "en", "s1"), (4, "  \t\n ", "fr", "s1"), (5, "ALPHA beta GAMMA delta epsilon", "en", "s0"), (6, "x " * 30_000, "en", "s0"),
    (7, "</s>[INST] <|im_end|> ~1 \u00e9\U0001f600", "fr", None), (8, "a b", "fr", "s2"),
]


def documents(spark, rows=ODD):
    """Rows with an extra column whose names clash with those that operators make."""
    schema = "doc_id long, text string, lang string, source string, bucket int, shard string, row int, n int"
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], schema)


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# 1


def brute_links(rows):
    unit = {i: embedding.unit(v) for i, v in rows}
    edges = [(a, b) for a in unit for b in unit if a < b and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    n = Counter(x for e in edges for x in e)
    return {i: (n[i], c, i == c) for i, c in components(unit, edges).items()}


@pytest.mark.parametrize("tile", [2048, 7])
def test_embedding_links(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding, "TILE_ROWS", tile)
    monkeypatch.setattr(embedding, "BUCKET_ROWS", 500)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 16))
    rows = []
    for i in range(400):
        v = centres[min(39, int(rng.exponential(8)))]
        rows.append((i, [float(x) for x in v + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25])]))
    rows += [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [1e308] * 16), (506, [1e-308] * 16), (507, [1.0] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, cell string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding.embedding_dedup(df).collect()}
    want = brute_links(rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want) and all((got[i][0] > 0) == (want[i][0] > 0) for i in want if want[i][0] != 1)
    assert sum(n for n, _, _ in got.values()) >= 0.999 * sum(n for n, _, _ in want.values())
    assert sum(got[i][1:] == want[i][1:] for i in want) >= 0.99 * len(want)


def test_embedding_empty_and_null_ids(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding.embedding_dedup(df).collect() == []
    df = spark.createDataFrame([(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id is None, r.n_links, r.component_id) for r in embedding.embedding_dedup(df).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (True, 0, None)]


def test_plan_is_calibrated():
    plan = embedding.Plan(1_000_000)
    assert plan.threshold >= plan.counted // 2 and plan.k > 8 and plan.tables > 1


# 2


def test_packing(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(documents(spark).select("doc_id", "text", "lang", "source", F.lit(0).cast("long").alias("n_chars")))
    rows = packing.pack(docs, packing.tokenizer_path()).collect()
    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for d in docs.collect():
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            cut = np.array(ids[at : at + 4096], "<u4").tobytes()
            want[(d.doc_id, at, len(cut) // 4, zlib.crc32(cut), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(docs.limit(0), packing.tokenizer_path()).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 1500, 600).tolist()
    sets = packing.windows(sizes)
    assert sorted(i for s in sets for i in s) == list(range(600))
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert max(sums) <= 4096 and sum(sums) / 4096 / len(sets) > 0.95
    assert packing.windows([]) == [] and packing.windows([4096, 4096, 1]) in ([[0], [1], [2]], [[2], [0], [1]], [[2], [1], [0]])


@pytest.mark.parametrize("text", ["a\x1cb\x85c", "\u00e9 e\u0301x \u0130STANBUL \u03a3\u0391\u03a3", "<|endoftext|>x <|startoftext|>", "don't 'S\r\n\t12a\u00bd", "\u6f22\u5b57 \U0001f600\u200b"])
def test_word_encoder(text):
    encode = packing.WordEncoder(packing.tokenizer_path(), 3)
    for _ in range(2):
        assert np.frombuffer(encode(text), "<u4").tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


# 3


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(documents(spark).select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    rows = simhash.simhash_dedup(docs).collect()
    texts = docs.collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in rows) == Counter((d.doc_id, brute_fingerprint(d.text)) for d in texts)
    fps = {(r.doc_id, r.fp & (2**64 - 1)) for r in rows if r.doc_id is not None}
    edges = [(a, b) for a, x in fps for b, y in fps if a < b and (x ^ y).bit_count() <= 3]
    want = components({a for a, _ in fps}, edges)
    assert all(r.component_id == want.get(r.doc_id) for r in rows)
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [4096, 40])
def test_near_groups(spark, tile):
    rng = np.random.default_rng(5)
    fps = []
    for base in rng.integers(0, 2**62, 60).tolist():
        for _ in range(int(rng.integers(1, 30))):
            x = base
            for bit in rng.integers(0, 64, int(rng.integers(0, 5))).tolist():
                x ^= 1 << bit
            fps.append(x)
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(fps)], "doc_id long, fp long")
    want = components(range(len(fps)), [(i, j) for i, x in enumerate(fps) for j, y in enumerate(fps) if i < j and (x ^ y).bit_count() <= 3])
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df, tile, 300).collect()}
    assert got == want


def test_index_prunes_and_accumulates():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 300).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for _ in range(900)], np.uint64)
    fps = np.unique(np.concatenate((base, base[rng.integers(0, 300, 900)] ^ flips)))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    keys = np.repeat([0, 1, 2], [len(fps) - 101, 1, 100])
    got = simhash.index_links(keys, fps, np.zeros(len(fps), np.int64), np.zeros(len(fps), bool))
    edges = [(a, b) for a in range(len(fps)) for b in range(a) if keys[a] == keys[b] and int(fps[a] ^ fps[b]).bit_count() <= 3]
    assert dict(enumerate(got.tolist())) == components(range(len(fps)), edges)
    levels, roots = simhash.index_nodes(fps, np.array([0]), np.array([len(fps)]))
    assert len(levels) == 3 and roots.tolist() == [0]
    for (a, b, mask, pattern), (_, _, below, values) in zip(levels[1:], levels):
        for k, (lo, hi) in enumerate(zip(a, b)):
            assert all((below[lo:hi] & mask[k]) == mask[k]) and all((values[lo:hi] & mask[k]) == (pattern[k] & mask[k]))


# 4


def brute_removed(docs, window=20):
    """Kept words of each (doc_id, text), ids all different."""
    words = {d: WORD.findall(t or "") for d, t in docs}
    first, out = {}, {}
    for d in sorted(words):
        gone = [False] * len(words[d])
        for i in range(len(words[d]) - window + 1):
            key = tuple(words[d][i : i + window])
            if key in first:
                gone[i : i + window] = [True] * window
            else:
                first[key] = (d, i)
        out[d] = [w for w, g in zip(words[d], gone) if not g]
    return words, out


@pytest.mark.parametrize("hot", [4096, 2])
def test_substrings(spark, hot):
    rng = np.random.default_rng(2)
    passages = [[f"p{k}w{i}" for i in rng.integers(0, 400, 60)] for k in range(6)]
    docs = []
    for d in range(80):
        text = [f"w{i}" for i in rng.integers(0, 300, int(rng.integers(0, 200)))]
        for _ in range(int(rng.integers(0, 4))):
            p = passages[int(rng.integers(0, 6))]
            a = int(rng.integers(0, 20))
            at = int(rng.integers(0, len(text) + 1))
            text[at:at] = p[a : a + int(rng.integers(15, 60))]
        docs.append((d, " \n".join(text)))
    docs += [(100, None), (101, ""), (102, "x " * 3000), (103, docs[3][1]), (104, "x\u00a0y " * 50)]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, anchor string").repartition(5)
    words, want = brute_removed(docs)
    got = substring.dedup_texts(df, rejoin=True, hot=hot).collect()
    assert len(got) == len(docs)
    for r in got:
        assert r.text == " ".join(want[r.doc_id]) and r.anchor == "k"
        assert r.dedup.n_words == len(words[r.doc_id]) and r.dedup.n_removed == len(words[r.doc_id]) - len(want[r.doc_id])
        assert sum(s.stop - s.start for s in r.dedup.spans) == r.dedup.n_removed


def test_substrings_odd_rows(spark):
    df = documents(spark, [*ODD, (9, " ".join(f"w{i}" for i in range(40)), "en", "s"), (9, " ".join(f"w{i}" for i in range(40)), "en", "s"), (10, " ".join(f"w{i}" for i in range(30)), "en", "s")])
    got = substring.dedup_texts(df)
    assert got.count() == df.count()
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r)
    assert [r.dedup.n_removed for r in by[9]] == [0, 0] and by[10][0].text == "" and by[2][0].text is None and by[8][0].text == "a b"
    assert by[6][0].dedup.n_words == 30_000 and by[6][0].dedup.n_removed == 29_999
    assert substring.dedup_texts(df.limit(0)).count() == 0


def test_substrings_compare_words_not_hashes(spark):
    tail = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"n91119 {tail}"), (2, f"n112395 {tail}"), (3, f"{tail} n91119"), (4, f"n112395 {tail}")], "doc_id long, text string")
    assert xxhash.xxh3_64_intdigest(b"n91119") & 0xFFFFFFFF == xxhash.xxh3_64_intdigest(b"n112395") & 0xFFFFFFFF
    assert {r.doc_id: r.dedup.n_removed for r in substring.dedup_texts(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 20}


def test_substrings_of_a_common_passage(spark):
    passage = " ".join(f"p{i}" for i in range(45))
    docs = [(d, f"a{d} b{d} {passage} c{d}" if d % 2 else f"{passage} d{d}") for d in range(400)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, dedup int").repartition(9)
    words, want = brute_removed(docs)
    for hot in (4096, 30):
        out = substring.dedup_texts(df, rejoin=True, hot=hot, told="told")
        assert out.columns == ["doc_id", "text", "dedup", "told"]
        assert all(r.text == " ".join(want[r.doc_id]) and r.told.n_removed == len(words[r.doc_id]) - len(want[r.doc_id]) for r in out.collect())


def test_matching_statistics():
    rng = np.random.default_rng(6)
    segs = [rng.integers(1, 4, int(n)) for n in rng.integers(5, 60, 30)]
    size = np.array([len(x) for x in segs])
    text = np.concatenate([np.append(x, 0) for x in segs])
    first = np.cumsum(size + 1) - size - 1
    fm = substring.FMIndex(text, 5)
    seen = 0
    for seg, at, lo, hi in substring.statistics(fm, text, first, size, 5):
        for s, p, a, b in zip(seg, at, lo, hi):
            window = segs[s][p : p + 5]
            assert b - a == sum((x[i : i + 5] == window).all() for x in segs for i in range(len(x) - 4))
            seen += 1
    assert seen == sum(max(0, n - 4) for n in size)
    marks = rng.random(700) < 0.01
    marks[0] = True
    at = np.arange(700)
    ones = np.flatnonzero(marks)
    left, right = substring.Marks(marks).run(at)
    k = np.searchsorted(ones, at, "right")
    assert (left == ones[k - 1]).all() and (right == np.append(ones, 700)[k]).all()


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 5, 50), 0) for _ in range(10)])
    fm = substring.FMIndex(text, 20)
    for _ in range(50):
        at, k = int(rng.integers(0, 480)), int(rng.integers(1, 20))
        pattern = text[at : at + k]
        if (pattern == 0).any():
            continue
        lo, hi = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            lo, hi = fm.step(lo, hi, np.array([c]))
        want = sum((text[i : i + k] == pattern).all() for i in range(len(text) - k + 1))
        assert hi[0] - lo[0] == want


# 5


def test_pfair_deviation():
    for targets in ({"a": 5.0, "b": 3.0, "c": 1.0, None: 0.01}, {f"s{i:02d}": 0.8**i for i in range(20)}):
        blocks = {n: 65_536 for n in targets}
        total, done = sum(targets.values()), dict.fromkeys(targets, 0)
        for t, (n, j, release, deadline, slot) in zip(range(65_536), mixing.schedule(mixing.exact_weights(targets), blocks)):
            assert slot == t and j == done[n] and release <= slot < deadline
            done[n] += 1
            if t % 7 == 0 or t > 65_000:
                assert all(abs(done[n] - w * (t + 1) / total) < 1 + 1e-9 for n, w in targets.items())


def test_sources_without_weight_come_last():
    rows = list(mixing.schedule(mixing.exact_weights({"a": 1.0, "b": 0.0, None: 0.0}), {"a": 3, "b": 2, None: 1}))
    assert [r[0] for r in rows] == ["a", "a", "a", None, "b", "b"] and [r[4] for r in rows] == list(range(6))
    with pytest.raises(ValueError, match="negative"):
        mixing.exact_weights({"a": -1.0})


def test_mixing_against_a_slow_schedule(spark):
    docs = spark.range(900).select("id", F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.element_at(F.array(*[F.lit(x) for x in "aaaaabbc"]), (F.col("id") % 8 + 1).cast("int")).alias("source"))
    weights = {"a": 3.0, "b": 2.0, "c": 0.7}
    rows = mixing.mix(docs, weights, block_rows=5, bucket_rows=30).collect()
    counts = Counter(r.source for r in rows)
    left = {n: -(-c // 5) for n, c in counts.items()}
    share = {n: Fraction(w) / sum(map(Fraction, weights.values())) for n, w in weights.items()}
    done, t, want = dict.fromkeys(left, 0), 0, {}
    while any(done[n] < left[n] for n in left):
        ready = [(math.ceil((done[n] + 1) / share[n]), n) for n in sorted(left) if done[n] < left[n] and math.floor(done[n] / share[n]) <= t]
        if ready:
            deadline, n = min(ready)
            want[n, done[n]] = (math.floor(done[n] / share[n]), deadline, t)
            done[n] += 1
        t += 1
    assert {(r.source, r.block): (r.release, r.deadline, r.slot) for r in rows} == want


def test_hot_ids_spread_over_buckets(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source"))
    rows = mixing.mix(docs, block_rows=10, bucket_rows=100).collect()
    assert sorted((r.block, r.place) for r in rows) == [(i // 10, i % 10) for i in range(4000)]
    by = defaultdict(list)
    for r in sharding.shard(docs, [1.0] * 4, bucket_rows=100).collect():
        by[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and sum(map(len, by.values())) == 4000


def test_running_sums(spark):
    from codestrata.llm.common import running

    rows = [(k, i, (i * 7) % 5) for k in ("x", "y") for i in range(0, 90, 1 + (k == "y"))]
    got = {(r.k, r.at): r.before for r in running(spark.createDataFrame(rows, "k string, at long, n long"), "k", "at", "n", span=8).collect()}
    assert got == {(k, i): sum(n for kk, j, n in rows if kk == k and j < i) for k, i, _ in rows}


def test_mixing(spark):
    docs = documents(spark, ODD * 30)
    out = mixing.mix(docs, {"s0": 2.0, "s1": 1.0, "s9": 4.0}, block_rows=4, bucket_rows=20)
    rows = out.collect()
    assert len(rows) == docs.count()
    blocks = defaultdict(list)
    for r in rows:
        blocks[r.source].append((r.block, r.place))
        assert r.release <= r.slot < r.deadline
    for places in blocks.values():
        assert sorted(places) == [(i // 4, i % 4) for i in range(len(places))]
    assert len({(r.slot, r.source) for r in rows}) == len({r.slot for r in rows})
    assert Counter(mixing.mixed_documents(docs).collect()) == Counter(docs.collect())
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


def test_pfair_deviation_over_frames(spark):
    counts = {f"s{i}": 20_000 if i == 20 else 2_000 for i in range(21)}
    targets = {n: c**0.7 for n, c in counts.items()}
    total, runs = sum(targets.values()), list(mixing.schedule(mixing.exact_weights(targets), counts))
    assert Counter(r[0] for r in runs) == counts and len({r[4] for r in runs}) == len(runs)
    done = dict.fromkeys(counts, 0)
    for name, j, release, deadline, slot in runs:
        assert j == done[name] and release <= slot < deadline
        done[name] += 1
        if all(done[n] < c for n, c in counts.items()):
            assert slot == sum(done.values()) - 1 and all(abs(done[n] - w * (slot + 1) / total) < 1 + 1e-9 for n, w in targets.items())
    docs = spark.range(6_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 100 == 0, "a").otherwise("b").alias("source"))
    rows = mixing.mix(docs, {"a": 1.0, "b": 9999.0}, block_rows=1).collect()
    assert all((r.release, r.deadline) == (r.block * 10_000, (r.block + 1) * 10_000) for r in rows if r.source == "a" and r.block < 3)
    assert all(r.release <= r.slot < r.deadline for r in rows) and len({r.slot for r in rows}) == 6_000


# 6


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, _ in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_url_rules_and_trees(spark):
    odd = [(-1, None), (-2, ""), (-3, "no scheme"), (-4, "http://WWW.Example.COM/en/x?y#z"), (-5, "http://a.com"), (-6, "x://y://b.net/es/"), (-7, "http://example.com/en"), (-8, "http://notexample.com/en/"), (-9, "http://\u00c9.net/fr/?")]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string")).withColumn("verdict", F.lit("x"))
    rows = urls.judge(pages).collect()
    assert len(rows) == pages.count()
    says = dict(urls.RULES)
    for r in rows:
        assert (r.host, r.path, r.rule) == brute_url(r.url)
        assert r.verdict == says[r.rule] if r.rule else r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0
    assert [r.verdict for r in urls.judge(spark.createDataFrame(odd[:3], "page_id long, url string")).collect()] == ["allow"] * 3


def test_trees_learn(spark):
    rows = [(f"http://h{i}.org/{'9' * 12 if i % 3 == 0 else 'page'}/{i % 7}", f"h{i}.org", int(i % 3 == 0)) for i in range(600)]
    model = urls.train(spark.createDataFrame(rows, "url string, host string, blocked int"))
    fresh = [(f"http://k{i}.org/{'9' * 12 if i % 2 else 'page'}/{i % 5}", f"k{i}.org", i % 2) for i in range(100)]
    df = spark.createDataFrame(fresh, "url string, host string, blocked int")
    scored = model.bins(df.withColumns(urls.lexical(F.col("url"), F.col("host")))).select("blocked", model.margin().alias("m")).collect()
    assert sum((r.m > 0) == bool(r.blocked) for r in scored) >= 95


def test_verdicts_against_a_slow_model(spark):
    """Features, bins and trees again in plain Python, from the limits, suffix shares and trees of the model."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    host, path = urls.split_url(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    rule, says = urls.match_rule(F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "says": says})
    model = urls.train(rows.filter("says IS NOT NULL").select("url", "host", (F.col("says") == "block").cast("int").alias("blocked")))
    shares = {s: {r[s]: r[f"{s}_blocked"] for r in model.suffixes[s].collect()} for s in ("tld", "domain")}

    def features(url, host):
        url, labels = url or "", (host or "").split(".")
        n = len(url)
        return {
            "length": n, "depth": len(url.split("/")), "digits": sum("0" <= c <= "9" for c in url) / n if n else 0.0,
            "entropy": -sum(k / n * math.log2(k / n) for k in Counter(url).values()) if n else 0.0, "params": len(re.findall("[?&;][^=&;#]+=", url)),
            "tld_blocked": shares["tld"].get(labels[-1], model.prior), "domain_blocked": shares["domain"].get(".".join((["", *labels])[-2:]), model.prior),
        }

    def score(tree, bins):
        while isinstance(tree, tuple):
            f, cut, left, right = tree
            tree = left if bins[f] <= cut else right
        return tree

    judged = {r.page_id: r for r in urls.judge(pages).collect()}
    free = [r for r in rows.collect() if r.says is None]
    assert len(model.trees) == urls.TREES and len(free) > 20
    for r in free:
        f = features(r.url, r.host)
        near = min((abs(f[k] - t) for k in f for t in model.limits.get(k, ())), default=1)
        margin = sum(score(t, {k: sum(v > t for t in model.limits.get(k, ())) for k, v in f.items()}) for t in model.trees)
        if near > 1e-9 and abs(margin) > 1e-9:
            assert judged[r.page_id].verdict == ("block" if margin > 0 else "allow")


def test_url_model_on_held_out_hosts(spark):
    """Lexical marks alone tell the classes of hosts that the trees never saw, whatever their suffixes."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        bad = int(rng.random() < 0.3)
        tld = ("net", "org", "info")[i % 3]
        page = "".join(rng.choice(list("0123456789abc"), 24 if bad else 6))
        rows.append((f"http://h{i % 500}.{tld}/{page}" + "?a=1&b=2&c=3" * bad, f"h{i % 500}.{tld}", bad))
    df = spark.createDataFrame(rows, "url string, host string, blocked int")
    fold = F.pmod(F.xxhash64("host"), F.lit(4))
    model = urls.train(df.filter(fold > 0))
    held = model.bins(df.filter(fold == 0).withColumns(urls.lexical(F.col("url"), F.col("host")))).select("blocked", (model.margin() > 0).alias("says")).collect()
    assert len(held) > 400 and sum(r.says == bool(r.blocked) for r in held) / len(held) > 0.97
    # a suffix that tells nothing of other hosts is no reason to trust it: each host its own class, at random
    noise = spark.createDataFrame([(f"http://d{i}.com/x", f"d{i}.com", int(rng.random() < 0.5)) for i in range(1500)], "url string, host string, blocked int")
    model = urls.train(noise.filter(fold > 0))
    held = model.bins(noise.filter(fold == 0).withColumns(urls.lexical(F.col("url"), F.col("host")))).select(F.abs(model.margin()).alias("m")).collect()
    assert np.median([r.m for r in held]) < 0.5


def test_url_sample_of_repeated_urls(spark):
    rows = [("http://a.net/es/1", "a.net", 1)] * 5000 + [(f"http://b{i}.com/", f"b{i}.com", 0) for i in range(300)]
    model = urls.train(spark.createDataFrame(rows, "url string, host string, blocked int"), bound=100)
    assert model.suffixes and model.trees


# 7


def test_language_accuracy(spark):
    rows = langid.op7_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(held) > 20 and sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_language_odd_rows(spark):
    docs = documents(spark)
    model = langid.train(docs)
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(docs, model).collect()}
    assert {(2, "und", True), (3, "und", True), (4, "und", True)} <= got and all(r[1] in ("en", "fr", "und") for r in got)
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and None in [r.doc_id for r in kept.collect()]
    assert langid.keep_known(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 39, 40, 41, 95])
def test_counts_by_piece(monkeypatch, n):
    text = ("Ab c\u00e9\u00df, d12 ef" * 10)[:n]
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "PIECE", 20)
    assert (langid.counts(text) == whole).all()


def test_language_letters_and_ids(spark):
    sentence = {"en": "the quick brown fox jumps over the lazy dog and runs", "fr": "le renard brun saute par dessus le chien qui dort ici", "de": "der schnelle braune fuchs springt \u00fcber den faulen hund", "es": "el r\u00e1pido zorro marr\u00f3n salta sobre el perro dormido"}
    rows = [(None, f"{t} {i}", k) for i in range(40) for k, t in sentence.items()] + [(1, "solo uno", "xx")] * 300
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "es", "fr", "xx"]
    texts = ["\u00b2", "12 \u00bd \u2461", "\u2167 \u0301_", None, "", "\u00aa", *sentence.values()]
    lang, score, rejected = model.predict(texts)
    assert lang[:5].tolist() == ["und"] * 5 and not score[:5].any() and rejected[:5].all() and lang[5] != "und"
    assert lang[6:].tolist() == list(sentence)


def test_language_many_labels(spark):
    rows = [(i, f"w{'abcdefghijklmnop'[i % 16]} " * 5, f"l{i:03d}") for i in range(300)]
    assert len(langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs) == 300


def test_language_against_slow_vectors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    lang, score, _ = model.predict(texts)
    u64 = (1 << 64) - 1
    for text, got, cos in zip(texts, lang, score):
        if got == "und":
            continue
        c = [ord(x) for x in re.sub(r"[^a-z\u00df-\u00f6\u00f8-\u00ff]+", " ", f" {text.lower()} ")]
        v = np.zeros(langid.DIM)
        for n in (1, 2, 3):
            for i in range(len(c) - n + 1):
                h = 0
                for k, x in enumerate(c[i : i + n]):
                    h = (h * {0: 0, 1: 0x9E3779B1, 2: 0x85EBCA77}[k] + x) & u64
                if c[i : i + n] != [32]:
                    h = ((h + n) * 0xC2B2AE3D27D4EB4F & u64) >> 40
                    v[h % langid.DIM] += -1 if h & langid.DIM else 1
        v = np.sign(v) * np.sqrt(np.abs(v)) * model.idf
        cosines = model.centroids @ v / np.linalg.norm(v)
        assert model.langs[model.owner[cosines.argmax()]] == got and abs(max(0, cosines.max()) - cos) < 1e-4


def test_language_rejection(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter("doc_id % 5 <> 0"))
    clean = [r.text for r in docs.filter("doc_id % 5 = 0").collect()]
    assert model.predict(clean)[2].mean() < 0.02
    rng = np.random.default_rng(4)
    for low, high in ((0x3B1, 0x3C9), (0x430, 0x44F), (0x4E00, 0x5200), (0xAC00, 0xB000)):
        unseen = ["".join(chr(x) if rng.random() > 0.15 else " " for x in rng.integers(low, high, n)) for n in (100, 1000, 5000) for _ in range(20)]
        assert model.predict(unseen)[2].mean() > 0.95
    assert langid.keep_known(spark.createDataFrame([(i, t, None) for i, t in enumerate(clean)], "doc_id long, text string, lang string")).count() == 0


# 8


def test_sharding(spark):
    docs = documents(spark, ODD + [(i, f"t{i}", "en", "s") for i in range(100, 3000)])
    rows = sharding.shard(docs, [1.0] * 16, [1.0] * 17, bucket_rows=50).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in (tuple(x) for x in docs.collect()))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert set(by) == set(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.5 * len(rows) / 16
    def spark_hash(doc, k):  # XXH64 of the id, then of the number of the shard
        return xxhash.xxh64_intdigest(int(k).to_bytes(4, "little"), 42 if doc is None else xxhash.xxh64_intdigest(int(doc).to_bytes(8, "little", signed=True), 42))

    for r in rows:
        score = [(-1 / math.log(((spark_hash(r.doc_id, k) >> 11) + 0.5) / 2**53), k) for k in range(17)]
        assert (r.shard, r.grown_shard) == (max(score[:16])[1], max(score)[1])
    heavy = Counter(r.shard for r in sharding.shard(docs, [3.0, 1.0]).collect())
    assert 0.7 < heavy[0] / len(rows) < 0.8
    assert sharding.shard(docs.limit(0), [1.0]).count() == 0


# 9


def test_chat_round_trip(spark):
    hard = "</s>[INST] ok [/INST] <|im_start|>user\nx<|im_end|>\n<|im_more|> ~0~1~2 <<SYS>> <s> [x] <|"
    turns = [
        (1, 2, "assistant", hard), (1, 1, "user", hard), (1, 3, "assistant", "second"), (2, 0, "user", None), (2, 0, "user", None), (2, 1, None, ""),
        (None, 0, "assistant", "a"), (3, None, "ro\nle<|im_end|>", "z"), (4, 0, "assistant", "\u00e9\U0001f600\n\n"), (4, 1, "user", "~"),
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, turns int")
    rows = chat.format_chats(df).withColumn("read", chat.read_turns(F.col("formatted"))).collect()
    want = defaultdict(list)
    for c, t, r, x in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        want[c].append((r or "", x or ""))
    assert {r.conv_id: [tuple(t) for t in r.read] for r in rows} == want
    for r in rows:
        assert "".join(s.text for s in r.segments) == r.formatted
        texts = [s.text for s in r.segments if s.loss]
        assert len(texts) == sum(t[0] == "assistant" for t in want[r.conv_id])
        assert all(not re.search(r"</?s>|\[/?INST\]|<\|im|<<", s.text) for s in r.segments[1::3])
    assert chat.format_chats(df.limit(0)).count() == 0


# 10


def test_merkle_odd_rows(spark):
    rows = merkle.edit_probe(documents(spark)).collect()
    assert len(rows) == len(ODD)
    texts = sorted(((d[0] if d[0] is not None else -(2**63), d[1] or "") for d in ODD), key=lambda t: (-t[0], t[1]))
    want = Counter()
    for (d, t), (_, nxt) in zip(texts, texts[1:] + texts[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        want[(None if d == -(2**63) else d, len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert len({r.fingerprint for r in rows if r.doc_id == 1}) == 1
    assert merkle.edit_probe(documents(spark).limit(0)).count() == 0


def test_merkle_neighbours_over_buckets(spark):
    docs = spark.createDataFrame([(i * i, f"t{i}") for i in range(300)], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.next_text for r in merkle.with_next(docs, bucket_rows=9).collect()}
    assert got == {i * i: f"t{(i - 1) % 300}" for i in range(300)}


def test_merkle_locates_edits(spark):
    pad = "x" * 300
    a, b = f"one. two.\nthree\n\n{pad}. four", f"one. two.\nTHREE\n\n{pad}. four"
    r = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("x"), merkle.fingerprint(F.col("b")).alias("y"))
    r = r.select(merkle.changed_paragraphs(F.col("x"), F.col("y")).alias("at"), merkle.likeness(F.col("x"), F.col("y")).alias("near")).first()
    assert r["at"] == [1] and 0.8 < r.near < 1


def test_merkle_locates_insertions(spark):
    old = "first one here\nsecond is this\nthird\n\nsection two\nends here\n\nlast section"
    new = {
        f"put in front\n{old}": ([], [0]), old.replace("third", "third\nand a fourth"): ([], [3]), old.replace("second is this\n", ""): ([1], []),
        old.replace("ends here", "ends there"): ([4], [4]), f"a\n\n{old}": ([], [0]), old: ([], []), old.replace("third", "third\nthird"): ([], [3]),
    }
    rows = spark.createDataFrame([(old, x) for x in new], "a string, b string").select("b", merkle.edits(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("e")).collect()
    assert {r.b: (r.e.removed, r.e.added) for r in rows} == new


@pytest.mark.parametrize("kind", ["null", "one", "clustered"])
def test_merkle_neighbours_with_hot_ids(spark, kind):
    def doc_id(i):
        return {"null": None if i % 3 else i, "one": 7 if i % 3 else i, "clustered": i if i < 990 else i * 10**15}[kind]

    rows = [(doc_id(i), f"t{i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.text: r.next_text for r in merkle.with_next(docs, bucket_rows=9).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), hashlib.md5(r[1].encode()).hexdigest()))
    assert got == {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}


@pytest.mark.parametrize("n", [64, 256])
def test_merkle_likeness_over_old_limits(spark, n):
    base = " ".join(f"w{i}x{i * 7919 % 1000}" for i in range(80))
    rows = [(base[:n], base[: n + 1]), (base[:416], base[:n]), (base[: n + 40], base[: n - 10] + "Q" * 50)]
    near = [r.near for r in spark.createDataFrame(rows, "a string, b string").select(merkle.likeness(merkle.fingerprint(F.col("a")), merkle.fingerprint(F.col("b"))).alias("near")).collect()]
    assert near[0] > 0.85 and near[1] > 0.2 and near[2] > 0.4


# the shared pieces and the pipeline


def test_components_of_a_chain(spark):
    from codestrata.llm.common import components as stars

    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5)]
    got = {r.node: r.component for r in stars(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = spark.createDataFrame(stage(spark, seen, SF).collect(), docs.schema)
        assert out.columns == docs.columns
        before = {r.doc_id: r.text for r in seen.collect()}
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            fps = {d: brute_fingerprint(t) for d, t in before.items()}
            want = components(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
            assert set(after) == set(want.values())
        elif name == "substrings":
            words, want = brute_removed(before.items())
            assert all(WORD.findall(after[d]) == want[d] for d in before)
        elif name == "language":
            assert len(after) > 0.9 * len(before)
        else:
            assert after == before
        seen = out
    pieces = p.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in seen.collect()}


def test_word_encoder_equals_the_tokenizer():
    import random

    import numpy as np

    from codestrata.llm.packing import WordEncoder, tokenizer_path

    encode, rng = WordEncoder(tokenizer_path(), 500), random.Random(7)
    letters = "abJIZ\u00c9\u00e9\u00df\u03a3\u03c3\u0130\u0131\u030c\u0301\u0307.,;:!?%*-'\"<|>_~\u00b2\u2167 1 \t\n\r\u65e5\u0434]"
    for _ in range(5000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) + rng.choice(["", " <|endoftext|>", "'RE", "J\u030c", "..."])
        want = np.array(encode.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encode(text) == want, text


def test_pipeline_keeps_the_order_of_the_mix(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    slot = {r.doc_id: (r.slot, r.place) for r in mixing.mix(docs, power=mixing.TEMPERATURE).collect()}
    mixing.mixed_documents(docs, file_rows=90).write.parquet(str(tmp_path / "mixed"))
    again = spark.read.parquet(str(tmp_path / "mixed"))
    out = mixing.in_written_order(again, part_rows=150)
    assert out.columns == docs.columns and out.rdd.getNumPartitions() > 3
    assert [r.doc_id for r in out.collect()] == sorted(slot, key=slot.get)
    pieces = packing.pack(mixing.in_written_order(again, part_rows=150), packing.tokenizer_path(), batch=20).collect()
    by_sequence = list(dict.fromkeys(r.doc_id for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset))))
    by_slot = {d: i for i, d in enumerate(sorted(slot, key=slot.get))}
    assert max(abs(by_slot[d] - i) for i, d in enumerate(by_sequence)) < 100


def test_written_order_of_other_frames(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}") for i in (3, 1, 2)], "doc_id long, text string").coalesce(1)
    assert [r.doc_id for r in mixing.in_written_order(df).collect()] == [3, 1, 2]
    df.write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    joined = a.join(a.select("doc_id", F.lit(1).alias("x")), "doc_id")
    assert sorted(r.doc_id for r in mixing.in_written_order(joined).collect()) == [1, 2, 3] and mixing.in_written_order(a.limit(0)).count() == 0


def test_pipeline_of_odd_tables(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p
    from codestrata.llm import common

    monkeypatch.setattr(p, "shared_folder", lambda spark: str(tmp_path / "shared"))
    odd = documents(spark).withColumnsRenamed({"bucket": "dedup", "shard": "dedup_"})
    for name, df in (("empty", odd.limit(0)), ("odd", odd)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = p.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in rows} <= {r[0] for r in ODD} and (name == "odd") == bool(rows)
    left = [x for x in (tmp_path / "shared").glob("*/*")]
    assert sorted(x.name for x in left) == ["packing", "packing"]
    with common.passing(spark):
        common.checkpoint(spark.range(3))
        (file,) = common._SCOPES[-1]
    assert not __import__("os").path.exists(file.removeprefix("file:"))


def test_pipeline_near_duplicates_with_repeated_ids(spark):
    import corpus_pipeline

    a, b, c = "one two three four five six seven", "a green house by the sea", "blue sky over hills and far away"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "y"), (7, c, "z"), (7, c, "z"), (8, c, "z"), (None, a, "n"), (None, None, None), (9, None, "e"), (10, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    from codestrata.llm.simhash import fingerprint

    assert min((fingerprint(x) ^ fingerprint(y)).bit_count() for x, y in ((a, b), (a, c), (b, c), (a, ""), (b, ""), (c, ""))) > 3
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, a, "x"), (5, b, "y"), (7, c, "z"), (None, a, "n"), (None, None, None), (9, None, "e")], key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_chat_order_of_ties(spark):
    """Ties go by the texts as they are, not as escaped; null turns come first."""
    rows = [(1, 5, "user", "abc"), (1, 5, "user", "<s>x"), (1, 5, "user", "~"), (1, None, "user", "zzz"), (1, 5, "assistant", "[INST]")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(turns).select(chat.read_turns(F.col("formatted")).alias("t")).first().t
    assert [tuple(t) for t in got] == [(r, t) for _, _, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3].encode()))]


def test_reserved_names_of_other_columns(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(i, words + f" own{i}", i * 10, f"t{i}", -i, "s", [1], [2]) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __dedup_id long, __DEDUP_TH string, key long, starts string, c0 array<int>, c1 array<int>")
    out = substring.dedup_texts(docs)
    assert out.columns[:-1] == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert all(tuple(got[i])[2:-1] == rows[i][2:] for i in range(4)) and [got[i].text for i in range(4)] == [rows[0][1], "own1", "own2", "own3"]
    kept = spark.createDataFrame([(i, 100 - i, "p", 7) for i in range(50)], "doc_id long, __order_row long, __order_part string, __Order__file int")
    kept.coalesce(1).write.parquet(f"{tmp_path}/x")
    back = mixing.in_written_order(spark.read.parquet(f"{tmp_path}/x"))
    assert back.columns == kept.columns and [tuple(r) for r in back.collect()] == [(i, 100 - i, "p", 7) for i in range(50)]
