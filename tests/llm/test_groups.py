"""Operators that compare documents or vectors: brute force on small tables, odd inputs, the pipeline."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from faultspark.llm import common, components, decontaminate, neighbours, packing, repeats, simhash, suffixes

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, fp string, root long, content string, component_id string"
ODD = [(1, None), (2, ""), (3, "long " * 40_000), (4, "same text of five words"), (4, "same text of five words"), (5, "same text of five words"), (None, "no id"), (None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 0, "y", "z") for i, t in ODD], SCHEMA)


def roots_of(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(40)]
    rng.shuffle(chain)
    pairs = chain + [(rng.randrange(50, 120), rng.randrange(50, 120)) for _ in range(50)] + [(200, i) for i in range(201, 230)] + [(7, 7), (3, 2)]
    want = roots_of(230, pairs)
    nodes = {i for p in pairs for i in p if p[0] != p[1]}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: want[i] for i in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aAbÄé \t\n\x0b\x1c\xa0"), max_size=40))
def test_fingerprint(t):
    assert simhash.fingerprint(t.encode()) == slow_fingerprint(t)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_near_fingerprints_meet(x, bits):
    y = x ^ sum(1 << b for b in bits)
    keys = [set(simhash.postings(np.array([v], np.uint64))[0].tolist()) for v in (x, y)]
    assert keys[0] & keys[1]


def brute_classes(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    u = sorted(set(fps))
    a = np.array(u, np.uint64)
    pairs = [(i, int(j) + i + 1) for i in range(len(u)) for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= 3)]
    root = roots_of(len(u), pairs)
    of = [root[u.index(f)] for f in fps]
    least = {}
    for (d, _), r in zip(rows, of):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return Counter((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, of))


def test_simhash_classes(spark, odd):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()][:400] + ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, simhash.classes(docs).collect())) == brute_classes(rows)
    assert Counter(map(tuple, simhash.classes(odd).collect())) == brute_classes(ODD)
    assert simhash.classes(odd.limit(0)).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, None), (3, ODD[2][1]), (4, ODD[3][1]), (None, "no id")])
    twice = spark.createDataFrame([(7, "one text of its own here"), (7, "quite another text under that id"), (None, "one text of its own here")], "doc_id long, text string")
    assert Counter(r.doc_id for r in simhash.keep_one(twice).collect()) == {7: 2}


def test_simhash_near_group(spark, monkeypatch):
    """Many fingerprints close together: linked like brute force, with fewer links than fingerprints in each posting."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    fps = np.array(sorted({centre ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for _ in range(150)}), np.uint64)
    edges = simhash.posting_links(fps)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if int(np.bitwise_count(fps[i] ^ fps[j])) <= 3]
    want = roots_of(len(fps), pairs)
    where = {int(f): i for i, f in enumerate(fps)}
    assert roots_of(len(fps), [(where[a], where[b]) for a, b in edges]) == want and len(edges) < len(fps)
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    found = [(where[int(np.int64(r.a).view(np.uint64))], where[int(np.int64(r.b).view(np.uint64))]) for r in simhash.links(table).collect()]
    assert roots_of(len(fps), found) == want


def bag(words):
    k = min(5, len(words))
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def brute_matches(docs, items):
    out = {}
    for d, t in docs:
        w = decontaminate.words_of((t or "").encode())
        for i, s in items:
            v = decontaminate.words_of((s or "").encode())
            if v and len(v) <= len(w):
                b = bag(v)
                sims = [sum((bag(w[p:p + len(v)]) & b).values()) / sum((bag(w[p:p + len(v)]) | b).values()) for p in range(len(w) - len(v) + 1)]
                if max(sims) >= 0.8:
                    out[d, i] = (max(sims), sims.index(max(sims)), sum(s >= 0.8 for s in sims))
    return out


def test_decontamination(spark, odd):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 5, 12, 20, 40, 60])))) for i in range(40)] + [(50, None), (51, ""), (52, "Ha ha HA ha, ha ha ha.")]
    items += [(60, items[3][1])]
    docs = []
    for d in range(120):
        w = rng.choices(words, k=rng.randrange(5, 150))
        v = items[rng.randrange(40)][1].split()
        if d % 2:
            at = rng.randrange(len(v))
            if d % 4 == 1 and len(v) > 30:
                v = v[:at] + ["changed"] + v[at + 1:] if at in (0, len(v) - 1) else v[:-1] + ["end"]
            w[5:5] = [x.upper() + ("," if rng.random() < 0.2 else "") for x in v]
        docs.append((d, " ".join(w)))
    docs += [(200, "so ha ha ha ha ha ha ha ha"), (None, items[0][1])] + [(301, t) for _, t in ODD]
    want = brute_matches(docs, items)
    table = spark.createDataFrame([(d, t, 1, 0.5) for d, t in docs], "doc_id long, text string, item_id int, similarity double")
    bench = spark.createDataFrame([(i, s, 9) for i, s in items], "item_id long, text string, doc_id long")
    for block in (1_000, 8):
        found = decontaminate.contaminated(table, bench, block_items=block).collect()
        assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.windows) for r in found} == {k: (round(s, 9), p, n) for k, (s, p, n) in want.items()}
        assert len(found) == len(want) > 50
    kept = decontaminate.keep_clean(table, bench)
    assert kept.columns == table.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in docs if not any(k[0] == d for k in want))
    for ids in ("string", "null"):  # ids of another type, and none: the texts count
        named = bench.withColumn("item_id", F.concat(F.lit("i"), "item_id") if ids == "string" else F.lit(None).cast("string"))
        assert decontaminate.contaminated(table, named).select("doc_id").distinct().count() == len({d for d, _ in want})
        assert Counter(r.doc_id for r in decontaminate.keep_clean(table, named).collect()) == Counter(r.doc_id for r in kept.collect())
    assert decontaminate.contaminated(table.limit(0), bench).count() == 0 == decontaminate.contaminated(table, bench.limit(0)).count()


def test_decontamination_short_documents(spark):
    """Documents that are an item short of some words, against brute force over every pair."""
    rng = random.Random(16)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([60, 60, 40, 25, 12, 9, 8, 6, 5, 4, 3])] + [(20, "ha " * 30)]
    docs = []
    for _, t in items:
        v = t.split()
        for cut in (0, 1, 2, 5, 11, 13):
            docs += [(len(docs) + 1, " ".join(v[cut:])), (len(docs) + 2, " ".join(v[:len(v) - cut])), (len(docs) + 3, " ".join(v[cut // 2:len(v) - (cut + 1) // 2]))]
    want = {}
    for d, t in docs:
        w = t.split()
        for i, s in items:
            v = s.split()
            if not set(w) & set(v):
                continue
            b, bags = bag(v), [bag(w[p:p + len(v)]) for p in range(max(1, len(w) - len(v) + 1))]
            sims = [sum((x & b).values()) / sum((x | b).values()) for x in bags]
            if max(sims) >= 0.8:
                want[d, i] = (round(max(sims), 9), sims.index(max(sims)), sum(x >= 0.8 for x in sims))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start_word, r.windows) for r in decontaminate.contaminated(table, bench).collect()}
    assert found == want
    assert found[4, 0] == (round(55 / 56, 9), 0, 1) and len(docs[3][1].split()) == 59
    assert {r.doc_id for r in decontaminate.keep_clean(table, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_multi_index_is_complete():
    rng = np.random.default_rng(8)
    words = [[b"%d" % x for x in rng.integers(0, 1000, 20)] for _ in range(60)]
    index = decontaminate.ItemIndex(list(enumerate(words)))
    fps = np.concatenate([index.fingerprints[:30] ^ np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 22, 30)], np.uint64)])
    want = [(i, j) for i in range(30) for j in range(60) if int(np.bitwise_count(fps[i] ^ index.fingerprints[j])) <= decontaminate.RADIUS]
    assert index.within(20, fps) == want


def test_suffix_sort():
    rng = random.Random(9)
    for _ in range(400):
        n = rng.randint(1, 12)
        left, right = ([bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(n)] for _ in range(2))
        order, lcp = suffixes.deep_shallow(left, 0, rng.choice([0, 2, 5]))
        assert [left[i] for i in order] == sorted(left)
        other, other_lcp = suffixes.deep_shallow(right, 0, 3)
        need = rng.randint(1, 12)
        want = [max([suffixes.common(left[i], left[j]) for j in range(n) if j != i and
                     suffixes.common(left[i], left[j]) + suffixes.common(right[i], right[j]) >= need], default=-1) for i in range(n)]
        assert suffixes.extents(order, lcp, other, other_lcp, need) == want


def brute_removed(texts, length):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("length, run", [(12, 4), (20, 6)])
def test_repeats_small(spark, length, run):
    rng = random.Random(length)
    parts = ["".join(rng.choices("abé" if i % 2 else "abcdefgh", k=rng.randint(0, 50))) for i in range(5)]
    rows = [(i, "".join(rng.choice(parts)[rng.randint(0, 10):] for _ in range(rng.randint(0, 5)))) for i in range(80)]
    rows += rows[:5] + [(i, t) for i, t in ODD if i != 3] + [(90, "ab" * 60), (91, "aab" * 40), (None, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "x", 0, "y", "z") for i, t in rows], SCHEMA)
    want = brute_removed([(t or "").encode() for _, t in rows], length)
    got = Counter(map(tuple, repeats.remove(docs, length, run).collect()))
    assert got == Counter((i, *w) for (i, _), w in zip(rows, want))
    for big in (0, 4):  # runs looked up by counts: all, or the frequent ones
        assert Counter(map(tuple, repeats.remove(docs, length, run, big).collect())) == got
    assert repeats.remove(docs.limit(0), length, run).count() == 0


def test_repeats_query(spark):
    docs = common.table(spark, SF, "documents").where("doc_id < 300")
    rows = docs.select("doc_id", "text").collect()
    want = brute_removed([r.text.encode() for r in rows], 400)
    for big in (repeats.BIG, 3):
        assert Counter(map(tuple, repeats.remove(docs, big=big).collect())) == Counter((r.doc_id, *w) for r, w in zip(rows, want))


def test_starts_shared(spark, monkeypatch):
    """Combined within a task or not, and over tasks."""
    rng = random.Random(6)
    rows = [(bytes([i] * 16), bytes(rng.choices(b"ab", k=rng.randint(8, 60)))) for i in range(40)]
    ranges = [[(a, min(a + 4, len(t) - 8)) for a in range(0, len(t) - 7, 7)] for _, t in rows]
    found = [(c, a) for (c, t), some in zip(rows, ranges) for lo, hi in some for a in range(lo, hi + 1)]
    count = Counter(dict(rows)[c][a:a + 8] for c, a in found)
    want = {(c, a) for c, a in found if count[dict(rows)[c][a:a + 8]] > 1}
    texts = spark.createDataFrame([(c, t, some) for (c, t), some in zip(rows, ranges)], "content binary, data binary, ranges array<struct<a:long,b:long>>").repartition(3)
    for most in (repeats.COMBINED, 20):
        monkeypatch.setattr(repeats, "COMBINED", most)
        got = repeats.starts_shared(texts, 8).collect()
        assert {(bytes(r.content), a) for r in got for x in r.ranges for a in range(x.a, x.b + 1)} == want


def test_repeats_border_strings(spark, monkeypatch):
    """Texts that share a frequent run pass on a few blocks and strings at each border, not one for each byte around it."""
    rng = random.Random(8)
    phrase = "".join(rng.choices("abcdefgh", k=30))
    rows = [(i, "".join(rng.choices("abcdefgh", k=700)) + phrase * 40 + "".join(rng.choices("abcdefgh", k=700))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x", 0, "y", "z") for i, t in rows], SCHEMA)
    passed, plain = [], repeats.stored

    def counted(df):
        made = plain(df)
        passed.extend([made.where("s is not null").count()] if "s" in made.columns else [])
        return made

    monkeypatch.setattr(repeats, "stored", counted)
    got = Counter(map(tuple, repeats.remove(docs, big=3).collect()))
    assert got == Counter((i, *w) for (i, _), w in zip(rows, brute_removed([t.encode() for _, t in rows], 400)))
    assert sum(passed) < 100 * len(rows)


def test_repeats_windows():
    """Windows of one place part its starts, and each start lies in the window that ends at its distance."""
    p, a, b = np.array([400, 900]), np.array([99, 899]), np.array([395, 900])
    v, lo, hi = repeats.windows(p, a, b, 50)
    assert sorted(x for s, e in zip(lo, hi) for x in range(s, e + 1)) == [*range(99, 396), 899, 900]
    assert sum(hi - lo + 1) == 297 + 2 and all(v - 49 <= lo) and all(lo <= hi) and all(hi <= v)
    assert set(v) == {400 - 50 * k for k in range(7)} | {900}


def test_repeats_stretches():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"abcd", k=rng.randint(0, 300))) for _ in range(6)]
    each = [{(int(i), int(a), int(h)) for got in repeats.Chooser(20, 6, s).batch(texts) for i, a, h in zip(*got)} for s in (1 << 22, 64)]
    assert each[0] == each[1]


def test_neighbours(spark):
    table = common.table(spark, SF, "embeddings")
    got = {}
    for r in neighbours.search(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -2
        top = np.lexsort((ids, -s))[:5]
        mine = got[ids[q]]
        assert sorted(mine) == [1, 2, 3, 4, 5]
        assert all(abs(s[ids == i][0] - v) < 1e-12 for i, v in mine.values())
        hit += len({i for i, _ in mine.values()} & set(ids[top].tolist()))
    assert hit >= 0.9 * 5 * len(got) and len(got) == sum(ids % 50 == 0)


def test_neighbours_scan_is_exact_without_tests(monkeypatch):
    """With bounds that never give up early and all lists probed, the scan equals brute force, in any batches."""
    monkeypatch.setattr(neighbours, "EPSILON", 1e9)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 40))
    ids = np.arange(900)
    lists = neighbours.fit(ids, x, 5)
    s = neighbours.unit(x[:60]) @ neighbours.unit(x).T
    s[np.arange(60), np.arange(60)] = -2
    bound = 2 - 2 * np.sort(s, 1)[:, -9]
    for tested in (True, False):
        queries = neighbours.Queries.of(ids[:60], x[:60], bound, lists.rotation, 5)
        for at in range(0, 900, 250):
            neighbours.scan(queries, ids[at:at + 250], x[at:at + 250], lists.rotation, tested)
        assert (queries.owner == np.argsort(-s, 1)[:, :5]).all()


def test_neighbours_route():
    """Lists are added while those of a query hold fewer than k others; bounds come from its own lists only."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2_000, 12))
    lists = neighbours.fit(np.arange(2_000), x, 5)
    lists.probes = 1
    u = neighbours.unit(x[:40]) @ lists.rotation
    sizes = np.where(np.arange(len(lists.centres)) % 2, 3, 2)
    probed, bound = neighbours.route(lists, sizes, np.arange(40), np.ones(40, np.int64), u, 5)
    assert (probed.sum(1) >= 2).all() and ((probed * sizes).sum(1) >= 6).all() and ((probed * sizes).sum(1) < 9).all()
    for i in range(40):
        own = np.flatnonzero(probed[i][lists.sample_lists] & (np.arange(2_000) != i))
        assert abs(bound[i] - np.sort(2 - 2 * lists.sample[own] @ u[i])[4]) < 1e-9


def test_neighbours_odd(spark, monkeypatch):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (50, [0.0, 0.0]), (100, None), (150, [nan, 1.0]),
            (200, [None, 1.0]), (250, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (300, [0.0, 1.0]), (2, [1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, 0.1) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = [tuple(r) for r in neighbours.search(table).orderBy("query_id", "rank").collect()]
    half = 1 / np.sqrt(2)
    assert [(a, b, c, round(s, 9)) for a, b, c, s in got] == [
        (0, 1, 1, 1.0), (0, 2, 3, 1.0), (0, 3, 2, round(half, 9)), (0, 4, 2, round(half, 9)), (0, 5, 300, 0.0),
        (300, 1, 2, round(half, 9)), (300, 2, 2, round(half, 9)), (300, 3, 0, 0.0), (300, 4, 1, 0.0), (300, 5, 3, 0.0)]
    assert neighbours.search(table.limit(0)).count() == 0
    monkeypatch.setattr(neighbours, "TILE_ROWS", 2)
    monkeypatch.setattr(neighbours, "TILE_QUERIES", 1)
    assert [tuple(r) for r in neighbours.search(table).orderBy("query_id", "rank").collect()] == got


def ranks_against_brute(table, rows):
    """Recall; every query must have ranks 1 to 5 with right scores, best first."""
    got = {}
    for r in table.collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        mine = got[ids[q]]
        assert sorted(mine) == [1, 2, 3, 4, 5] and len({i for i, _ in mine.values()}) == 5 and ids[q] not in {i for i, _ in mine.values()}
        assert all(abs(s[ids == i][0] - v) < 1e-9 for i, v in mine.values())
        assert [mine[r] for r in range(1, 6)] == sorted(mine.values(), key=lambda m: (-m[1], m[0]))
        s[q] = -2
        least = np.sort(s)[-5]
        hit += sum(v >= least - 1e-9 for _, v in mine.values())
    assert len(got) == sum(ids % 50 == 0)
    return hit / 5 / len(got)


@pytest.mark.parametrize("sample", [8_192, 512, 40])
def test_neighbours_all_ranks(spark, monkeypatch, sample):
    """sf0.1, with lists from a tenth of the table or fewer rows, in whole lists and in tiles."""
    monkeypatch.setattr(neighbours, "SAMPLE", sample)
    monkeypatch.setattr(neighbours, "TILE_ROWS", sample)
    monkeypatch.setattr(neighbours, "TILE_QUERIES", max(4, sample // 100))
    table = common.table(spark, "/root/testdata/sf0.1", "embeddings")
    recall = ranks_against_brute(neighbours.search(table), [tuple(r) for r in table.select("vec_id", "embedding").collect()])
    assert recall > 0.9


@pytest.mark.parametrize("sample", [8_192, 512])
def test_neighbours_copies(spark, monkeypatch, sample):
    """Large groups of copies: ranks are full, and of equal vectors the smallest ids come first."""
    monkeypatch.setattr(neighbours, "SAMPLE", sample)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3_000, 24)).astype(np.float32)
    x[500:1_500], x[1_500:2_100], x[2_997:] = x[500], x[1_500], x[2_996]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5))
    assert ranks_against_brute(found, rows) > 0.9
    assert [r.vec_id for r in found.where("query_id = 1000").orderBy("rank").collect()] == [500, 501, 502, 503, 504]


def test_neighbours_one_id_fills_the_sample(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE", 30)
    rng = np.random.default_rng(6)
    rows = [(7, rng.normal(size=8).tolist()) for _ in range(200)] + [(50 * i, rng.normal(size=8).tolist()) for i in range(20)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert Counter(r.query_id for r in found.collect()) == {50 * i: 5 for i in range(20)}


def test_pipeline(spark):
    """Each stage against a direct count on what its predecessor kept."""
    docs = common.table(spark, SF, "documents")
    rows = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept = out.collect()
        ids = {r.doc_id for r in kept}
        assert len(ids) == len(kept) and ids <= {r.doc_id for r in rows}
        if name == "near_duplicates":
            least = {c for (_, _, c) in brute_classes([(r.doc_id, r.text) for r in rows])}
            assert ids == least
        if name == "decontamination":
            items = [r.text for r in common.table(spark, SF, "benchmark").collect()]
            held = {r.doc_id for r in rows if any(t in r.text for t in items)}
            assert held and ids == {r.doc_id for r in rows} - held
        if name == "secrets":
            assert ids == {r.doc_id for r in rows}
            before = {r.doc_id: r.text for r in rows}
            changed = [r for r in kept if r.text != before[r.doc_id]]
            assert changed and all(re.search(r"AKIA|password=|token = ", before[r.doc_id], re.I) and "[SECRET]" in r.text for r in changed)
            assert all(r.n_chars == len(r.text) for r in changed)
        docs, rows = spark.createDataFrame(kept, docs.schema), kept
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    total = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in total} == {r.doc_id for r in rows} and all(r.n == r.t for r in total)
    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.t) for r in total) == Counter((r.doc_id, r.doc_tokens) for r in whole.select("doc_id", "doc_tokens").distinct().collect())
    assert whole.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(F.col("n") > packing.WINDOW).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
