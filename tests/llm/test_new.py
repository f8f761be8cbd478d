"""Filter audit, chat transcripts, whitening: brute force, round trips, odd inputs."""

import hashlib
import random
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__
from compare import compare, duck
from faultspark.llm import audit, chat, whiten

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_audit", "op12_chat"])
def test_sql(spark, name):
    assert compare(spark, duck(SF), SF, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name]) is None


# --- audit

IDS = st.lists(st.integers(0, 60), unique=True).map(sorted)


@settings(max_examples=300, deadline=None)
@given(st.lists(IDS, max_size=5), IDS)
def test_merges(lists, ids):
    assert audit.union_size(lists) == len(set().union(*lists))
    assert audit.beyond(ids, lists) == sorted(set(ids) - set().union(*lists))
    for wanted in range(62):
        assert audit.gallop(ids, wanted, 0) == sum(i < wanted for i in ids)


def slow_audit(rows, labels):
    def fails(i, source, t):
        w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if x]
        same = [j for j, _, u in rows if (u or "") == t and j is not None]
        return (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                any(c in "#$%&*|" for c in t), i is not None and any(j < i for j in same))

    out = {}
    for part in {s or "" for _, s, _ in rows}:
        mine = [(i, fails(i, s, t or "")) for i, s, t in rows if (s or "") == part]
        table = {}
        for order in permutations(range(5)):
            left = mine
            for step, f in enumerate(order):
                gone = [(i, x) for i, x in left if x[f]]
                left = [(i, x) for i, x in left if not x[f]]
                table[order, step] = [len(left), len(gone), sum(x[f] for _, x in mine) - len(gone), sum(x[f] and sum(x) == 1 for _, x in mine),
                                      sum((i, "good") in labels for i, _ in gone), sum((i, "toxic") in labels for i, _ in gone)]
        for (order, step), values in table.items():
            total = sum(v[1] for (o, s), v in table.items() if o[s] == order[step])
            out[part, "".join("ABCDE"[f] for f in order), step + 1] = tuple(values + [total])
    return out


def test_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(audit, "RANGE", 3)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(90)] + ["BIG", "é", "a b"]
    texts = [None, "", "\x1c", "$", " ".join(["long"] * 5000)] + [
        rng.choice(["", "ABC ", "#"]) + rng.choice(" \t\n\x0b").join(rng.choices(words[:rng.choice([30, 93])], k=rng.choice([3, 49, 50, 51, 80, 100]))) for _ in range(25)]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "", "hot", "hot", "x"]), rng.choice(texts)) for _ in range(150)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in [None, *range(40), *range(20)]]
    known = {(i, "good") for i, q, _ in labels if q == 1 and i is not None} | {(i, "toxic") for i, _, x in labels if x == 1 and i is not None}
    docs = spark.createDataFrame([(*r, 1, "f", 2) for r in rows], "doc_id long, source string, text string, id long, part string, fails int")
    found = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = slow_audit(rows, known)
    assert len(found) == len(want) == 600 * 3
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found} == want


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id string, source string, text string")
    assert audit.audit(docs, spark.createDataFrame([], "doc_id string, quality int, toxic int")).count() == 0


# --- chat

MARKS = st.lists(st.sampled_from(["#", "##", "###", "\\", "</turn>", "<", " ", "\n", ": ", "é", "assistant", "### user: "]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", ""]), MARKS), MARKS), max_size=5))
def test_transcripts_read_back(messages):
    text, spans = chat.render(messages)
    assert chat.parse(text) == messages
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in messages if r == "assistant"]


EVENTS = st.lists(st.tuples(st.sampled_from(chat.KINDS + ["other"]), st.integers(0, 4), st.sampled_from(["a", "b", None])), max_size=30)


@settings(max_examples=400, deadline=None)
@given(EVENTS, st.lists(st.integers(0, 30), max_size=4))
def test_slices_fold_to_the_same(events, cuts):
    events = [(kind, m, m, role, f"<{n}>") for n, (kind, m, role) in enumerate(events)]
    whole = chat.Fold()
    for e in events:
        whole.add(*e)
    merged, bounds = chat.Fold(), [0, *sorted(cuts), len(events)]
    for a, b in zip(bounds, bounds[1:]):
        part = chat.Fold()
        for e in events[a:b]:
            part.add(*e)
        for e in part.log():
            merged.add(*e)
    assert merged.final() == whole.final()


def test_log_of_events(spark):
    schema = "conv_id long, seq long, kind string, message_id string, turn long, role string, text string, slice int, n int"
    rows = [(1, 0, "message", "q", 0, "user", "hi"), (1, 1, "message", "a", 1, "assistant", ""), (1, 2, "delta", "a", 1, "assistant", "bad"),
            (1, 3, "regenerate", None, 1, None, None), (1, 5, "delta", "b", 1, "assistant", "od"), (1, 4, "delta", "b", 1, "assistant", "go"),
            (1, 6, "edit", "q", 0, None, "hello"), (2, None, "message", "z", None, None, None), (3, 1, "delete", "z", 0, "user", None),
            (None, 1, "message", None, 0, "user", "x"), (None, 2, "delta", None, 0, "user", "x"), (None, 2, "delta", None, 0, "user", "x"), (4, 1, None, "z", 0, "user", "x")]
    log = spark.createDataFrame([(*r, 7, 7) for r in rows], schema)
    want = {1: [("user", "hello"), ("assistant", "good")], 2: [("", "")], 3: [], None: [("user", "xxx")], 4: []}
    for size in (1000, 2):
        found = {r.conv_id: chat.parse(r.formatted) for r in chat.reconstruct(log.repartition(5), size).collect()}
        assert found == want
    assert chat.reconstruct(log.limit(0)).count() == 0


def test_conversations_in_slices(spark):
    """A conversation with most of the rows, cut into slices, comes out as in one piece."""
    rows = [(1 if k % 3 else 2, k // 4, random.Random(k).choice(["user", "assistant", None]), random.Random(k).choice([None, "", "x" * 3000, f"### t{k} \\"])) for k in range(240)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, kind int")
    log = chat.log_of(chat.with_trap(table))
    a = {r.conv_id: r for r in chat.digests(chat.reconstruct(log, 16)).collect()}
    b = {r.conv_id: r for r in chat.digests(chat.reconstruct(log)).collect()}
    assert a == b and set(a) == {1, 2, -7}
    for c in (1, 2):
        turns = sorted([(t, r or "", x or "") for k, t, r, x in rows if k == c])
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert a[c].n_turns == len(turns) and a[c].loss_chars == len(said) and a[c].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert a[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()


# --- whitening

@settings(max_examples=100, deadline=None)
@given(st.integers(1, 130), st.integers(1, 5), st.sampled_from([1, 900, 1 << 40, 1 << 61]), st.integers(0, 9))
def test_scatter_is_exact(rows, d, reach, seed):
    x = np.random.default_rng(seed).integers(-reach, reach, (rows, d))
    sums, cross = whiten.scatter(x)
    assert [int(s) for s in sums] == [sum(int(v) for v in x[:, i]) for i in range(d)]
    for i in range(d):
        for j in range(i, d):
            assert cross[i, j] == sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j]))


def check_whitened(rows, found):
    """``rows``: (vec_id, list) of the rows that should remain."""
    x = np.array([np.floor(1024 * np.array(v, np.float64)) + 100_000 for _, v in rows]).astype(np.int64)
    n, d = x.shape
    m = min(8, d)
    offsets = x - x.sum(0) / n
    cov = offsets.T @ offsets / n
    values = np.linalg.eigvalsh(cov)[::-1]
    deviation = ((n * x - x.sum(0)) ** 2).sum(1)
    assert len(found) == n * m
    got = sorted((r.vec_id, r.deviation) for r in found if r.component == 1)
    assert got == sorted((i, int(q)) for (i, _), q in zip(rows, deviation))
    for k in range(m):
        mine = sorted([r for r in found if r.component == k + 1], key=lambda r: r.vec_id)
        assert {r.n for r in mine} == {n} and abs(mine[0].explained - values[k] / np.trace(cov)) < 1e-9
        assert mine[0].identity_error < 1e-9
    z = np.array([[r.whitened for r in sorted(found, key=lambda r: r.vec_id) if r.component == k + 1] for k in range(m)])
    assert np.abs(z @ z.T / n - np.eye(m)).max() < 1e-9
    # Projections undo: cov times the axis found from whitened values is its eigenvalue times the axis.
    for k in range(m):
        axis = offsets[np.argsort([i for i, _ in rows])].T @ z[k] / n / np.sqrt(values[k])
        assert np.abs(cov @ axis - values[k] * axis).max() < 1e-6 * values[0]


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(rows, __spark_entry__.queries()["op13_whitening"](spark, SF).collect())


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(70)]
    odd = [(100, None), (101, [1.0] * 4 + [None]), (102, [float("nan")] * 5), (103, [float("inf")] + [0.0] * 4), (104, [1.0] * 4), (105, [])]
    more = [(106, [0.0] * 5), (107, rows[0][1])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows + odd + more], "vec_id long, embedding array<double>, n int, v int").repartition(4)
    check_whitened(rows + more, whiten.whiten(table).collect())


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    found = whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).collect()
    assert len(found) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error is None for r in found)
    found = whiten.whiten(spark.createDataFrame([(1, [1e38, 2.0]), (2, [-1e38, 2.0]), (3, [0.0, 2.0])], schema)).collect()
    assert len(found) == 6 and {r.deviation for r in found if r.vec_id == 1} == {None}
    assert whiten.whiten(spark.createDataFrame([(1, None)], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([], schema)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
