import numpy as np
import pytest

from thermaweave.llm import ann
from thermaweave.llm.queries import QUERIES


def exact(ids, x, every=20, k=20):
    out = {}
    for q in sorted({i for i in ids if i % every == 0}):
        v = x[ids.index(q)]
        scored = sorted({(-float((v * u).sum()), i) for i, u in zip(ids, x) if i != q})[:k]
        out[q] = scored
    return out


def as_lists(rows):
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    return out


def test_recall_and_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    got, want = as_lists(QUERIES["op3_approximate_nearest_neighbours"](spark, "/root/testdata/sf0.01").collect()), exact(ids, x)
    assert set(got) == set(want)
    found = np.mean([len({i for i, _, _ in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in want])
    assert found >= 0.9
    for q, near in got.items():
        assert [n[2] for n in near] == list(range(1, len(near) + 1))
        assert [(i, s) for i, s, _ in near] == sorted(((i, s) for i, s, _ in near), key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(float((x[ids.index(q)] * x[ids.index(i)]).sum()), abs=1e-12) for i, s, _ in near)


def test_norms_copies_and_chunks(spark):
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 8)) * rng.uniform(0.2, 3, (300, 1))).astype(np.float32)
    x[100:180] = x[0]  # very many copies of a query
    ids = list(range(300))
    df = spark.createDataFrame([(i, v.tolist(), 0.5) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>, score double")
    got, want = as_lists(ann.search(df, width=3.0, probes=400, chunk=30).collect()), exact(ids, x.astype(np.float64))
    hit = np.mean([len({round(s, 6) for _, s, _ in got[q]} & {round(-s, 6) for s, _ in want[q]}) / len({round(-s, 6) for s, _ in want[q]}) for q in want])
    assert hit > 0.95 and [i for i, _, _ in got[0]][-5:] == [i for _, i in want[0]][-5:]


@pytest.mark.parametrize("norms", ["unit", "lognormal", "giant"])
def test_recall_with_defaults_on_skewed_norms(spark, norms):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "lognormal":
        x *= np.exp(rng.normal(0, 0.7, (1500, 1)))
    if norms == "giant":
        x[3] *= 20
    x = x.astype(np.float32)
    ids = list(range(1500))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>")
    got, want = as_lists(ann.search(df).collect()), exact(ids, x.astype(np.float64))
    assert all(len(got[q]) == 20 for q in want)
    assert np.mean([len({i for i, _, _ in got[q]} & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9


def test_ties_go_to_the_smaller_id_before_anything_is_cut(spark):
    rows = [(0, [1.0] + [0.0] * 80)] + [(k, [0.5] + [float(j == k) for j in range(1, 81)]) for k in range(1, 81)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    for width in (500.0, 1e-3):  # all in one cell; none in the query's
        assert [i for i, _, _ in as_lists(ann.search(df, width=width).collect())[0]] == list(range(1, 21))


def test_queries_that_meet_few_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "SCANNED", 3)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((240, 8)).astype(np.float32)
    ids = list(range(240))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>").repartition(5)
    got, want = as_lists(ann.search(df, width=1e-3).collect()), exact(ids, x.astype(np.float64))
    assert {q: [i for i, _, _ in n] for q, n in got.items()} == {q: [i for _, i in n] for q, n in want.items()}


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0]), (None, [1.0, 1.0]), (8, [0.5, 0.5]), (8, [0.5, 0.5]), (20, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = as_lists(ann.search(df, width=50.0).collect())
    assert {q: [i for i, _, _ in n] for q, n in got.items()} == {0: [1, 8, 20], 20: [8, 0, 1]}
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 2")).count() == 0


def keep_staged(monkeypatch):
    """What the search stages: tables, and their plans before they ran."""
    seen, plans, kept = {}, {}, ann.staged

    def staged(df, label="stage", *more):
        plans[label] = df._jdf.queryExecution().executedPlan().toString().split("\n")
        seen[label] = kept(df, label, *more)
        return seen[label]

    monkeypatch.setattr(ann, "staged", staged)
    return seen, plans


def test_queries_dealt_to_cells_are_not_broadcast(spark, monkeypatch):
    _, plans = keep_staged(monkeypatch)
    x = np.random.default_rng(6).standard_normal((2000, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    assert ann.search(df, every=500).count() == 80
    # Spark guesses the size of what a Python function makes from the file that it reads, here of four vectors.
    lines = plans["met"]
    assert any("MapInArrow" in line for line in lines)
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = lines[at + 1 :]
            end = next((k for k, b in enumerate(below) if len(b) - len(b.lstrip(" :+-*()0123456789")) <= line.index("BroadcastExchange")), len(below))
            assert not any("MapInArrow" in b for b in below[:end])


def test_equal_queries_are_asked_once(spark, monkeypatch):
    seen, _ = keep_staged(monkeypatch)
    x = np.repeat(np.random.default_rng(7).standard_normal((30, 8)), 40, axis=0).astype(np.float32)  # two queries of each vector
    ids = list(range(1200))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>").repartition(3)
    got, want = as_lists(ann.search(df, width=50.0).collect()), exact(ids, x.astype(np.float64))
    assert {q: [i for i, _, _ in n] for q, n in got.items()} == {q: [i for _, i in n] for q, n in want.items()}
    assert seen["asked"].count() == 30
