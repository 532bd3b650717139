import numpy as np

from thermaweave.llm import quality
from thermaweave.llm.queries import QUERIES


def test_votes_against_brute_force():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "GAMMA!!", "| x |", "12"], rng.integers(0, 40))) for _ in range(90)]
    rows = np.stack([quality.terms(t) for t in texts])
    labels = rng.integers(0, 2, 60)
    model = quality.Model(rows[:60], labels)
    got = model.scores(texts[60:], block=7)
    for t, s in zip(texts[60:], got):
        v = quality.terms(t) @ model.project
        v = v / max(np.linalg.norm(v), 1e-12)
        near = sorted(((-float(v @ u), i) for i, u in enumerate(model.vectors)))[: quality.NEIGHBOURS]
        w = [max(-c, 1e-6) ** quality.POWER for c, _ in near]
        assert abs(s - sum(a * labels[i] for a, (_, i) in zip(w, near)) / sum(w)) < 1e-3


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(docs, quality.learn(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.3) == (got.predicted == 1)).all()
    assert (got.predicted == got.quality).mean() > 0.98 and got[got.quality == 1].predicted.mean() > 0.99


def test_query_scores_every_document(spark, sf_dir):
    got = QUERIES["op2_quality_classifier"](spark, sf_dir)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (None, "a", 5), (3, "word " * 100_000, 5), (3, "word " * 100_000, 5), (4, "😀 é\x00", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, held_out int")
    assert {r.score for r in quality.score(docs, quality.learn(docs, spark.createDataFrame([], "doc_id bigint, quality int"))).collect()} == {0.0}
    assert {r.score for r in quality.score(docs, quality.learn(docs, spark.createDataFrame([(3, 1), (None, 0), (2, None)], "doc_id bigint, quality int"))).collect()} == {1.0}
    labels = spark.createDataFrame([(d, d % 2) for d in (1, 2, 3, 4)], "doc_id bigint, quality int")
    got = quality.score(docs, quality.learn(docs, labels, held=9)).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs.limit(0), quality.learn(docs, labels, held=9)).count() == 0
