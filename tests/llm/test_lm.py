import math
import zlib
from collections import Counter

import numpy as np
import pytest

from thermaweave.llm import lm
from thermaweave.llm.queries import QUERIES


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs):
    """Base scores by the stated formula."""
    split = lambda t: [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered(t)).split(" ") if w]
    train = Counter()
    for d, t in docs:
        if d is None or zlib.crc32(str(d).encode()) % 5 != 1:
            train.update([*split(t), "\n"])
    n, v = sum(train.values()), len(train)
    out = []
    for d, t in docs:
        own = [*split(t), "\n"]
        out.append((d, len(own), sum(train[w] > 0 for w in own), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)))
    return out


def test_query_against_stated_formula(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 300)  # so that most tokens take the join
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op9_language_model_scores"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, n, known, train, base in plain(docs):
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, train, zlib.crc32(str(d).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0 and math.isfinite(r.score)


def test_scores_do_not_depend_on_partitions(spark, sf_dir):
    got = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            docs = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(int(n))
            got.append({r.doc_id: r.score for r in lm.score(docs).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == pytest.approx(got[1], rel=1e-9)


def test_bits_make_probabilities():
    words = [b"abc", b"ab", b"b", lm.END, b"a" * 60]
    tables = [np.random.default_rng(s).integers(0, 50, (1 << b, 2)).astype(np.float32) for s, b in enumerate(lm.SLOTS)]
    mixer = lm.Mixer(tables)
    mixer.learn(words * 3, np.zeros(15, np.int64), np.arange(1.0, 16))
    mixer.freeze()
    first = [mixer.log10([bytes([x])], np.zeros(1, np.int64))[0] for x in range(256) if x not in (10,)]
    # A one-byte token is its byte and the space; bytes sum to 1 at most.
    assert sum(10**v for v in first) < 1
    one = mixer.log10(words, np.array([0, 1, 2, 0, 1]))
    each = [mixer.log10([w], np.array([g]))[0] for w, g in zip(words, [0, 1, 2, 0, 1])]
    assert np.allclose(one, each) and np.allclose(one, mixer.log10(words, np.array([0, 1, 2, 0, 1]), block=3))


def test_model_beats_the_unigram_on_held_out_texts(spark):
    got = lm.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").groupBy().sum("score", "base_score").first()
    assert got[0] > got[1]


def test_classes_follow_the_past_only():
    rng = np.random.default_rng(0)
    texts = [[f"{'ab'[k % 2]}{rng.integers(9)}".encode() for _ in range(40)] for k in range(80)]
    classes = lm.Classes(texts, classes=2)
    whole = classes.runs(texts[0] + texts[1])
    part = classes.runs(texts[0])
    assert whole[0] == part[0] == (0, 0, 1) and whole[1][0] == part[1][0] and {g for g, _, _ in part[1:]} != {g for g, _, _ in classes.runs(texts[1])[1:]}
    assert [w for _, p in classes.keyed(texts[0]) for w in p] == [*texts[0], lm.END] and classes.keyed([]) == [(0, [lm.END])]


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (None, "One two ONE", 1), (3, "é " * 60_000, 1), (3, "é " * 60_000, 1), (4, "z" * 100_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = lm.score(docs).collect()
    want = sorted(plain([(d, t) for d, t, _ in rows]), key=str)
    assert [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in sorted(got, key=lambda r: str((r.doc_id, r.n_tokens)))] == [w[:4] for w in want]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(docs.limit(0)).count() == 0
    held = next(d for d in range(99) if zlib.crc32(str(d).encode()) % 5 == 1)
    only = lm.score(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string")).first()
    assert only.base_score == 0 and only.n_known == 0 and only.train_tokens == 0 and only.score < 0


def test_mixer_is_learnt_once(spark):
    """The blocks are shuffled and learnt: two jobs. A sort by Spark would learn them a second time to cut ranges."""
    counts = spark.createDataFrame([(0, bytearray(f"w{i}".encode()), 1 + i % 9) for i in range(500)], "group int, token binary, n bigint")
    tables = lm.context_tables(counts)
    spark.sparkContext.setJobGroup("mix", "mix")
    try:
        lm.mix(counts, tables)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("mix")) <= 2


def test_shared_beginnings_are_evaluated_once(monkeypatch):
    """The work of scoring tokens follows their distinct beginnings in a class, not their bytes."""
    words = [b"one", b"oneself", b"ones", b"o", b"one", b"two", lm.END, b"oneself", b"tw" * 40_000, b"twice", "één".encode()]
    group = np.array([0, 0, 0, 0, 0, 1, 0, 1, 1, 1, 0])
    tables = [np.random.default_rng(s).integers(0, 50, (1 << b, 2)).astype(np.float32) for s, b in enumerate(lm.SLOTS)]
    mixer = lm.Mixer(tables)
    mixer.learn(words, group, np.arange(5.0, 16))
    mixer.freeze()
    each = [mixer.log10([w], np.array([g]))[0] for w, g in zip(words, group)]
    seen, real = [], lm.bits
    monkeypatch.setattr(lm, "bits", lambda x, hashes: seen.append(len(x)) or real(x, hashes))
    assert np.allclose(mixer.log10(words, group), each, rtol=1e-9)
    coded = [(g, w if w == lm.END else w + b" ") for g, w in zip(group.tolist(), words)]
    assert sum(seen) == len({(g, w[: k + 1]) for g, w in coded if len(w) < 100 for k in range(len(w))} | {(1, 80_000, k) for k in range(2, 80_001)})


def test_context_tables_count_every_occurrence(spark):
    """Beginnings that tokens share are counted together, each token as often as it occurs; rare ones stay out of the first two tables."""
    rows = [(g, bytearray(w.encode()), n) for g, w, n in [(0, "one", 9), (0, "ones", 3), (1, "one", 20), (0, "o", 8), (0, "\n", 5)]]
    got = lm.context_tables(spark.createDataFrame(rows, "group int, token binary, n bigint"))
    size = [8 * n * (len(w) + (w != b"\n")) for _, w, n in rows]
    assert [t.sum() for t in got] == [sum(s for s, r in zip(size, rows) if r[2] >= lm.RARE)] * 2 + [sum(size)] * 4


def test_tokens_of_a_batch_are_those_of_each_text():
    texts = [" One  two\x0bONE", "", None, "\t\n", "a\x1cB\u0085c d É x ", "x" * 5000, " "]
    code, bounds, words = lm.token_stream(lm.pa.array(texts).slice(0, len(texts)))
    words = words.to_pylist()
    assert [[words[c] for c in code[a:b]] for a, b in zip(bounds, bounds[1:])] == [[*lm.tokens(t), lm.END] for t in texts]
    assert len(set(words)) == len(words)


def test_classes_of_a_batch_are_those_of_each_text():
    rng = np.random.default_rng(0)
    texts = [[f"{'ab'[k % 2]}{rng.integers(9)}".encode() for _ in range(rng.integers(0, 40))] for k in range(80)]
    classes = lm.Classes(texts, classes=2)
    at = [[*(classes.place.get(w, -1) for w in t), -1] for t in [[], *texts, [b"other"]]]
    bounds = np.cumsum([0, *map(len, at)])
    whole = classes.groups(np.concatenate(at), bounds)
    alone = [classes.groups(np.array(a), np.array([0, len(a)])) for a in at]
    assert whole.tolist() == np.concatenate(alone).tolist() and set(whole.tolist()) == {0, 1, 2}
    for a, b, t in zip(bounds[1:], bounds[2:], texts):
        assert [g for g, low, high in classes.runs(t) for _ in range(low, high)] == whole[a : b - 1].tolist()


def test_classes_come_from_all_training_texts(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE", 40, raising=False)  # there was a bound of that name
    seen, counts = [], lm.class_counts
    monkeypatch.setattr(lm, "class_counts", lambda docs, classes: seen.append(classes) or counts(docs, classes))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "of no id"), (7, None), (7, " ")], docs.schema)).repartition(5)
    lm.score(docs)
    texts = [lm.tokens(r.text) for r in docs.collect() if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1]
    held = Counter(w for t in texts for w in set(t))
    got, want = seen[-1], lm.Classes(texts)
    assert list(got.place) == sorted(held, key=lambda w: (-held[w], w))[: lm.TELLING] == list(want.place)
    assert got.score.shape == (lm.CLASSES, len(held)) if len(held) < lm.TELLING else (lm.CLASSES, lm.TELLING)
    assert (got.score == want.score).all()
