import re

import corpus_pipeline as pipe
from thermaweave.llm import secrets, simhash, toxicity
from thermaweave.llm.common import staged


def plain_links(texts):
    """Pairs of positions whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = []
    for t in texts:
        ws = t.encode().lower().split()
        sets.append({tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} or ({tuple(ws)} if ws else set()))
    return [(i, j) for j, y in enumerate(sets) for i, x in enumerate(sets[:j]) if (len(x & y) / len(x | y) if x | y else 1.0) >= 0.8]


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for k, (name, stage) in enumerate(pipe.STAGES):
        docs = staged(stage(spark, docs, sf_dir), name)
        now = docs.collect()
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            want = {d for d, t in kept.items() if model.scores([t])[0] < 0.5}
        if k == 1:
            ids = sorted(kept)
            label = list(range(len(ids)))
            links = plain_links([kept[d] or "" for d in ids])
            while any(label[i] != label[j] for i, j in links):
                for i, j in links:
                    label[i] = label[j] = min(label[i], label[j])
            groups = {}
            for d, g in zip(ids, label):
                groups.setdefault(g, set()).add(d)
            left = {r.doc_id for r in now}
            assert all(len(g & left) == 1 for g in groups.values()) and len(groups) < len(ids)
            want = left
        if k == 2:
            items = [r.text.lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            runs = {" ".join(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12))}
            want = {d for d, t in kept.items() if not any(r in " ".join(t.lower().split()) for r in runs)}
        if k == 3:
            want = set(kept)
            ranks = secrets.ranked_words(spark.createDataFrame([(t,) for t in kept.values()], "text string"))
            assert all(r.text == secrets.hide(kept[r.doc_id], secrets.spans(kept[r.doc_id], ranks)) and r.n_chars == len(r.text) for r in now)
            assert not any(re.search("[0-9a-f]{24}|AKIA[A-Z0-9]{16}", r.text) for r in now)
        if k < 4:
            assert {r.doc_id for r in now} == want and len(now) == len(want)
            kept = {r.doc_id: r.text for r in now}
    assert {r.doc_id for r in now} == set(kept)
    assert sorted(map(tuple, pipe.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in now)


def test_one_of_each_group_stays_among_odd_rows(spark, tmp_path):
    rows = [(1, "a b c d e f g", 1), (1, "a b c d e f g", 1), (None, "a b c d e f g", 2), (2, None, 3), (3, "", 4), (4, "other words of this text here", 5)]
    spark.createDataFrame(rows, "doc_id bigint, text string, component_id int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = simhash.keep_one(docs, 5, 3)
    assert kept.columns == docs.columns and sorted((r.text or "") for r in kept.collect()) == ["", "a b c d e f g", "other words of this text here"]
    assert simhash.keep_one(docs.limit(0), 5, 3).count() == 0
