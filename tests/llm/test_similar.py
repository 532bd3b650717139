from itertools import combinations

import numpy as np
import pytest

from thermaweave.llm import similar


def plain_sets(texts):
    out = []
    for t in texts:
        ws = (t or "").lower().split()
        out.append({tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} or ({tuple(ws)} if ws else set()))
    return out


def plain_groups(texts, least=0.8):
    """Components of all pairs with Jaccard similarity of ``least`` or more, and those pairs."""
    sets, label, links = plain_sets(texts), list(range(len(texts))), []
    for i, j in combinations(range(len(texts)), 2):
        x, y = sets[i], sets[j]
        if (len(x & y) / len(x | y) if x | y else 1.0) >= least:
            links.append((i, j))
    for _ in range(len(texts)):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    return label, links


def edited(words, changes, rng):
    """A copy with so many words changed, each far from the others."""
    out = list(words)
    for k in rng.permutation(len(words) // 12)[:changes]:
        out[12 * k + 6] = f"new{rng.integers(1 << 40)}"
    return out


def test_links_are_exact_jaccard(spark):
    rng = np.random.default_rng(5)
    texts = []
    for base in range(40):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 300)]
        # Each change takes five of 296 shingles: similarities from 0.97 to 0.63, above and below the bound.
        texts += [" ".join(words)] + [" ".join(edited(words, c, rng)) for c in (1, 3, 5, 6, 7, 9, 13)]
    texts += ["a b c d e f g", "A b c d e f g", "a  b c d e f g", None, "", "short text", "other words of this text here"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_row bigint, text string")
    got = {r["_row"]: r.component for r in similar.groups(docs, 5).collect()}
    label, links = plain_groups(texts)
    assert len(links) > 200 and [got[i] for i in range(len(texts))] == label
    got = {r["_row"]: r.component for r in similar.groups(docs, 5, block_nodes=3).collect()}  # components cut into blocks
    assert [got[i] for i in range(len(texts))] == label


def test_a_large_group_just_under_the_bound_leaves_few_rows(spark):
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
    texts = []
    for _ in range(600):  # any two share about two thirds of their shingles
        words = list(base)
        for k in rng.permutation(16)[:5]:
            words[12 * k + 5] = f"n{rng.integers(1 << 40)}"
        texts.append(" ".join(words))
    sets = [similar.shingle_set(t, 5) for t in texts]
    assert np.mean([similar.jaccard(x, y) >= 0.8 for x, y in zip(sets, sets[1:])]) < 0.3
    texts += [texts[0] + " more", texts[7] + " more"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_row bigint, text string").repartition(6)
    nodes = spark.createDataFrame([(i, *similar.long_fingerprint(similar.shingle_set(t, 5))) for i, t in enumerate(texts)], "node bigint, " + ", ".join(f"{c} bigint" for c in similar.PRINT))
    masks = similar.key_masks(*similar.shape(602))
    assert similar.candidates(nodes, masks).count() <= len(masks) * 602
    got = {r["_row"]: r.component for r in similar.groups(docs, 5, block_nodes=200).collect()}
    assert [got[i] for i in range(602)] == plain_groups(texts)[0]


def test_recall_at_the_bound_for_any_size():
    rng = np.random.default_rng(3)
    prints = []
    for _ in range(400):  # 0.80 to 0.82, without a Spark job
        common, own = rng.integers(0, 1 << 63, 90, dtype=np.uint64), rng.integers(0, 1 << 63, 22, dtype=np.uint64)
        prints.append([similar.long_fingerprint(np.r_[common, part]) for part in (own[:11], own[11:])])
    u = np.array(prints, np.int64).view(np.uint64)
    apart = u[:, 0] ^ u[:, 1]
    assert (np.bitwise_count(apart).sum(axis=1) <= similar.RADIUS).mean() > 0.99
    for n in (200, 200_000, 11_600_000):
        masks = similar.key_masks(*similar.shape(n))
        hit = np.any([apart[:, t % similar.PARTS] & m == 0 for t, m in enumerate(masks)], axis=0)
        assert hit.mean() > 0.97


@pytest.mark.parametrize("every", [False, True])
def test_one_of_each_stays(spark, tmp_path, every):
    rows = [(1, "a b c d e f g", 1), (1, "a b c d e f g", 1), (None, "a b c d e f g", 2), (2, None, 3), (3, "", 4), (4, "other words of this text here", 5)]
    spark.createDataFrame(rows[: None if every else 0], "doc_id bigint, text string, _row int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = similar.keep_one(docs, 5)
    assert kept.columns == docs.columns and sorted((r.text or "") for r in kept.collect()) == (["", "a b c d e f g", "other words of this text here"] if every else [])
