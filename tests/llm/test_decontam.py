import random

import numpy as np
import pytest

from thermaweave.llm import decontam
from thermaweave.llm.queries import QUERIES


def plain_overlap(doc, item, similarity=0.8, least=13):
    """Longest stretch over all diagonals by trying every start and end."""
    best = 0
    for shift in range(-len(item) + 1, len(doc)):
        lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
        same = [item[k] == doc[k + shift] for k in range(lo, hi)]
        for a in range(len(same)):
            for b in range(len(same), a, -1):
                if b - a <= best:
                    break
                if sum(same[a:b]) * 10 >= similarity * 10 * (b - a) and same[a] and same[b - 1]:
                    best = b - a
    return best if best >= min(least, np.ceil(similarity * len(item))) else 0


def test_against_all_alignments(spark):
    rng = random.Random(3)
    word = lambda: "w%d" % rng.randrange(400)
    items = [[word() for _ in range(n)] for n in (1, 4, 7, 8, 13, 15, 30, 60) for _ in range(3)]
    docs = []
    for k in range(60):
        ws = [word() for _ in range(rng.randrange(0, 60))]
        if k % 3:
            part = list(items[k % len(items)])
            for at in rng.sample(range(len(part)), len(part) // 10):
                part[at] = "Zz"
            ws[10:10] = part if k % 2 else part[: len(part) // 2]
        docs.append(ws)
    index = decontam.SeedIndex([(i, " ".join(w)) for i, w in enumerate(items)])
    for ws in docs:
        got = {f[0]: f[3] for f in index.overlaps("\n".join(ws).upper())}
        low = [w.lower() for w in ws]
        want = {i: plain_overlap(low, item) for i, item in enumerate(items)}
        # Overlaps far over the limit are always found; every reported one is as long as the longest.
        for i, n in want.items():
            assert got.get(i, 0) in ((n,) if n else (0,)) or (i not in got and len(items[i]) < 15)


def test_query_finds_planted_passages_and_nothing_else(spark, sf_dir):
    got = QUERIES["op10_benchmark_decontamination"](spark, sf_dir).toPandas()
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    want = set()
    for i, t in zip(items.item_id, items.text):
        ws = t.lower().split()
        runs = {" ".join(ws[k : k + 13]) for k in range(max(1, len(ws) - 12))}
        want |= {(d, i) for d, x in zip(docs.doc_id, docs.text) if any(r in " ".join(x.lower().split()) for r in runs)}
    assert want and set(zip(got.doc_id, got.item_id)) == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_edge_rows(spark, block_bytes):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x one two three four five six y", 0), (3, "ONE\ttwo three four  five six", 0), (3, "ONE\ttwo three four  five six", 0), (4, "a b " * 20000, 0)], "doc_id bigint, text string, words int")
    items = spark.createDataFrame([(7, "one two three four five six"), (None, "one two three four five six"), (8, None), (9, " "), (10, "p q r s t u v w x y z")], "item_id bigint, text string")
    got = decontam.overlaps(docs, items, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id or 0, r.item_id or 0, r.doc_start, r.words, r.matched) for r in got) == sorted([(0, 7, 1, 6, 6), (0, 0, 1, 6, 6)] + [(3, 7, 0, 6, 6), (3, 0, 0, 6, 6)] * 2)
    assert sorted((r.doc_id or 0, r.items, r.longest) for r in decontam.leaks(docs, items).collect()) == [(0, 2, 6), (3, 4, 6)]
    assert decontam.overlaps(docs, items.limit(0)).count() == 0 and decontam.overlaps(docs.limit(0), items).count() == 0
