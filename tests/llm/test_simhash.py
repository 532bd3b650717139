import numpy as np
import pytest
import xxhash

from thermaweave.llm import simhash
from thermaweave.llm.graph import components
from thermaweave.llm.queries import QUERIES


def plain_fingerprint(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        ws = ws.replace(c, " ")
    ws = [w for w in ws.split(" ") if w]
    sh = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    """fingerprint -> smallest linked fingerprint set, by all pairs."""
    u = np.array(sorted(set(prints)), np.uint64)
    label = np.arange(len(u))
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 3
    a, b = np.nonzero(near)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            return dict(zip(u.tolist(), label.tolist()))
        label = new


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    got = QUERIES["op8_simhash_near_dedup"](spark, sf_dir).toPandas().set_index("doc_id")
    want = {d: plain_fingerprint(t) for d, t in zip(docs.doc_id, docs.text)}
    part = plain_components(want.values())
    least = {}
    for d, p in want.items():
        least[part[p]] = min(d, least.get(part[p], d))
    assert len(got) == len(docs)
    for d, p in want.items():
        assert got.loc[d, "fingerprint"] == f"{p:016x}" and got.loc[d, "component_id"] == least[part[p]]


@pytest.mark.parametrize("spread", [5, 40])
def test_links_lose_none(spark, spread):
    rng = np.random.default_rng(spread)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {0, (1 << 64) - 1}
    for p in base:
        for _ in range(40):
            q = int(p)
            for bit in rng.choice(64, rng.integers(0, spread // 2 + 1), replace=False):
                q ^= 1 << int(bit)
            prints.add(q)
    part = plain_components(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fingerprint bigint"))
    root = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges).collect()}
    groups = {}
    for p in prints:
        groups.setdefault(root.get(p, p), set()).add(p)
    want = {}
    for p in prints:
        want.setdefault(part[p], set()).add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + k: 1000 for k in range(1, 50)}


def test_edge_rows(spark):
    rows = [(3, None, "c"), (2, "", "c"), (9, " \n", "c"), (None, "One two", "c"), (5, "one TWO", "c"), (5, "one TWO", "c"), (8, "É un\tdeux trois quatre" * 500, None)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string")).collect()
    by = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in got)
    assert [(d, c) for d, _, c in by] == [(-1, 5), (2, 2), (3, 2), (5, 5), (5, 5), (8, 8), (9, 2)]
    assert {f for d, f, _ in by if d in (2, 3, 9)} == {"0" * 16} and by[0][1] == f"{plain_fingerprint('one two'):016x}"
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
