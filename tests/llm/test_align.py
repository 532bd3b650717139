import hashlib
from collections import Counter

import numpy as np
import pytest

from thermaweave.llm import align
from thermaweave.llm.queries import QUERIES


def tokens(tool, text):
    """(ids, bytes) of both tokenizers for a whole text, or None."""
    if not text:
        return None
    a, b = tool.first.encode(" " + text, add_special_tokens=False).ids, tool.second.encode(text)
    parts = [[t.flat[t.first[k] : t.first[k] + t.lengths[k]].tobytes() for k in ids] for t, ids in zip(tool.bytes, (a, b))]
    whole = (" " + text).encode()
    return ((a, parts[0]), (b, parts[1])) if b"".join(parts[0]) == whole == b"".join(parts[1]) else None


def groups(tool, text):
    found = tokens(tool, text)
    if found is None:
        return []
    ends = []
    for _, parts in found:
        at, here = 0, []
        for p in parts:
            at += len(p)
            here.append(at)
        ends.append(here)
    both = sorted(set(ends[0]) & set(ends[1]))
    out, low = [], 0
    for high in both:
        out.append(tuple([k for k, e in zip(ids, es) if low < e <= high] for (ids, _), es in zip(found, ends)))
        low = high
    return out


def brute(tool, rows):
    made = [(key, groups(tool, text)) for key, text in rows]
    count = Counter()
    for _, gs in made:
        count.update({(a, b) for x, y in gs for a in x for b in y})
    most: dict = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for key, gs in made:
        links = [(a, b) for x, y in gs for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((key, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links), sum(count[k] == most[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tool():
    return align.Aligner()


HARD = [
    None, "", " ", "  ", "a ", " a", "a  b ", "\n", "x\n y", "x \n y\t ", "<|endoftext|> <s> </s>", "▁", "a▁b", "é ﬁ １ ü", "日本語 のテキスト", "a b c", "\x1c a", "a\x85 b", "\x00 z",
    "don't  stop!!  now", "🙂 👨‍👩‍👧 ok", "aaaa" * 300, "1234567890 " * 20, "​ x", "a\r\n b", "q" * 70 + " " + "-" * 90, "﻿bom", "é x",
]


def test_query(spark, sf_dir, tool):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op11_cross_tokenizer_alignment"](spark, sf_dir).collect()), key=str) == brute(tool, rows)


def test_hard_texts(spark, tool):
    rows = [(k % 20 if k % 7 else None, t) for k, t in enumerate(HARD * 2)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, _id int, _row int").repartition(4)
    want = brute(tool, rows)
    assert sum(r[1] == 0 for r in want) >= 6
    for block in (align.BLOCK, 40):  # the second takes many passes
        assert sorted((tuple(r) for r in align.alignments(docs, block=block).collect()), key=str) == want
    assert align.alignments(docs.limit(0)).count() == 0
    assert [tuple(r) for r in align.alignments(docs.where("text = ''")).limit(1).collect()][0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_long_texts_pass_in_blocks_and_chunks_are_forgotten(spark, tool, monkeypatch):
    texts = ["".join(f"w{k * k} " + ("\n  " if k % 17 == 0 else "") for k in range(400)), "b" * 500 + " c" * 300, "x y  z\t" * 200, "one ▁ " * 200]
    want = brute(tool, list(enumerate(texts)))
    monkeypatch.setattr(align, "LONG", 64)
    monkeypatch.setattr(align, "REMEMBERED", 30)
    tool.forget()
    for i, text in enumerate(texts):
        assert sum(1 for _ in tool.blocks(text)) > 3 and "".join(tool.blocks(text)) == " " + text
        made: list = []
        for _, _, numbers in tool.each_block([text]):
            made += [tool.written[n] for n in numbers]
        assert hashlib.sha256("".join(made)[:-1].encode()).hexdigest() == want[i][-1] if all(made) else want[i][-1] == ""


def test_the_faster_engine_gives_the_same_ids(spark, sf_dir, tool):
    assert tool.ranked is not None
    texts = [t for t in HARD if t] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect() if r.text]
    for t in texts:
        assert tool.encode_short(" " + t) == tool.encode(" " + t)


def test_groups_of_very_many_links_are_counted(spark, tool, monkeypatch):
    monkeypatch.setattr(align, "LARGE", 3)
    texts = ["unhappiness preposterousness unhappiness", "aaaa" * 300, "x1y2z3 q"]
    tool.forget()
    for text in texts:
        chunks = tool.chunks(" " + text)
        tool.learn([chunks])
        numbers = np.array([tool.known[c] for c in chunks])
        at = tool.links_of(numbers)
        got = Counter()
        for k, n in zip(np.frombuffer(tool.pairs, np.int64)[at], np.frombuffer(tool.times, np.int64)[at]):
            got[int(k >> 32), int(k & 0xFFFFFFFF)] += int(n)
        assert got == Counter((a, b) for x, y in groups(tool, text) for a in x for b in y)


def test_hash_is_minimal_and_perfect():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(0, 1 << 48, 60_000))
    bucket = align.bucket_of(keys)
    some = [int(b) for b in np.unique(bucket)]
    made = [align.build(keys[bucket == b]) for b in some]
    table = align.Hash(some, [m[0] for m in made], [m[1] for m in made])
    assert np.array_equal(np.sort(table.slots(keys)), np.arange(len(keys)))
    assert sum(len(m[1]) for m in made) * 8 < 6 * len(keys) + 64 * 12 * len(some)
    counts = align.Counts([(b, m[0], m[1], by_slot(keys[bucket == b], b, m).tobytes(), np.full((bucket == b).sum(), b).tobytes()) for b, m in zip(some, made)], np.zeros(1 << 16, np.int64))
    found, _ = counts.look_up(keys)
    assert np.array_equal(found, bucket)
    others = np.setdiff1d(rng.integers(0, 1 << 48, 20_000), keys)
    assert not counts.look_up(others)[0].any()  # keys are verified


def by_slot(keys, bucket, made):
    out = np.empty_like(keys)
    out[align.Hash([bucket], [made[0]], [made[1]]).slots(keys)] = keys
    return out
