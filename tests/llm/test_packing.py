import zlib

import numpy as np
import pandas as pd
import pytest

from thermaweave.llm import packing
from thermaweave.llm.queries import QUERIES


def check_whole(rows, size=2048):
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == np.r_[0, g["length"].cumsum().to_numpy()[:-1]]).all() and g["length"].sum() <= size


def test_ids_and_packing_on_a_table(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = QUERIES["op4_best_fit_packing"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    want = []
    for d, t in zip(docs.doc_id, docs.text):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(d, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted(want) == sorted(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None))
    check_whole(got)
    assert got["sequence_id"].nunique() <= 1.01 * -(-got["length"].sum() // 2048) + 1


@pytest.mark.parametrize("text", ["a\x85b c\xa0d", "x y　z Å", "<|endoftext|> a<|startoftext|>b", "ΑΣ. İstanbul", "it's 'll don't 12.5", "a\x1cb\x1fc", "", "   ", "ÉCOLEÉ ß", "a\x00b", "Straßé́ ​"])
def test_words_give_the_ids_of_the_whole_text(text):
    coder = packing.WordCoder(packing.TOKENIZER)
    assert coder.ids(text) == coder._plain(text)


def test_memo_is_bounded():
    coder = packing.WordCoder(packing.TOKENIZER, memo=3)
    for text in ("one two three four five", "six one", "seven eight nine"):
        assert coder.ids(text) == coder._plain(text)


def test_rule_against_brute_force():
    rng = np.random.default_rng(1)
    lengths, size = rng.integers(1, 20, 60), 20
    bins, offset, used = packing.sum_of_squares(lengths, size)
    check_whole(pd.DataFrame({"sequence_id": bins, "offset": offset, "length": lengths}), size)
    assert len(set(bins)) == used
    counts, plain = {}, 0  # the rule, placement by placement
    for s in sorted(lengths, reverse=True):
        def cost(g):
            c = dict(counts)
            c[g] = c.get(g, 0) - (g < size)
            c[g - s] = c.get(g - s, 0) + 1
            return sum(v * v for k, v in c.items() if 0 < k < size)
        best = min([g for g, n in counts.items() if n > 0 and s <= g < size] + [size], key=lambda g: (cost(g), g))
        plain += best == size
        if best < size:
            counts[best] -= 1
        counts[best - s] = counts.get(best - s, 0) + 1
    assert used <= plain


def test_edge_rows(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "a b", None), (2, "word " * 3000, "z"), (2, "word " * 3000, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    placed = packing.pack(packing.pieces(docs))
    got = placed.toPandas()
    check_whole(got)
    assert got["length"].sum() == 1 + 1 + 3 + 2 * 3001 and (got["length"] == 2048).sum() == 2
    joined = packing.sequences(placed).toPandas()
    assert sum(len(x) for x in joined["ids"]) == 4 * got["length"].sum() and joined["pieces"].sum() == len(got)
    assert packing.pack(packing.pieces(docs.limit(0))).count() == 0
