"""Benchmark decontamination by spaced seeds.

A spaced seed is a fixed mask over consecutive words; only the words at its ones are hashed, so a
substituted word at a zero does not hide a shared passage. Hashes of every window of the documents
meet those of every window of the benchmark items. Around each hit the document and the item
are laid over each other word by word, and the longest stretch in which at least ``similarity`` of
the words agree is taken. It counts when it has ``least_words`` words, or as many as a shorter item has.

The benchmark goes to the tasks in blocks of at most about ``block_bytes`` bytes of text, one pass over the
documents for each block, so its size has no limit. Documents are never shuffled.

Defined cases: words are lower-cased (A-Z) runs without ASCII white space; an item with fewer words than a mask's
span is hashed by those masks that fit and, at any length, as a whole; items without words, NULL
or empty texts match nothing; NULL ids are kept; repeated rows and items each give their own rows; an empty
table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Five words each.
MASKS = ("11111", "1101101", "11010011", "101100101")
SIMILARITY = 0.8
LEAST_WORDS = 13
BLOCK_BYTES = 32 << 20


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def longest_overlap(same: np.ndarray, similarity: float) -> tuple[int, int]:
    """Start and length of the longest stretch in which at least ``similarity`` of the words agree, trimmed to words that agree."""
    # Positive where a stretch has more agreeing words than it needs; whole numbers, so that ties are exact.
    share = round(similarity * 1000)
    sums = np.r_[0, np.cumsum(np.where(same, 1000 - share, -share))]
    lowest = np.minimum.accumulate(sums)
    first = np.searchsorted(-lowest, -sums, side="left")
    length = np.arange(len(sums)) - first
    end = int(length.argmax())
    start, end = int(first[end]), end
    while start < end and not same[start]:
        start += 1
    while end > start and not same[end - 1]:
        end -= 1
    return start, end - start


class SeedIndex:
    """Hashes of all masked windows of some items."""

    def __init__(self, items: list[tuple], masks=MASKS, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS):
        self.items = [(key, words_of(text)) for key, text in items]
        self.items = [(key, ws) for key, ws in self.items if ws]
        self.similarity, self.least_words = similarity, least_words
        vocabulary: dict[bytes, int] = {}
        self.coded = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], np.int64) for _, ws in self.items]
        self.vocabulary = vocabulary
        self.value = np.random.default_rng(7).integers(1, 1 << 63, len(vocabulary) + 1, dtype=np.uint64) | np.uint64(1)
        spans = {len(m) for m in masks}
        shapes = [np.flatnonzero([c == "1" for c in m]) for m in masks]
        # Items that some mask does not fit are also hashed whole, by a mask of their own length.
        shapes += [np.arange(n) for n in sorted({len(c) for c in self.coded if len(c) < max(spans)})]
        self.seeds = []
        for shape in shapes:
            found = [(h, i, p) for i, c in enumerate(self.coded) for h, p in zip(*self.windows(c, shape))]
            if found:
                h = np.array([f[0] for f in found], np.uint64)
                order = np.argsort(h, kind="stable")
                self.seeds.append((shape, h[order], np.array([f[1] for f in found])[order], np.array([f[2] for f in found])[order]))

    def windows(self, coded: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and positions of the windows whose masked words are all words of the benchmark."""
        n = len(coded) - int(shape[-1])
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        known = coded > 0
        at = np.flatnonzero(np.logical_and.reduce([known[k : k + n] for k in shape]))
        h = np.zeros(len(at), np.uint64)
        for k in shape:
            h = (h ^ self.value[coded[at + k]]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return h, at

    def overlaps(self, text: str | None) -> list[tuple]:
        """(item, start in text, start in item, words, words that agree), the longest for each item."""
        ws = words_of(text)
        if not ws:
            return []
        coded = np.fromiter(map(self.vocabulary.get, ws, (0 for _ in ws)), np.int64, len(ws))
        diagonals: set[tuple[int, int]] = set()
        for shape, hashes, item, place in self.seeds:
            h, at = self.windows(coded, shape)
            if not len(h):
                continue
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(hi > lo):
                diagonals.update((int(item[x]), int(at[k] - place[x])) for x in range(lo[k], hi[k]))
        best: dict[int, tuple] = {}
        for i, shift in sorted(diagonals):
            own = self.coded[i]
            lo, hi = max(0, -shift), min(len(own), len(coded) - shift)
            same = own[lo:hi] == coded[lo + shift : hi + shift]
            start, length = longest_overlap(same, self.similarity)
            if length >= min(self.least_words, np.ceil(self.similarity * len(own))) and length > best.get(i, (0, 0, 0, 0))[3]:
                best[i] = (self.items[i][0], lo + start + shift, lo + start, length, int(same[start : start + length].sum()))
        return list(best.values())


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    masks=MASKS, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document and item that share a passage: ids, doc_start, item_start, words, matched."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for sent in _blocks(benchmark, item_col, item_text, block_bytes):
        index: list[SeedIndex] = []

        def rows(batch, sent=sent, index=index):
            if not index:
                index.append(SeedIndex(sent.value, masks, similarity, least_words))
            made: dict[str, list] = {c: [] for c in ("_id", "_item", "doc_start", "item_start", "words", "matched")}
            for key, text in zip(batch["_id"], batch["_text"]):
                for found in index[0].overlaps(text):
                    for c, v in zip(made, (key, *found)):
                        made[c].append(v)
            return made

        part = map_batches(source, rows, f"_id {kind}, _item {item_kind}, doc_start bigint, item_start bigint, words bigint, matched bigint")
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("_id", id_col).withColumnRenamed("_item", item_col)


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int):
    """The items as broadcasts of about ``block_bytes`` bytes each."""
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text")).where(F.length(F.trim("_text")) > 0)
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        chosen = items if blocks == 1 else items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == block)
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in chosen.collect()])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", masks=MASKS, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that share a passage with the benchmark; all columns stay."""
    for sent in _blocks(benchmark, item_col, item_text, block_bytes):
        index: list[SeedIndex] = []

        def rows(batch, sent=sent, index=index):
            if not index:
                index.append(SeedIndex(sent.value, masks, similarity, least_words))
            keep = [not index[0].overlaps(t) for t in batch[text_col]]
            return {c: [v for v, k in zip(vs, keep) if k] for c, vs in batch.items()}

        docs = map_batches(docs, rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that share a passage with the benchmark, one row each: id, items, longest (words)."""
    key = options.get("id_col", "doc_id")
    found = overlaps(docs, benchmark, **options)
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("items"), F.max("words").alias("longest"))
