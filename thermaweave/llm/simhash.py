"""SimHash near-duplicates found with pivot distance tables.

A fingerprint bit is 1 where over half of a document's shingle hashes have it. Fingerprints that differ
in at most ``bits`` bits are linked, and linked documents form a component.

Search: each distinct fingerprint is cut into ``bits + 3`` blocks of bits. Two linked ones agree in
three blocks at least, so every choice of three blocks is a join key, and no link is lost. Among the
fingerprints under one key, the table of their Hamming distances to many reference fingerprints
(the pivots) decides first: by the triangle inequality a pair whose distances to some pivot differ by more
than ``bits`` cannot be linked. Survivors are verified on all bits. Pivots alone give no join key that
scales: the distances of unrelated fingerprints to a pivot lie within 3 of each other almost half
of the time, so a key of enough pivots to be selective would need hundreds of copies of each row.

Only a forest of the links leaves a task: never all pairs of a key. Equal texts are one row.

Defined cases: a NULL or empty text has no words and fingerprint 0, which is linked like any other;
fewer words than a shingle form one shingle; repeated rows stay and share their component; a NULL id
stays and never names a component unless all its members' ids are NULL; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged
from .graph import components

WORDS = 3
BITS = 3
SEED = 42
PIVOTS = 24


def shingle_hashes(text: str | None, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle of lower-cased (A-Z) words, repeats included."""
    from xxhash import xxh64_intdigest as xxh

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    if len(ws) < words:
        return np.array([xxh(b" ".join(ws), seed)], np.uint64)
    join = b" ".join
    return np.fromiter((xxh(join(s), seed) for s in zip(*(ws[k:] for k in range(words)))), np.uint64, len(ws) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit, as a signed 64-bit number."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        octets = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (long) of each whole text."""

    def rows(batch):
        return {"_id": batch["_id"], "fingerprint": [fingerprint(shingle_hashes(t, words)) for t in batch["_text"]]}

    kind = docs.schema[id_col].dataType.simpleString()
    made = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), rows, f"_id {kind}, fingerprint bigint")
    return made.withColumnRenamed("_id", id_col)


def block_masks(bits: int) -> list[int]:
    """For each choice of three of ``bits + 3`` blocks, their bits as a signed mask."""
    edges = np.linspace(0, 64, bits + 4).round().astype(int)
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [a | b | c for a, b, c in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def pivot_table(prints: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints."""
    reference = np.random.default_rng(SEED).integers(0, 1 << 64, pivots, dtype=np.uint64)
    return np.bitwise_count(prints[:, None] ^ reference[None, :]).astype(np.int8)


def linked(table: np.ndarray, prints: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs (a, b) of positions are linked: pivots discard, then all bits verify."""
    keep = np.arange(len(a))
    for p in range(table.shape[1]):
        if not len(keep):
            break
        keep = keep[np.abs(table[a[keep], p] - table[b[keep], p]) <= bits]
    return keep[np.bitwise_count(prints[a[keep]] ^ prints[b[keep]]) <= bits]


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest position connected to each of ``n`` positions."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links_in_runs(key: np.ndarray, prints: np.ndarray, bits: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the links between fingerprints of equal ``key`` (sorted): each as its position and that of its tree's root."""
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    run = np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))
    last = np.r_[start[1:], n][run]  # where each row's run ends
    inside = np.flatnonzero(last - start[run] > 1)
    label, table = np.arange(n), np.empty((n, PIVOTS), np.int8)
    table[inside] = pivot_table(prints[inside])
    gap, left = 1, inside
    while len(left):  # pairs at each distance within a run
        left = left[left + gap < last[left]]
        for at in range(0, len(left), block):
            a = left[at : at + block]
            b = a + gap
            # Pairs that are connected already say nothing new.
            fresh = label[a] != label[b]
            a, b = a[fresh], b[fresh]
            good = linked(table, prints, a, b, bits)
            if len(good):
                label = forest(n, a[good], b[good], label)
        gap += 1
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Distinct ``fingerprint`` values as edges (a, b) that connect all that are linked."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("agreed")) for i, m in enumerate(block_masks(bits))]))
    dealt = prints.select("fingerprint", keys.alias("k")).select("k.choice", "k.agreed", "fingerprint")
    dealt = dealt.repartition("choice", "agreed").sortWithinPartitions("choice", "agreed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # the run that may go on in the next batch

        def done(parts):
            choice, agreed, prints_ = (np.concatenate(x) for x in zip(*parts))
            # A key is a choice and its agreed bits; equal neighbours get equal numbers.
            key = np.cumsum(np.r_[0, (choice[1:] != choice[:-1]) | (agreed[1:] != agreed[:-1])])
            a, root = links_in_runs(key, prints_.view(np.uint64), bits)
            return pa.RecordBatch.from_arrays([pa.array(prints_[a]), pa.array(prints_[root])], names=["a", "b"])

        for batch in batches:
            now = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            n = len(now[0])
            if not n:
                continue
            tail = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = tail[-1] + 1 if len(tail) else 0
            if cut:
                yield done([*held, tuple(x[:cut] for x in now)])
                held = []
            elif held and (held[-1][0][-1], held[-1][1][-1]) != (now[0][0], now[1][0]):
                yield done(held)
                held = []
            held.append(tuple(x[cut:].copy() for x in now))
        if held:
            yield done(held)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id reachable over links."""
    prints = staged(fingerprints(docs, words, id_col, text_col), "fingerprints")
    least = staged(prints.groupBy("fingerprint").agg(F.min(id_col).alias("_least")), "distinct")
    found = components(links(least.select("fingerprint"), bits))
    # The root itself has no row of its own there.
    found = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    member = least.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint")
    named = member.groupBy("root").agg(F.min("_least").alias("_named"))
    named = member.join(named, "root").select("fingerprint", "_named")
    classes = least.join(named, "fingerprint", "left").select("fingerprint", F.coalesce("_named", "_least").alias("component_id"))
    return prints.join(classes, "fingerprint").select(id_col, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int, bits: int, text_col: str = "text") -> DataFrame:
    """``docs`` with the first row of each component only; all columns stay.

    ``docs`` is read from files, so its rows keep their numbers when they are read again.
    """
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    found = near_duplicates(numbered, words, bits, "_row", text_col)
    gone = found.where(F.col("_row") != F.col("component_id")).select("_row")
    return numbered.join(gone, "_row", "left_anti").drop("_row")
