"""Documents whose five-word shingles have a Jaccard similarity of at least a bound, found with SimHash and verified exactly.

Each set of distinct shingles has ``4 x 64`` SimHash bits. At a similarity of 0.8 two sets differ in 15 % of
the bits (up to 19 % for very short texts), so a link is looked for among pairs that differ in at most ``RADIUS`` bits. Join keys are
``tables`` random choices of ``width`` bits: wider with the logarithm of the number of sets, so that a key
keeps about 256 unrelated ones, and so many tables that a pair at the bound shares none with a chance of about
``MISS`` (measured in tests). Among the rows of a key, distances to pivots drawn from the key discard
first (triangle inequality, no loss), then all bits; survivors are pairs, and only the Jaccard similarity of their whole
texts' shingles links them.

Survivors never leave a task as pairs, only as a spanning forest of each key. Every link lies inside one component of these forests, so it is
nodes that are dealt next, not pairs: each set of shingles goes to its component once, or, in a component of more than ``BLOCK_NODES`` sets or
``BLOCK_SHINGLES`` shingles, to each pair of its blocks. There all pairs of a component are compared (sizes, pivots, bits), survivors are verified
nearest first unless they are connected already, and a forest of the accepted links comes out.

Defined cases: texts without words are equal to each other, NULL among them; fewer words than a shingle form one shingle; equal sets of shingles are one node,
so repeated rows and ties cost nothing more; the first row of a group in the order of reading stays; ids, NULL or not, are not looked at; an empty table
gives an empty result; other columns are returned as they are, whatever their names. A very long text is one set of its shingles in one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import small_side
from .common import map_batches, staged
from .graph import components
from .simhash import SEED, forest, shingle_hashes

SIMILARITY = 0.8
PARTS = 4  # words of 64 bits
RADIUS = 64
#: Share of differing bits at the bound: the angle of two sets of equal size at 0.8, over a half turn.
APART = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
MISS = 5e-4
PIVOTS = 4
#: Survivors that a task holds before it thins them.
HELD = 1 << 20
#: Sets, and shingles in them, of one block of a component.
BLOCK_NODES, BLOCK_SHINGLES = 2000, 2_000_000
#: Rows of a list of documents that goes to every task (64 MB at most); a longer one meets the texts in a shuffle.
SENT = 500_000
PRINT = [f"f{k}" for k in range(PARTS)]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _mixed(h: np.ndarray, part: int) -> np.ndarray:
    """Another 64-bit hash of each hash (the finaliser of SplitMix64)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * part) & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def long_fingerprint(hashes: np.ndarray) -> list[int]:
    """The majority of each of ``PARTS x 64`` bits, as signed numbers."""
    ones = np.zeros((PARTS, 64), np.int64)
    for at in range(0, len(hashes), 1 << 13):
        part = hashes[at : at + (1 << 13)]
        octets = np.stack([_mixed(part, k) for k in range(PARTS)]).astype("<u8").view(np.uint8).reshape(PARTS, -1, 8)
        ones += np.unpackbits(octets, axis=2, bitorder="little").sum(axis=1, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def shape(n: int) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` sets."""
    width = min(24, max(8, math.ceil(math.log2(max(n, 2))) - 8))
    return width, math.ceil(math.log(MISS) / math.log1p(-((1 - APART) ** width)))


def key_masks(width: int, tables: int) -> np.ndarray:
    """For each table, its bits of the word ``table % PARTS``."""
    rng = np.random.default_rng(SEED)
    return np.array([sum(1 << int(b) for b in rng.permutation(64)[:width]) for _ in range(tables)], np.uint64)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positions of the edges of a spanning forest; edges are given best first."""
    label, left, chosen = np.arange(n), np.arange(len(a)), []
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.sort(np.concatenate(chosen)) if chosen else left
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[left]], left)
        np.minimum.at(best, label[b[left]], left)
        pick = np.unique(best[best < len(a)])
        chosen.append(pick)
        label = forest(n, a[pick], b[pick], label)


def _distance(prints: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints[a] ^ prints[b]).sum(axis=1, dtype=np.int16)


def survivors(key: np.ndarray, prints: np.ndarray, radius: int = RADIUS, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, distance) of pairs of positions with equal ``key`` (sorted) and at most ``radius`` differing bits."""
    n = len(key)
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, n])
    run = np.repeat(np.arange(len(start)), size)
    last = (start + size)[run]
    inside = np.flatnonzero(size[run] > 1)
    table = np.zeros((n, PIVOTS), np.int16)
    for p in range(PIVOTS):
        table[inside, p] = _distance(prints, inside, (start + size * p // PIVOTS)[run[inside]])
    gap, left = 1, inside
    while len(left):
        left = left[left + gap < last[left]]
        for at in range(0, len(left), block):
            a = left[at : at + block]
            b = a + gap
            for p in range(PIVOTS):
                keep = np.abs(table[a, p] - table[b, p]) <= radius
                if not keep.all():
                    a, b = a[keep], b[keep]
            d = _distance(prints, a, b)
            near = d <= radius
            if near.any():
                yield a[near], b[near], d[near]
        gap += 1


def candidates(nodes: DataFrame, masks: np.ndarray) -> DataFrame:
    """Pairs (a < b) of ``node``: of each key a spanning forest of its survivors."""
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(PRINT[t % PARTS]).bitwiseAND(F.lit(int(m.view(np.int64)))).alias("k")) for t, m in enumerate(masks)]))
    dealt = nodes.select("node", *PRINT, keys.alias("_key")).select("_key.t", "_key.k", "node", *PRINT)
    dealt = dealt.repartition("t", "k").sortWithinPartitions("t", "k", "node")

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        t, k, node = columns[:3]
        prints = np.stack(columns[3:], axis=1).view(np.uint64)
        key = np.cumsum(np.r_[0, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
        held: list[tuple[np.ndarray, ...]] = []

        def thinned():
            a, b, d = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(d, kind="stable")
            order = order[spanning(len(key), a[order], b[order])]
            return a[order], b[order], d[order]

        count, limit = 0, HELD
        for found in survivors(key, prints):
            held.append(found)
            count += len(found[0])
            if count >= limit:
                held = [thinned()]
                count = len(held[0][0])
                limit = HELD + count
        if held:
            a, b, _ = thinned()
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

    return dealt.mapInArrow(lambda batches: (out for columns in whole_keys(batches, 2) for out in pairs(columns)), "a bigint, b bigint").distinct()


def whole_keys(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of runs of rows in which no key (the first ``n_keys`` columns, sorted) is cut."""
    held: list[list[np.ndarray]] = []  # the key that may go on in the next batch
    for batch in batches:
        now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if not len(now[0]):
            continue
        other = np.flatnonzero(np.any([now[i] != now[i][-1] for i in range(n_keys)], axis=0))
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            yield [np.concatenate(x) for x in zip(*held, [c[:cut] for c in now])]
            held = []
        elif held and any(held[-1][i][-1] != now[i][0] for i in range(n_keys)):
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        held.append([c[cut:].copy() for c in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def accepted(prints: np.ndarray, sets: list[np.ndarray], side: np.ndarray, similarity: float, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A forest of the links between positions: all pairs, or those of different ``side`` where there are two."""
    n, size, chosen = len(sets), np.array([len(x) for x in sets]), []
    cross = side.min() != side.max() if n else False
    table = np.stack([_distance(prints, np.arange(n), np.full(n, n * p // PIVOTS)) for p in range(PIVOTS)], axis=1)
    found: list[tuple[np.ndarray, ...]] = []
    for a in range(n):
        b = np.arange(a + 1, n)
        if cross:
            b = b[side[b] != side[a]]
        b = b[(np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b])) & (np.abs(table[b] - table[a]).max(axis=1) <= radius)]
        d = np.bitwise_count(prints[b] ^ prints[a]).sum(axis=1, dtype=np.int16)
        b, d = b[d <= radius], d[d <= radius]
        if len(b):
            found.append((np.full(len(b), a, np.int32), b.astype(np.int32), d))
    if not found:
        return []
    a, b, d = (np.concatenate(x) for x in zip(*found))
    label = list(range(n))

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    order = np.argsort(d, kind="stable")
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        x, y = root(i), root(j)
        if x != y and jaccard(sets[i], sets[j]) >= similarity:
            label[max(x, y)] = min(x, y)
            chosen.append((i, j))
    return chosen


def links_in(members: DataFrame, texts: DataFrame, words: int, similarity: float, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """Forests of the links (a, b) inside components. ``members`` has node, component, shingles and fingerprints; ``texts`` has ``_row`` and ``_text``."""
    sizes = members.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_nodes), F.ceil(F.sum("shingles") / BLOCK_SHINGLES)).cast("int").alias("_blocks"))
    dealt = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    few = small_side(dealt.select(F.col("node").alias("_row"), "component", "block", "_blocks", *PRINT), SENT)
    asked = texts.join(few, "_row")  # texts stay where they are read while their members are few
    keep = ("component", "block", "_blocks", "_row", *PRINT)

    def shingled(batch):
        return {c: batch[c] for c in keep} | {"shingle": [shingle_set(t, words).tobytes() for t in batch["_text"]]}

    kinds = "component bigint, block int, _blocks int, _row bigint, " + ", ".join(f"{c} bigint" for c in PRINT)
    sets = map_batches(asked.select(*keep, "_text"), shingled, kinds + ", shingle binary")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    sent = sets.withColumn("_other", other).select("component", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "_row", *PRINT, "shingle")
    ordered = sent.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "_row")

    def run(batches):
        for columns in whole_keys(batches, 3):
            component, i, j, block, node = columns[:5]
            prints = np.stack(columns[5:-1], axis=1).astype(np.int64).view(np.uint64)
            cuts = np.flatnonzero((component[1:] != component[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            links: list[tuple[int, int]] = []
            for low, high in zip([0, *cuts], [*cuts, len(node)]):
                own = [np.frombuffer(x, np.uint64) for x in columns[-1][low:high]]
                links += [(low + x, low + y) for x, y in accepted(prints[low:high], own, block[low:high], similarity)]
            if links:
                a, b = node[np.array(links)].T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return ordered.mapInArrow(run, "a bigint, b bigint")


def groups(docs: DataFrame, words: int, similarity: float = SIMILARITY, row_col: str = "_row", text_col: str = "text", block_nodes: int = BLOCK_NODES) -> DataFrame:
    """``_row`` and ``component``, the smallest row reachable over links; ``row_col`` numbers the rows."""
    from xxhash import xxh3_128_intdigest as xxh

    texts = docs.select(F.col(row_col).alias("_row"), F.col(text_col).alias("_text"))

    def rows(batch):
        made: dict[str, list] = {c: [] for c in ("_row", "shingles", "s0", "s1", *PRINT)}
        for row, text in zip(batch["_row"], batch["_text"]):
            own = shingle_set(text, words)
            digest = np.array([xxh(own.tobytes()) >> s & (1 << 64) - 1 for s in (0, 64)], np.uint64).view(np.int64).tolist()
            for c, v in zip(made, (row, len(own), *digest, *long_fingerprint(own))):
                made[c].append(v)
        return made

    prints = staged(map_batches(texts, rows, "_row bigint, shingles bigint, s0 bigint, s1 bigint, " + ", ".join(f"{c} bigint" for c in PRINT)), "fingerprints")
    nodes = staged(prints.groupBy("s0", "s1", "shingles", *PRINT).agg(F.min("_row").alias("node")), "sets")
    masks = key_masks(*shape(nodes.count()))
    near = components(candidates(nodes, masks))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "component")
    members = staged(near.join(nodes.select("node", "shingles", *PRINT), "node"), "members")
    part = components(links_in(members, texts, words, similarity, block_nodes))
    member = nodes.select("s0", "s1", "node").join(part, "node", "left").select("s0", "s1", F.coalesce("root", "node").alias("component"))
    return prints.select("_row", "s0", "s1").join(member, ["s0", "s1"]).select("_row", "component")


def keep_one(docs: DataFrame, words: int, similarity: float = SIMILARITY, text_col: str = "text") -> DataFrame:
    """``docs`` with the first row of each group of near duplicates only; all columns stay.

    ``docs`` is read from files, so its rows keep their numbers when they are read again.
    """
    number = "_row"
    while number in docs.columns:
        number += "_"
    numbered = docs.withColumn(number, F.monotonically_increasing_id())
    gone = small_side(groups(numbered, words, similarity, number, text_col).where("_row != component").select(F.col("_row").alias(number)), SENT)
    return numbered.join(gone, number, "left_anti").select(*docs.columns)
