"""Alignment of two tokenizers, with corpus-wide counts of linked id pairs behind a minimal perfect hash.

A text is cut where a character that is not white space meets a space. No token of either tokenizer crosses such a place (the piece
vocabulary is checked for it), so the whole text's tokens are its chunks' tokens in a row, and a chunk met again is not encoded again.
Inside a chunk, places where tokens of both end cut the tokens into groups; every pair in a group is a link.

First pass: each task gives its documents' distinct pairs with the number of documents, by ``BUCKETS`` ranges of a 64-bit hash. A
bucket's distinct pairs get a minimal perfect hash: levels of bits, where a pair owns the first bit that it meets alone, and its slot is the number
of bits before it. Counts are then dense vectors indexed by slot, summed as a tree: ``SALTS`` partial vectors a bucket, then one. Beside
the counts stand the pairs by slot, and every look-up verifies its key there. Second pass: documents are aligned again, chunk by chunk, and their
links' counts are looked up.

Bounds. A bucket holds a 1,024th of all pairs, and pairs are at most the product of the vocabularies (50,257 x 32,000: 1.6 million a bucket).
Look-up tables are broadcast in blocks of buckets of at most ``BLOCK`` pairs (16 bytes each, so 64 MB); more pairs take one more pass over
the documents for each block, with sums added by a row number. The highest count of each first id is one number an id of the vocabulary.

Defined cases: a text that is NULL, empty, or whose token bytes do not give back a space and the text, has zeros and an empty digest, and counts for
nothing; strings of special tokens are plain text; repeated rows are documents of their own; very long texts pass in blocks of about
a million characters, and only a stretch without a single space is encoded at once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
BUCKETS = 1024
SALTS = 8
BLOCK = 1 << 22
#: Chunks (and distinct links of chunks) that a worker remembers before it starts anew.
REMEMBERED, REMEMBERED_LINKS = 400_000, 4_000_000
#: Chunks that are encoded as one text, and links of a group beyond which its distinct pairs are counted.
TOGETHER, LARGE = 20_000, 4096
#: Characters of a chunk that is encoded together with others.
SHORT = 200
#: Distinct pairs that a task gathers before it gives them out.
GATHERED = 2_000_000
#: Characters of one block of a long text.
LONG = 1 << 20
#: Bits a pair at each level of the hash.
ROOM = 1.6

_CUT = re.compile(r"(?<=\S)(?= )")
_SPACED = re.compile(r"\s ")


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Aligner:
    """Both tokenizers and the chunks met so far, numbered: counts, links and written groups by number."""

    def __init__(self, first: str = FIRST, second: str = SECOND):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        def path(name):
            return name if os.path.isabs(name) else public_tokenizers.path(name)

        self.first = Tokenizer.from_file(path(first))
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=path(second))
        letters = _byte_letters()
        a_bytes = [b""] * self.first.get_vocab_size(with_added_tokens=True)
        for entry, k in self.first.get_vocab(with_added_tokens=False).items():
            if all(c in letters for c in entry):
                a_bytes[k] = bytes(letters[c] for c in entry)
        self.ranked = _ranked(self.first, a_bytes, public_tokenizers.PATTERN)
        pieces = [self.second.id_to_piece(k) for k in range(self.second.get_piece_size())]
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        b_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.bytes = _Bytes(a_bytes), _Bytes(b_bytes)
        # Every id as text before what may follow it: a comma, a bar, a comma, a semicolon.
        self.letters = [f"{k}{sign}" for n, signs in ((len(a_bytes), ",|"), (len(b_bytes), ",;")) for sign in signs for k in range(n)]
        self.space = self.second.piece_to_id("▁")
        self.born, self.writes = 0, True
        self.forget()

    def encode(self, text: str) -> list[int]:
        """The first tokenizer's ids, as they are."""
        return self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode_short(self, text: str) -> list[int]:
        """The same ids for a text of chunks of at most ``SHORT`` characters."""
        return self.ranked.encode_ordinary(text) if self.ranked else self.encode(text)

    def forget(self):
        self.born += 1
        self.known: dict[str, int] = {}
        self.written: list[str] = []  # groups as text, each with a semicolon after it
        self.sizes = array("q")  # tokens of both, groups, links: four a chunk; zeros where the bytes differ
        self.starts, self.pairs, self.times = array("q", [0]), array("q"), array("q")

    def blocks(self, text: str):
        """The text, after a space, in blocks of whole chunks."""
        text = " " + text
        at = 0
        while self.cuts and len(text) - at > LONG:
            cut = _CUT.search(text, at + LONG)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:] if at else text

    def chunks(self, block: str) -> list[str]:
        """A block's chunks, each without its first space."""
        if not self.cuts:
            return [block[1:]]
        if _SPACED.search(block) is None:
            return block[1:].split(" ")
        return [c[1:] for c in _CUT.split(block)]

    def learn(self, lists: list[list[str]]):
        """Encode and align the chunks that are new; all of ``lists`` are known afterwards."""
        wanted = set().union(*lists)
        fresh = wanted - self.known.keys()
        if len(self.known) + len(fresh) > REMEMBERED or len(self.pairs) > REMEMBERED_LINKS:
            self.forget()
            fresh = wanted
        whole = [c for c in fresh if 0 < len(c) <= SHORT and "▁" not in c and not c[-1].isspace()]
        for at in range(0, len(whole), TOGETHER):
            part = whole[at : at + TOGETHER]
            self._add_all(part, self.encode_short(" " + " ".join(part)), self.second.encode(" ".join(part)))
        for c in fresh.difference(whole):  # these are long, cannot stand before a space and keep their tokens, or do not give back their bytes
            self._add_all([c], self.encode(" " + c), self.second.encode(c) if c else [self.space])

    def each_block(self, texts: list[str | None]):
        """Index of the text, whether the block is its first, and the block's chunks by number (good until the next block)."""
        short = [(i, self.chunks(" " + t)) for i, t in enumerate(texts) if t and len(t) < LONG]
        self.learn([c for _, c in short])
        for i, chunks in short:
            yield i, True, list(map(self.known.__getitem__, chunks))
        for i, t in enumerate(texts):
            if t and len(t) >= LONG:
                for k, block in enumerate(self.blocks(t)):
                    chunks = self.chunks(block)
                    self.learn([chunks])
                    yield i, k == 0, list(map(self.known.__getitem__, chunks))

    def _add_all(self, chunks: list[str], a: list[int], b: list[int]):
        """Align chunks that were encoded as one text."""
        raw = [(" " + c).encode("utf-8", "surrogatepass") for c in chunks]
        text = np.frombuffer(b"".join(raw), np.uint8)
        ids = np.asarray(a, np.int64), np.asarray(b, np.int64)
        ends = [table.ends(k) for table, k in zip(self.bytes, ids)]
        if not all(table.give(k, e, text) for table, k, e in zip(self.bytes, ids, ends)):
            if len(chunks) > 1:
                for c in chunks:
                    self._add_all([c], self.encode(" " + c), self.second.encode(c))
                return
            return self._store(chunks, np.zeros((1, 4), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1, np.int64), [""])
        chunk_ends = np.cumsum(np.fromiter(map(len, raw), np.int64))
        cut = [e == f[np.searchsorted(f, e)] for e, f in (ends, ends[::-1])]
        group = [np.cumsum(c) - c for c in cut]
        n = [np.bincount(g) for g in group]
        chunk_of = np.searchsorted(chunk_ends, ends[0][cut[0]])  # of each group
        links = n[0] * n[1]

        def per_chunk(values):
            return np.bincount(chunk_of, values, len(chunks)).astype(np.int64)

        sizes = np.stack([per_chunk(n[0]), per_chunk(n[1]), per_chunk(None), per_chunk(links)], axis=1)
        start = [np.cumsum(x) - x for x in n]
        # All links of a group, but for groups so large that their distinct pairs are counted instead.
        few = np.where(links <= LARGE, links, 0)
        at = np.repeat(np.arange(len(links)), few)
        k = np.arange(len(at)) - np.repeat(np.cumsum(few) - few, few)
        pairs = ids[0][start[0][at] + k // n[1][at]] << 32 | ids[1][start[1][at] + k % n[1][at]]
        times, owner = np.ones(len(pairs), np.int64), chunk_of[at]
        for g in np.flatnonzero(links > LARGE):
            (x, xn), (y, yn) = (np.unique(ids[i][start[i][g] : start[i][g] + n[i][g]], return_counts=True) for i in (0, 1))
            pairs = np.concatenate([pairs, (x[:, None] << 32 | y).ravel()])
            times = np.concatenate([times, (xn[:, None] * yn).ravel()])
            owner = np.concatenate([owner, np.full(len(x) * len(y), chunk_of[g])])
        order = np.argsort(owner, kind="stable")
        written = self._texts(ids, cut, group, start, n, chunk_of, len(chunks)) if self.writes else [""] * len(chunks)
        self._store(chunks, sizes, pairs[order], times[order], np.bincount(owner, minlength=len(chunks)), written)

    def _texts(self, ids, cut, group, start, n, chunk_of, n_chunks) -> list[str]:
        """Each chunk's groups as text: ids, commas, a bar, ids, commas, a semicolon."""
        sizes = [len(table.lengths) for table in self.bytes]
        out = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        out[np.arange(len(ids[0])) + start[1][group[0]]] = ids[0] + sizes[0] * (np.append(group[0][1:], -1) != group[0])
        out[np.arange(len(ids[1])) + (start[0] + n[0])[group[1]]] = 2 * sizes[0] + ids[1] + sizes[1] * cut[1]
        letters = self.letters
        words = [letters[k] for k in out.tolist()]
        ends = np.cumsum(np.bincount(chunk_of, n[0] + n[1], n_chunks).astype(np.int64)).tolist()
        return ["".join(words[low:high]) for low, high in zip([0, *ends], ends)]

    def _store(self, chunks, sizes, pairs, times, n_pairs, written):
        base = len(self.written)
        self.known.update(zip(chunks, range(base, base + len(chunks))))
        self.written += written
        self.sizes.frombytes(sizes.astype(np.int64).tobytes())
        self.pairs.frombytes(pairs.astype(np.int64).tobytes())
        self.times.frombytes(times.astype(np.int64).tobytes())
        self.starts.frombytes((self.starts[-1] + np.cumsum(n_pairs)).astype(np.int64).tobytes())

    def links_of(self, numbers: np.ndarray) -> np.ndarray:
        """Places in ``pairs`` of the chunks' links."""
        starts = np.frombuffer(self.starts, np.int64)
        low, n = starts[numbers], starts[numbers + 1] - starts[numbers]
        return np.arange(int(n.sum())) + np.repeat(low - np.cumsum(n) + n, n)


def _ranked(tokenizer, entries: list[bytes], pattern: str):
    """The same tokenizer on a faster engine, where its merges stand in the order of their ids (then a merge's rank is its id); else None.

    It takes the square of a word's length, so it is for short ones.
    """
    import tiktoken

    parts = json.loads(tokenizer.to_str())
    before, model = parts["pre_tokenizer"] or {}, parts["model"]
    if parts["normalizer"] or model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
        return None
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    ranks = {entry: k for k, entry in enumerate(entries) if entry}
    if made != list(range(256, 256 + len(made))) or len(ranks) != 256 + len(made):
        return None
    return tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class _Bytes:
    """The bytes of every id of a vocabulary."""

    def __init__(self, parts: list[bytes]):
        self.lengths = np.fromiter(map(len, parts), np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.lengths[ids])

    def give(self, ids: np.ndarray, ends: np.ndarray, text: np.ndarray) -> bool:
        """Whether the ids' bytes in a row are ``text``."""
        n = self.lengths[ids]
        if not len(ids) or not n.all() or ends[-1] != len(text):
            return False
        return bool((self.flat[np.arange(len(text)) + np.repeat(self.first[ids] - (ends - n), n)] == text).all())


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(first: str, second: str, writes: bool) -> Aligner:
    """A worker's aligner: a worker that runs several tasks goes on remembering. ``writes`` says whether groups are wanted as text."""
    if (first, second) not in _ALIGNERS:
        _ALIGNERS[first, second] = Aligner(first, second)
    tool = _ALIGNERS[first, second]
    if tool.writes != writes:
        tool.writes = writes
        tool.forget()
    return tool


# The hash -----------------------------------------------------------------------------------------------------------


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mix of the keys."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0) >> np.uint64(54)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], bytes]:
    """Levels of a bucket's distinct keys: their sizes in bits (whole 64s) and all bits in a row."""
    sizes, levels = [], []
    while len(keys):
        size = -(-int(len(keys) * ROOM + 1) // 64) * 64
        place = (mix(keys, len(sizes) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        sizes.append(size)
        keys = keys[~alone[place]]
    return sizes, b"".join(level.tobytes() for level in levels)


class Hash:
    """Levels of several buckets in a row; slots number the set bits over all of them."""

    def __init__(self, buckets: list[int], sizes: list[list[int]], bits: list[bytes]):
        deepest = max((len(s) for s in sizes), default=0)
        self.row = np.full(BUCKETS, -1, np.int64)
        self.row[buckets] = np.arange(len(buckets))
        self.sizes = np.zeros((len(buckets), deepest), np.uint64)
        self.bases = np.zeros((len(buckets), deepest), np.int64)
        at = 0
        for k, levels in enumerate(sizes):
            for level, size in enumerate(levels):
                self.sizes[k, level], self.bases[k, level] = size, at
                at += size
        self.words = np.frombuffer(b"".join(bits), "<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot, -1 for keys that the hash was not built for (others of these may get a wrong slot: verify)."""
        out = np.full(len(keys), -1, np.int64)
        row = self.row[bucket_of(keys)]
        left = np.flatnonzero(row >= 0)
        for level in range(self.sizes.shape[1]):
            size = self.sizes[row[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            place = self.bases[row[left], level] + (mix(keys[left], level + 1) % size).astype(np.int64)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            under = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[place >> 6] + under)[hit]
            left = left[~hit]
        return out


class Counts:
    """Counts of a block of buckets: the hash, and by slot the pair (to verify) and its number of documents."""

    def __init__(self, rows: list[tuple[int, list[int], bytes, bytes, bytes]], highest: np.ndarray):
        self.hash = Hash([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows])
        self.keys = np.frombuffer(b"".join(r[3] for r in rows), np.int64)
        self.counts = np.frombuffer(b"".join(r[4] for r in rows), np.int64)
        self.highest = highest

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts, and whether they are their first id's highest; both 0 for pairs of other blocks."""
        slot = self.hash.slots(keys)
        count = np.zeros(len(keys), np.int64)
        here = np.flatnonzero(slot >= 0)
        here = here[self.keys[slot[here]] == keys[here]]
        count[here] = self.counts[slot[here]]
        first = keys >> 32
        return count, (count > 0) & (count == self.highest[np.where(first < len(self.highest), first, 0)])


# First pass ---------------------------------------------------------------------------------------------------------


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(keys, return_inverse=True)
    return found, np.bincount(place, counts, len(found)).astype(np.int64)


def document_counts(texts: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct pairs of each task with their numbers of documents: bucket, keys, counts (64-bit numbers)."""
    gathered: list[tuple[np.ndarray, np.ndarray]] = []

    def give():
        keys, counts = _merged(*(np.concatenate(x) for x in zip(*gathered))) if gathered else (np.empty(0, np.int64),) * 2
        gathered.clear()
        bucket = bucket_of(keys)
        order = np.argsort(bucket, kind="stable")
        found, starts = np.unique(bucket[order], return_index=True)
        made: dict[str, list] = {"bucket": [], "keys": [], "counts": []}
        for b, part in zip(found, np.split(order, starts[1:])):
            for c, v in zip(made, (int(b), keys[part].tobytes(), counts[part].tobytes())):
                made[c].append(v)
        return made

    def rows(batch):
        tool = aligner(first, second, False)
        found: dict[int, list | None] = {}  # None where the bytes differ
        for i, _, numbers in tool.each_block(batch["_text"]):
            distinct = np.unique(np.fromiter(numbers, np.int64))
            if not np.frombuffer(tool.sizes, np.int64)[4 * distinct].all():
                found[i] = None
            elif found.setdefault(i, []) is not None:
                found[i].append(np.unique(np.frombuffer(tool.pairs, np.int64)[tool.links_of(distinct)]))
        whole = [p[0] if len(p) == 1 else np.unique(np.concatenate(p)) for p in found.values() if p]
        if whole:
            keys = np.concatenate(whole)
            gathered.append(_merged(keys, np.ones(len(keys))))
        if sum(len(k) for k, _ in gathered) > GATHERED:
            gathered[:] = [_merged(*(np.concatenate(x) for x in zip(*gathered)))]
            if len(gathered[0][0]) > GATHERED // 2:
                return give()
        return {"bucket": [], "keys": [], "counts": []}

    return map_batches(texts, rows, "bucket int, keys binary, counts binary", give)


def _by_bucket(df: DataFrame, *more: str) -> DataFrame:
    return df.repartition("bucket", *more).sortWithinPartitions("bucket", *more, *(["_part"] if "_part" in df.columns else []))


def hashes(counted: DataFrame) -> DataFrame:
    """Each bucket's hash and its pairs by slot: bucket, n, sizes, bits, keys."""
    names = ("bucket", "n", "sizes", "bits", "keys")
    now: dict = {}

    def close(made):
        if now:
            keys = np.unique(np.concatenate(now["keys"]))
            sizes, bits = build(keys)
            by_slot = np.empty_like(keys)
            by_slot[Hash([now["bucket"]], [sizes], [bits]).slots(keys)] = keys
            for c, v in zip(names, (now["bucket"], len(keys), sizes, bits, by_slot.tobytes())):
                made[c].append(v)

    def rows(batch):
        made: dict[str, list] = {c: [] for c in names}
        for bucket, keys in zip(batch["bucket"], batch["keys"]):
            if not now or now["bucket"] != bucket:
                close(made)
                now.update(bucket=bucket, keys=[], n=0)
            now["keys"].append(np.frombuffer(keys, np.int64))
            now["n"] += len(now["keys"][-1])
            if now["n"] > GATHERED:
                now["keys"] = [np.unique(np.concatenate(now["keys"]))]
                now["n"] = 0
        return made

    def flush():
        made: dict[str, list] = {c: [] for c in names}
        close(made)
        return made

    return map_batches(_by_bucket(counted.select("bucket", "keys")), rows, "bucket int, n bigint, sizes array<bigint>, bits binary, keys binary", flush)


def summed(counted: DataFrame, hashed: DataFrame) -> DataFrame:
    """Dense counts by slot, summed in two levels: bucket, counts."""
    none = F.lit(None).cast("binary")
    heads = hashed.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("_part"), "n", "sizes", "bits", none.alias("keys"), none.alias("counts"))
    body = counted.select("bucket", F.pmod(F.xxhash64("keys", "counts"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("_part"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("array<bigint>").alias("sizes"), none.alias("bits"), "keys", "counts")
    vectors = _dense(_by_bucket(heads.unionByName(body), "salt"), _sparse)
    return _dense(_by_bucket(vectors), _vector)


def _sparse(now, row):
    if row["_part"] == 0:
        now.update(hash=Hash([row["bucket"]], [row["sizes"]], [row["bits"]]), sum=np.zeros(row["n"], np.int64))
    else:
        now["sum"][now["hash"].slots(np.frombuffer(row["keys"], np.int64))] += np.frombuffer(row["counts"], np.int64)
        now["some"] = True


def _vector(now, row):
    part = np.frombuffer(row["counts"], np.int64)
    now.update(sum=part + now["sum"] if "sum" in now else part, some=True)


def _dense(ordered: DataFrame, add) -> DataFrame:
    """One dense vector for each run of rows of one bucket (and salt)."""
    now: dict = {}
    keys = [c for c in ("bucket", "salt") if c in ordered.columns]

    def close(made):
        if now.get("some"):
            made["bucket"].append(now["key"][0])
            made["counts"].append(now["sum"].tobytes())

    def rows(batch):
        made: dict[str, list] = {"bucket": [], "counts": []}
        for values in zip(*batch.values()):
            row = dict(zip(batch, values))
            key = [row[c] for c in keys]
            if not now or now["key"] != key:
                close(made)
                now.clear()
                now["key"] = key
            add(now, row)
        return made

    def flush():
        made: dict[str, list] = {"bucket": [], "counts": []}
        close(made)
        return made

    return map_batches(ordered, rows, "bucket int, counts binary", flush)


def pair_counts(docs: DataFrame, text_col: str = "text", first: str = FIRST, second: str = SECOND) -> DataFrame:
    """The written table of counts, a row for each bucket: bucket, n, sizes, bits, keys, counts (the last two by slot)."""
    counted = staged(document_counts(docs.select(F.col(text_col).alias("_text")), first, second), "pairs")
    hashed = staged(hashes(counted), "hashes")
    return staged(hashed.join(summed(counted, hashed), "bucket"), "counts")


def highest_counts(counts: DataFrame) -> np.ndarray:
    """The highest count of each first id (one number for each id of a vocabulary)."""

    def rows(batch):
        made: dict[str, list] = {"a": [], "most": []}
        for keys, n in zip(batch["keys"], batch["counts"]):
            ids, place = np.unique(np.frombuffer(keys, np.int64) >> 32, return_inverse=True)
            most = np.zeros(len(ids), np.int64)
            np.maximum.at(most, place, np.frombuffer(n, np.int64))
            made["a"] += ids.tolist()
            made["most"] += most.tolist()
        return made

    found = map_batches(counts.select("keys", "counts"), rows, "a bigint, most bigint").groupBy("a").agg(F.max("most").alias("most")).collect()
    out = np.zeros(max((r["a"] for r in found), default=0) + 1, np.int64)
    for r in found:
        out[r["a"]] = r["most"]
    return out


# Second pass --------------------------------------------------------------------------------------------------------


_SUMS = ("n_a", "n_b", "n_groups", "n_links")


def look_up(docs: DataFrame, counts: Counts, key: str, text_col: str, first: str, second: str) -> DataFrame:
    """Each document aligned again, with the counts of its links that stand in ``counts``."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    names = (key, *_SUMS, "n_best", "count_sum", "groups_sha256")
    chunk: dict = {"born": None}

    def values(tool: Aligner) -> tuple[np.ndarray, np.ndarray]:
        """Links with the highest count, and the sum of counts, of every chunk that the worker remembers."""
        if chunk["born"] != tool.born:
            chunk.update(born=tool.born, best=np.empty(0, np.int64), sum=np.empty(0, np.int64))
        done, n = len(chunk["best"]), len(tool.written)
        if done < n:
            starts = np.frombuffer(tool.starts, np.int64)[done : n + 1]
            low = int(starts[0])
            pairs, times = np.frombuffer(tool.pairs, np.int64)[low:], np.frombuffer(tool.times, np.int64)[low:]
            found, best = shared.value.look_up(pairs)
            for name, each in (("best", times * best), ("sum", times * found)):
                to = np.concatenate([[0], np.cumsum(each)])
                chunk[name] = np.concatenate([chunk[name], to[starts[1:] - low] - to[starts[:-1] - low]])
        return chunk["best"], chunk["sum"]

    def rows(batch):
        tool = aligner(first, second, True)
        made: dict[str, list] = {c: [] for c in names}
        sums, digests = np.zeros((len(batch["_text"]), 6), np.int64), [None] * len(batch["_text"])  # no digest: no tokens
        for i, begins, numbers in tool.each_block(batch["_text"]):
            if begins:
                digests[i] = hashlib.sha256()
            elif digests[i] is None:
                continue
            at = np.fromiter(numbers, np.int64)
            sizes = np.frombuffer(tool.sizes, np.int64).reshape(-1, 4)[at]
            if not sizes[:, 0].all():  # a chunk whose bytes differ
                digests[i] = None
                continue
            digests[i].update((("" if begins else ";") + "".join([tool.written[n] for n in numbers])[:-1]).encode())
            best, total = values(tool)
            sums[i, :4] += sizes.sum(axis=0)
            sums[i, 4:] += (best[at].sum(), total[at].sum())
        for i, name in enumerate(batch[key]):
            for c, v in zip(names, (name, *(sums[i].tolist() if digests[i] else [0] * 6), digests[i].hexdigest() if digests[i] else "")):
                made[c].append(v)
        return made

    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, " + ", ".join(f"{c} bigint" for c in (*_SUMS, "n_best", "count_sum")) + ", groups_sha256 string"
    return map_batches(docs.select(key, F.col(text_col).alias("_text")), rows, schema)


def alignments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: str = FIRST, second: str = SECOND, block: int = BLOCK) -> DataFrame:
    """How each document's tokens align, and how often its linked pairs are linked in the whole corpus."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_whole"))
    table = pair_counts(rows, "_whole", first, second)
    highest = highest_counts(table)
    blocks: list[list[int]] = [[]]
    held = 0
    for r in table.select("bucket", "n").orderBy("bucket").collect():  # BUCKETS rows at most
        if blocks[-1] and held + r["n"] > block:
            blocks.append([])
            held = 0
        blocks[-1].append(r["bucket"])
        held += r["n"]

    def counts(buckets: list[int]) -> Counts:
        here = table.where(F.col("bucket").between(buckets[0], buckets[-1])) if buckets else table
        return Counts([(r["bucket"], r["sizes"], bytes(r["bits"]), bytes(r["keys"]), bytes(r["counts"])) for r in here.orderBy("bucket").collect()], highest)

    if len(blocks) == 1:
        return look_up(rows, counts(blocks[0]), "_id", "_whole", first, second).withColumnRenamed("_id", id_col)
    numbered = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    sums = None
    for buckets in blocks:
        part = staged(look_up(numbered, counts(buckets), "_row", "_whole", first, second), "links")
        sums = part if sums is None else sums.unionByName(part)
    once = [F.max(c).alias(c) for c in (*_SUMS, "groups_sha256")]
    total = sums.groupBy("_row").agg(*once, F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return numbered.select("_row", "_id").join(total, "_row").select(F.col("_id").alias(id_col), *_SUMS, "n_best", "count_sum", "groups_sha256")
