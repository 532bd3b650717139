"""Best-fit packing of tokenised documents into sequences of a fixed size.

Documents become token ids followed by id 0. Only a document longer than a sequence is cut, into
pieces of exactly the sequence size and one shorter last piece. Full pieces fill sequences of their
own. The others are packed by the sum-of-squares rule: a piece goes where, afterwards, the squared
counts of open bins per residual gap have the smallest sum. Pieces are dealt at random into groups
of bounded size; each group is packed by one task, longest first, and what its rule leaves in bins
that are not full is packed once more, best fit, where that saves bins.

Defined cases: a NULL or empty text is one token (id 0); rows with equal ids or equal texts are packed
as often as they occur; a NULL id is kept; an empty table gives an empty result; other columns of
the input are ignored.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, staged

SIZE = 2048
TOKENIZER = "word_bpe_49k.json"
#: Pieces in one packing group; a group leaves at most a few bins that are not full.
GROUP_PIECES = 25_000
#: Words and parts of words whose ids a Python worker remembers.
MEMO = 400_000
#: How the vocabulary's own rules divide a normalised text (fixed value of the tokenizer file).
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordCoder:
    """Token ids of texts by remembered words.

    The vocabulary never joins across white space, so a text's ids are its words' ids in order. A
    word of Latin letters is divided by the vocabulary's own pattern and its parts are looked up;
    any other word goes through the tokenizer as it is.
    """

    def __init__(self, tokenizer: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        path = tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer)
        self.whole = Tokenizer.from_file(path)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_words = os.path.basename(path) == TOKENIZER
        self.parts = regex.compile(PARTS)
        self.odd_space = regex.compile(r"[\x1c-\x1f]")
        self.memo, self.words, self.pieces = memo, {}, {}

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        found = self.pieces.get(part)
        if found is None:
            mapped = part if part.isascii() else self.bytes.pre_tokenize_str(part)[0][0]
            found = np.asarray([t.id for t in self.whole.model.tokenize(mapped)], "<u4").tobytes()
            if len(self.pieces) >= self.memo:
                self.pieces.clear()
            self.pieces[part] = found
        return found

    def _word(self, word: str) -> bytes:
        if max(word) >= "ɐ" or "<|" in word or not word.isprintable():
            return self._plain(word)
        if not word.isascii():
            word = unicodedata.normalize("NFC", word)
        return b"".join([self._part(p) for p in self.parts.findall(word.lower())])

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if not self.by_words or self.odd_space.search(text):
            return self._plain(text)
        words = text.split()
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            pass
        fresh = [w for w in set(words) if w not in known]
        if len(known) + len(fresh) > self.memo:
            known.clear()
            fresh = set(words)
        for w in fresh:
            known[w] = self._word(w)
        return b"".join([known[w] for w in words])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, size: int = SIZE) -> DataFrame:
    """Token ids of whole texts in pieces of at most ``size``: id, piece, start, length, ids (little-endian 32-bit)."""
    coder: list[WordCoder] = []

    def rows(batch):
        if not coder:
            coder.append(WordCoder(tokenizer))
        out: dict[str, list] = {c: [] for c in ("_id", "piece", "start", "length", "ids")}
        for key, text in zip(batch["_id"], batch["_text"]):
            ids = coder[0].ids(text or "") + b"\0\0\0\0"
            n = len(ids) // 4
            for piece, start in enumerate(range(0, n, size)):
                part = ids[4 * start : 4 * (start + size)]
                for c, v in zip(out, (key, piece, start, len(part) // 4, part)):
                    out[c].append(v)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    made = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), rows, f"_id {kind}, piece int, start bigint, length bigint, ids binary")
    return made.withColumnRenamed("_id", id_col)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece (all shorter than ``size``), and the number of bins."""
    n = len(lengths)
    bins, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    open_at = np.zeros(size + 1, np.int64)  # open bins by residual gap; gap 0 never counts
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        there = open_at[s:size]
        # Placing into gap g takes one bin from g and adds one to g - s.
        change = np.where(there > 0, 2 * (open_at[: size - s] - there) + 2, np.iinfo(np.int64).max)
        change[0] -= there[0] > 0  # an exact fit adds none
        j = int(change.argmin())
        if there[j] > 0 and change[j] <= 2 * open_at[size - s] + 1:
            b = stacks[s + j].pop()
            open_at[s + j] -= 1
            bins[i], offset[i] = b, size - s - j
        else:
            b, j, used = used, size - s, used + 1
            bins[i], offset[i] = b, 0
            if not j:
                continue
        if j:
            stacks[j].append(b)
            open_at[j] += 1
    left = sorted((b, g) for g, bs in enumerate(stacks) for b in bs)
    if not left:
        return bins, offset, used
    # What stands in bins that are not full, packed again: by best fit, longest first.
    loose = np.flatnonzero(np.isin(bins, [b for b, _ in left]))
    again = [[] for _ in range(size + 1)]
    filled = np.zeros(size + 1, np.int64)
    fresh = 0
    to, at = np.empty(len(loose), np.int64), np.empty(len(loose), np.int64)
    for k in np.argsort(-lengths[loose], kind="stable"):
        s = int(lengths[loose[k]])
        fits = filled[s:].argmax()
        if filled[s + fits]:
            g = int(s + fits)
            b = again[g].pop()
            filled[g] = bool(again[g])
            to[k], at[k] = b, size - g
        else:
            b, g, fresh = fresh, size, fresh + 1
            to[k], at[k] = b, 0
        if g > s:
            again[g - s].append(b)
            filled[g - s] = 1
    if fresh < len(left):
        names = np.array([b for b, _ in left])
        bins[loose], offset[loose] = names[to], at
        used -= len(left) - fresh
    return bins, offset, used


def pack(parts: DataFrame, size: int = SIZE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``parts`` (with a column ``length``, at most ``size``; narrow) and its place: sequence_id, offset."""
    columns = parts.columns
    kept = staged(parts, "pieces")  # read three times below
    loose = kept.where(F.col("length") < size)
    groups = max(1, -(-loose.count() // group_pieces))
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))  # stable: the files do not change
    dealt = loose.withColumn("_group", spread)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        bins, offset, _ = sum_of_squares(group["length"].to_numpy(np.int64), size)
        return group.drop(columns="_group").assign(sequence_id=int(group["_group"].iloc[0]) * (1 << 40) + bins, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", sequence_id bigint, offset bigint"
    packed = dealt.groupBy("_group").applyInPandas(one, schema)
    full = kept.where(F.col("length") == size).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(full)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian 32-bit), pieces in them.

    A sequence has at most ``size`` pieces, so a group is bounded.
    """
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(inside, F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"), F.count(F.lit(1)).alias("pieces"))
