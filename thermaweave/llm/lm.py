"""Language-model scores by logistic context mixing, beside a smoothed unigram score.

A token (lower-cased word and a space, or the end sign of a text) is predicted bit by bit. Several hashed contexts
each keep counts of the bits seen after them: the token's beginning with and without the text's class, its
last one to four bytes. Their predictions are mixed in the logistic domain with weights from a set that a gate selects (bit
place and how well the longest context is known), and an adaptive map refines the mix. The class, out of a few that all
training texts are grouped into, follows at each token from the tokens before it, so the bits of a text have one
probability and their logarithms add up to its score.

The words that tell classes apart are those of most training texts. Each training text is kept as its counts of them, and a round of
grouping is one pass over these, in which tasks add up whole numbers: classes depend neither on the order of texts nor on partitions.

Counts come from all training texts: tokens are counted per class with a flush at a bounded size, summed by a
shuffle, and turned into context tables of fixed size, again summed by a shuffle. Weights and map are learnt online over the whole vocabulary, each
task over its part with every token's own last occurrence left out, and averaged. The frozen model is then evaluated once per distinct
training token and class, and once more for tokens never trained on; tokens at hand together share the work on their common beginnings. Exact counts of frequent tokens (at most ``HEAD``) go to the tasks; the others meet the documents in a join on the token, where no
key is hot.

Defined cases: a NULL or empty text is its end alone; a NULL id counts as training; repeated rows are each counted and
scored; without training tokens every base term is log10(1) and every bit is even; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_arrow, map_batches, most_frequent, staged

HELD = 1
#: Frequent tokens whose exact counts every task gets.
HEAD = 100_000
#: Blocks of tokens that the mixing is learnt on.
BLOCKS = 64
#: Words that tell classes apart; rounds of grouping at most, and the gain in likelihood that ends them.
TELLING, CLASSES, ROUNDS, GAIN = 2000, 8, 30, 1e-5
#: Logarithms and shares are counted in whole parts of one.
PARTS = 1 << 20
#: Distinct tokens that a task counts before it passes its counts on.
COUNTED = 300_000
#: Slots of each context table, by power of two; tokens of fewer occurrences do not enter the first two.
SLOTS = (20, 20, 18, 18, 18, 16)
RARE = 8
CHUNK = 1 << 13
#: Tokens that the model is counted or evaluated on at once.
MOST = 1 << 13
BINS = 33
END = b"\n"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def plain(column: pa.Array) -> np.ndarray:
    """Numbers as they are, tokens as an array of bytes objects."""
    return column.to_numpy(zero_copy_only=False)


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The tokens of several texts, each followed by its end: number of each, where each text begins, and the distinct tokens."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, bounds = parts.flatten(), parts.offsets.to_numpy()
    full = pc.binary_length(flat).to_numpy() > 0  # space at a text's edge leaves an empty part
    bounds = np.r_[0, np.cumsum(full)][bounds - bounds[0]]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    code = np.full(len(coded) + len(texts), len(coded.dictionary))
    code[np.arange(len(coded)) + text] = coded.indices.to_numpy()
    return code, bounds + np.arange(len(bounds)), pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD
    return h ^ (h >> np.uint64(29))


def flat_bytes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in one array, where each token starts, and each byte's token."""
    coded = [w + b" " if w != END else w for w in words]
    size = np.array([len(c) for c in coded])
    start = np.r_[0, np.cumsum(size)[:-1]]
    return np.frombuffer(b"".join(coded), np.uint8), start, np.repeat(np.arange(len(words)), size)


def contexts(x: np.ndarray, start: np.ndarray, token: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """Hash of each context at every byte."""
    place = np.arange(len(x)) - start[token]
    b = x.astype(np.uint64) + np.uint64(1)
    power = _mix(place.astype(np.uint64) + np.uint64(77)) | np.uint64(1)
    total = np.cumsum(b * power, dtype=np.uint64)
    before = np.r_[np.uint64(0), total[:-1]]
    prefix = before - before[start[token]]
    back = []
    for k in range(1, 5):
        y = np.zeros(len(x), np.uint64)
        y[k:] = b[:-k]
        y[place < k] = 0
        back.append(y)
    one, two, three, four = back
    g = group[token].astype(np.uint64) + np.uint64(1)
    two_ = one * np.uint64(257) + two
    three_ = two_ * np.uint64(257) + three
    return [
        _mix(prefix + g * np.uint64(0xD1B54A32D192ED03)), _mix(prefix), _mix(three_ * np.uint64(257) + four + np.uint64(1 << 60)),
        _mix(three_ + np.uint64(2 << 60)), _mix(two_ * np.uint64(31) + g + np.uint64(3 << 60)), _mix(one * np.uint64(9) + np.minimum(place, 8).astype(np.uint64) + np.uint64(4 << 60)),
    ]


def branches(x: np.ndarray, start: np.ndarray, token: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of tokens sorted by class and bytes: the bytes that do not continue the token before, and for every byte which of those stands for it.

    All contexts of a byte follow from its class and the token up to it, so what is known of the one holds for the other.
    """
    size = np.diff(np.r_[start, len(x)])
    place = np.arange(len(x)) - start[token]
    prev = np.maximum(token - 1, 0)
    same = (token > 0) & (place < size[prev]) & (group[token] == group[prev])
    same &= x[np.where(same, start[prev] + place, 0)] == x
    new = place >= np.minimum.reduceat(np.where(same, len(x), place), start)[token]
    # Among the bytes of one place, a byte that is not new follows the same place of the token before.
    by = np.argsort(place.astype(np.uint16) if size.max() < 1 << 16 else place, kind="stable")
    last = np.maximum.accumulate(np.where(new[by], np.arange(len(x)), 0))
    of = np.empty(len(x), np.int64)
    of[by] = (np.cumsum(new) - 1)[by[last]]
    return np.flatnonzero(new), of


def by_class(words: list[bytes], group: np.ndarray) -> np.ndarray:
    """Order by class, then bytes."""
    order = np.array(sorted(range(len(words)), key=words.__getitem__))
    return order[np.argsort(group[order], kind="stable")]


def left_out(tables: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each slot's prediction as it is (first two contexts only), without one zero and without one one; and the first context's gate likewise."""
    out, gate = [], np.zeros(0, np.int8)
    for c, t in enumerate(tables):
        n = [(t[:, 0], t[:, 1])] * (c < 2) + [(np.maximum(t[:, 0] - 1, 0), t[:, 1]), (t[:, 0], np.maximum(t[:, 1] - 1, 0))]
        out.append(np.stack([np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4))) for n0, n1 in n], axis=1).ravel())
        if not c:
            gate = np.stack([np.searchsorted([1, 16, 256], n0 + n1, side="right").astype(np.int8) for n0, n1 in n], axis=1).ravel()
    return out, gate


def bits(x: np.ndarray, hashes: list[np.ndarray]):
    """For each of the eight bits: its place, its value at every byte, and the slots of all contexts."""
    for k in range(8):
        node = (x >> np.uint8(8 - k) if k else np.zeros_like(x)).astype(np.uint64) | np.uint64(1 << k)
        bit = (x >> np.uint8(7 - k)) & np.uint8(1)
        node *= np.uint64(0xA24BAED4963EE407)
        out = []
        for h, s in zip(hashes, SLOTS):
            slot = h + node
            slot *= _ODD
            slot >>= np.uint64(64 - s)
            out.append(slot.view(np.int64))
        yield k, bit, out


class Mixer:
    """Context tables, gated weights, refining map."""

    def __init__(self, tables: list[np.ndarray] | None, left: tuple[list[np.ndarray], np.ndarray] | None = None):
        self.tables = tables  # (slots, 2) counts of zeros and ones
        self._left = left  # what learning needs of them
        self.gates = 8 * 4
        self.weights = np.full((self.gates, len(SLOTS)), 0.3)
        self.hits, self.mass = np.zeros((self.gates, BINS)), np.zeros((self.gates, BINS))
        self._ready = None

    def freeze(self) -> None:
        """Predictions and the gate as tables of one number a slot."""
        stretch = [np.log((t[:, 1] + 0.4) / (t[:, 0] + 0.4)).astype(np.float32) for t in self.tables]
        known = np.searchsorted([1, 16, 256], self.tables[0].sum(axis=1), side="right").astype(np.int8)
        centre = 1 / (1 + np.exp(-np.linspace(-8, 8, BINS)))
        refined = (self.hits + 20 * centre) / (self.mass + 20)
        self._ready = stretch, known, np.log(refined / (1 - refined)).astype(np.float32)

    def __getstate__(self):
        if self._ready is None:
            return self.__dict__
        return self.__dict__ | {"tables": None, "_left": None}

    def log10(self, words: list[bytes], group: np.ndarray, block: int = 1 << 15, most: int = MOST) -> np.ndarray:
        """log10 of the probability of each token in its class; ``most`` tokens at a time, so that little is held."""
        parts = [self._log10(words[at : at + most], group[at : at + most], block) for at in range(0, len(words), most)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _log10(self, words: list[bytes], group: np.ndarray, block: int) -> np.ndarray:
        stretch, known, refined = self._ready
        weights = [np.ascontiguousarray(w, np.float32) for w in self.weights.T]
        flat = refined.ravel()
        order = by_class(words, group)
        words, group = [words[i] for i in order.tolist()], group[order]
        x, start, token = flat_bytes(words)
        fresh, of = branches(x, start, token, group)
        hashes = [h[fresh] for h in contexts(x, start, token, group)]
        x = x[fresh]
        odds = np.ones(len(x))  # of all eight bits: at most (1 + exp(11)) ** 8
        for at in range(0, len(x), block):
            part = slice(at, at + block)
            for k, bit, slots in bits(x[part], [h[part] for h in hashes]):
                gate = known.take(slots[0], mode="clip") + np.int64(4 * k)
                z = np.zeros(len(bit), np.float32)
                for w, t, s in zip(weights, stretch, slots):
                    z += w.take(gate, mode="clip") * t.take(s, mode="clip")
                z = np.clip(z, -11, 11)
                y = np.clip(z, -8, 8) * np.float32((BINS - 1) / 16) + np.float32((BINS - 1) / 2)
                low = np.minimum(y.astype(np.int64), BINS - 2)
                share = y - low.astype(np.float32)
                low += gate * BINS
                before = flat.take(low)
                low += 1
                z = (z + before + share * (flat.take(low) - before)) * np.float32(0.5)
                odds[part] *= np.add(np.exp(np.where(bit, -z, z)), 1, dtype=np.float64)
        out = np.empty(len(words))
        out[order] = np.add.reduceat(-np.log10(odds)[of], start)
        return out

    def learn(self, words: list[bytes], group: np.ndarray, count: np.ndarray) -> None:
        """One online step over some tokens and their counts, each without its own last occurrence."""
        if self._left is None:
            self._left = left_out(self.tables)
        stretch, known = self._left
        own = (count >= RARE).astype(np.int64)  # tokens of few occurrences did not enter the first two contexts
        order = by_class(words, 2 * group + own)
        words, group, count, own = [words[i] for i in order.tolist()], group[order], count[order], own[order]
        x, start, token = flat_bytes(words)
        fresh, of = branches(x, start, token, 2 * group + own)
        hashes = [h[fresh] for h in contexts(x, start, token, group)]
        x, own = x[fresh], own[token[fresh]]
        often = np.bincount(of, count[token]).astype(np.float32)
        row = np.arange(len(x))
        st = np.empty((len(SLOTS), len(x)), np.float32)
        for k, bit, slots in bits(x, hashes):
            b, one = bit.astype(np.float32), bit.astype(np.int64)
            seen = own * (one + 1)
            for c, s in enumerate(slots):
                s = s * 3 + seen if c < 2 else s * 2 + one
                stretch[c].take(s, out=st[c], mode="clip")
                if not c:
                    gate = known.take(s, mode="clip").astype(np.int64)
            at = gate * len(x) + row
            gates = slice(4 * k, 4 * k + 4)
            z = np.clip((self.weights[gates].astype(np.float32) @ st).ravel().take(at), -11, 11)
            p = 1 / (1 + np.exp(-z))
            y = np.clip(z, -8, 8) * ((BINS - 1) / 16) + (BINS - 1) / 2
            near = gate * BINS + np.rint(y).astype(np.int64)
            mass = np.bincount(2 * near + one, often, 8 * BINS).reshape(4, BINS, 2)
            self.hits[gates] += mass[:, :, 1]
            self.mass[gates] += mass.sum(axis=2)
            wrong, sure = np.zeros((2, 4, len(x)), np.float32)
            wrong.ravel()[at], sure.ravel()[at] = often * (b - p), often * np.maximum(p * (1 - p), np.float32(1e-4))
            step = (wrong @ st.T).astype(np.float64) / ((sure @ (st * st).T).astype(np.float64) + 1.0)
            self.weights[gates] += 0.5 / len(SLOTS) * np.clip(step, -2, 2)


def grouped(theta: np.ndarray, prior: np.ndarray, word: np.ndarray, n: np.ndarray, bounds: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
    """Some texts dealt to classes by their words: each class's counts of words, its texts, and the likelihood, all in whole ``PARTS``.

    Products are of whole numbers, and so exact in any order.
    """
    sums, share, likely = np.zeros(theta.shape), np.zeros(len(theta), np.int64), 0
    columns, held = np.ascontiguousarray(theta.T, np.float64), np.zeros((block, theta.shape[1]))
    for low in range(0, len(bounds) - 1, block):
        ends = bounds[low : low + block + 1]
        x, part = held[: len(ends) - 1], slice(ends[0], ends[-1])
        at = np.repeat(np.arange(len(x)) * theta.shape[1], np.diff(ends)) + word[part]
        held.ravel()[at] = n[part]
        weight = np.minimum(50 / np.maximum(x.sum(axis=1, keepdims=True), 1), 1)  # long texts do not count more than about 50 words
        post = x @ columns * (weight / PARTS) + prior
        most = post.max(axis=1, keepdims=True)
        post = np.exp(post - most)
        each = post.sum(axis=1, keepdims=True)
        post /= each
        sums += np.rint(post * (weight * PARTS)).T @ x
        share += np.rint(post * PARTS).astype(np.int64).sum(axis=0)
        likely += int(np.rint((np.log(each) + most) * PARTS).astype(np.int64).sum())
        held.ravel()[at] = 0
    return sums.astype(np.int64), share, likely


class Classes:
    """Mixture of word distributions over a few telling words; the class of each token from those before it."""

    def __init__(self, texts: list[list[bytes]], classes: int = CLASSES, telling: int = TELLING, rounds: int = ROUNDS):
        seen = Counter(w for t in texts for w in set(t))
        self.tell(sorted(seen, key=lambda w: (-seen[w], w))[:telling])
        rows = [sorted(Counter(self.place[w] for w in t if w in self.place).items()) for t in texts]
        word, n = np.array([x for r in rows for x in r], np.int64).reshape(-1, 2).T
        bounds = np.cumsum([0, *map(len, rows)])
        self.learn(len(texts), lambda theta, prior: grouped(theta, prior, word, n, bounds), classes, rounds)

    def tell(self, chosen: list[bytes]) -> None:
        self.place = {w: i for i, w in enumerate(chosen)}
        self.score = np.zeros((1, len(chosen)), np.int64)

    def learn(self, texts: int, step: Callable, classes: int = CLASSES, rounds: int = ROUNDS) -> None:
        """Rounds of ``step`` (see ``grouped``), which sees all texts, until the likelihood hardly gains."""
        if texts < 4 * classes or not self.place:
            return
        # What classes begin with is drawn by word, so it is as far from even for many texts as for few.
        theta, prior, before = np.random.default_rng(3).standard_normal((classes, len(self.place))), np.zeros(classes), -np.inf
        for k in range(rounds):
            sums, share, likely = step(np.rint(theta * PARTS).astype(np.int64), prior)
            theta = sums / PARTS + 0.1
            theta = np.log(theta / theta.sum(axis=1, keepdims=True))
            prior = np.log(share / share.sum() + 1e-6)
            if k and likely - before < GAIN * abs(likely):  # the first one is of no distributions
                break
            before = likely if k else -np.inf
        self.score = np.rint((theta - theta.mean(axis=0)) * PARTS).astype(np.int64)  # whole numbers: sums do not depend on what is summed before

    def groups(self, at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Class at each token of several texts, from its place among the telling words (-1 for others) and where texts begin; class 0 stands
        for "no telling word so far"."""
        told = np.flatnonzero(at >= 0)
        if len(self.score) == 1 or not len(told):
            return np.zeros(len(at), np.int64)
        first = np.searchsorted(told, bounds[:-1])
        total = np.zeros((len(told) + 1, len(self.score)), np.int64)
        np.cumsum(self.score.T.take(at[told], axis=0), axis=0, out=total[1:])
        total[1:] -= np.repeat(total[first], np.diff(np.r_[first, len(told)]), axis=0)
        best = total[1:].argmax(axis=1) + 1
        before = np.cumsum(at >= 0) - (at >= 0)  # a class holds from the next token on
        return np.where(before > np.repeat(first, np.diff(bounds)), best[np.maximum(before, 1) - 1], 0)

    def runs(self, ws: list[bytes]) -> list[tuple[int, int, int]]:
        """(class, from, to) over a text's tokens."""
        at = np.fromiter(map(self.place.get, [*ws, END], repeat(-1)), np.int64, len(ws) + 1)
        group = self.groups(at, np.array([0, len(at)]))
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(at)]
        return [(int(group[a]), a, min(b, len(ws))) for a, b in zip(edges, edges[1:])]

    def keyed(self, ws: list[bytes]) -> list[tuple[int, list[bytes]]]:
        """A text's tokens and its end, in stretches of one class."""
        out = [(g, ws[a:b]) for g, a, b in self.runs(ws)]
        out[-1] = (out[-1][0], [*out[-1][1], END])
        return out


def class_counts(docs: DataFrame, classes: Classes | None) -> DataFrame:
    """Occurrences of each token in each class: group, token, n. Without classes, the texts that hold each token (group 0, no ends)."""
    held: list[pa.Table] = []

    def add_up():
        return pa.concat_tables(held).group_by(["group", "token"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["group", "token", "n"])

    def take():
        out = add_up().to_batches(1 << 14) if held else []
        held.clear()
        return out

    def rows(batch):
        code, bounds, words = token_stream(batch.column("_text"))
        if classes is None:
            n = np.bincount(np.unique(np.repeat(np.arange(batch.num_rows), np.diff(bounds)) * len(words) + code) % len(words), minlength=len(words))
            n[-1] = 0
        else:
            telling = np.fromiter(map(classes.place.get, plain(words), repeat(-1)), np.int64, len(words))
            n = np.bincount(classes.groups(telling[code], bounds) * len(words) + code)
        seen = np.flatnonzero(n)
        held.append(pa.table({"group": pa.array(seen // len(words), pa.int32()), "token": words.take(pa.array(seen % len(words))), "n": pa.array(n[seen], pa.int64())}))
        if sum(t.num_rows for t in held) > 1.5 * COUNTED:
            held[:] = [add_up()]
            if held[0].num_rows > COUNTED:
                return take()
        return []

    made = map_arrow(docs.select("_text"), rows, "group int, token binary, n bigint", take)
    return made.groupBy("group", "token").agg(F.sum("n").alias("n"))


def learn_classes(docs: DataFrame) -> Classes:
    """The classes of all texts."""
    classes = Classes([])
    classes.tell([r.token for r in most_frequent(staged(class_counts(docs, None), "text-counts"), "token", "n", TELLING).collect()])
    if not classes.place:
        return classes
    place = docs.sparkSession.sparkContext.broadcast(classes.place)

    def told(batch):
        code, bounds, words = token_stream(batch.column("_text"))
        at = np.fromiter(map(place.value.get, plain(words), repeat(-1)), np.int64, len(words))[code]
        there = at >= 0
        text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))[there]
        each, n = np.unique(text * len(place.value) + at[there], return_counts=True)
        text, word = np.divmod(each, len(place.value))
        ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        columns = [pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends * 4), pa.py_buffer(x.astype(np.int32).tobytes())]) for x in (word, n)]
        return [pa.record_batch(columns, ["word", "n"])]

    texts = staged(map_arrow(docs.select("_text"), told, "word binary, n binary"), "told")  # arrays as bytes: every round reads them

    def step(theta: np.ndarray, prior: np.ndarray):
        sent = docs.sparkSession.sparkContext.broadcast((theta, prior))
        held: list = []

        def rows(batch):
            word, n = (batch.column(c).to_pylist() for c in ("word", "n"))
            bounds = np.cumsum([0, *map(len, word)]) // 4
            made = grouped(*sent.value, *(np.frombuffer(b"".join(x), np.int32).astype(np.int64) for x in (word, n)), bounds)
            held[:] = [x + y for x, y in zip(held, made)] if held else made
            return []

        def take():
            if held:
                sums, share, likely = held
                yield pa.record_batch({"class": list(range(len(sums))), "sums": [x.tobytes() for x in sums], "share": share, "likely": [likely] * len(sums)})
            held.clear()

        def add(part: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(b, np.int64) for b in part["sums"])
            return pd.DataFrame({"class": part["class"].iloc[:1], "sums": [total.tobytes()], "share": [part["share"].sum()], "likely": [part["likely"].sum()]})

        kind = "class int, sums binary, share bigint, likely bigint"
        found = sorted(map_arrow(texts, rows, kind, take).groupBy("class").applyInPandas(add, kind).collect(), key=lambda r: r["class"])  # one row a class
        sent.destroy()
        return np.stack([np.frombuffer(r.sums, np.int64) for r in found]), np.array([r.share for r in found]), found[0].likely

    classes.learn(texts.count(), step)
    return classes


def context_tables(counts: DataFrame) -> list[np.ndarray]:
    """Bit counts of all contexts, from all tokens: tasks add up their part, then slots are added up over tasks."""
    held: list[np.ndarray] = []

    def take():
        for c in range(len(held)):  # a table at a time, so that few bytes are held twice
            t, held[c] = held[c], None
            size = min(CHUNK, len(t))
            some = np.flatnonzero(t.reshape(-1, 2 * size).any(axis=1)).tolist()
            if some:
                yield pa.record_batch({"context": [c] * len(some), "chunk": some, "counts": [t[k * size : (k + 1) * size].tobytes() for k in some]})
        held.clear()

    def rows(batch):
        if not held:
            held.extend(np.zeros((1 << s, 2), np.float32) for s in SLOTS)
        for at in range(0, batch.num_rows, MOST):
            words, group, n = (plain(batch.column(c).slice(at, MOST)) for c in ("token", "group", "n"))
            order = by_class(words, group)
            words, group, n = words[order], group[order], n[order].astype(np.float64)
            x, start, token = flat_bytes(words)
            fresh, of = branches(x, start, token, group)
            every, often = (np.bincount(of, w[token], len(fresh)).astype(np.float32) for w in (n, n * (n >= RARE)))
            some = np.flatnonzero(often)
            hashes = [h[fresh] for h in contexts(x, start, token, group)]
            for _, bit, slots in bits(x[fresh], hashes):
                for c, s in enumerate(slots):
                    s = 2 * s + bit
                    if c < 2:
                        np.add.at(held[c].reshape(-1), s[some], often[some])
                    else:
                        np.add.at(held[c].reshape(-1), s, every)
        return []

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in group["counts"])
        return pd.DataFrame({"context": group["context"].iloc[:1], "chunk": group["chunk"].iloc[:1], "counts": [total.astype(np.float32).tobytes()]})

    kind = "context int, chunk int, counts binary"
    parts = map_arrow(counts.select("group", "token", "n"), rows, kind, take).groupBy("context", "chunk").applyInPandas(add, kind)
    out = [np.zeros((1 << s, 2), np.float32) for s in SLOTS]
    for r in parts.toLocalIterator():  # of fixed size in all
        part = np.frombuffer(r.counts, np.float32).reshape(-1, 2)
        out[r.context][r.chunk * len(part) : (r.chunk + 1) * len(part)] = part
    return out


def mix(counts: DataFrame, tables: list[np.ndarray], batch_tokens: int = 2048) -> Mixer:
    """Weights and map, online over all tokens in ``BLOCKS`` blocks, averaged by their mass.

    Tokens are dealt to blocks by hash and learnt in the order of the hash, in steps of a fixed number of tokens; block by block their
    results are added up in order. So the mixer depends on the table alone, not on how it lies on a cluster.
    """
    sent = counts.sparkSession.sparkContext.broadcast(left_out(tables))
    now: dict = {}

    def step(n: int):
        words, group, count = (x[:n] for x in now["rows"])
        now["mixer"].learn(words, group.astype(np.int64), count.astype(np.float64))
        now["rows"] = [x[n:] for x in now["rows"]]

    def close():
        if not now:
            return []
        if len(now["rows"][0]):
            step(batch_tokens)
        m = now["mixer"]
        each = m.mass.sum(axis=1, keepdims=True)
        made = {"block": [now["block"]]} | {c: [x.ravel()] for c, x in (("weights", m.weights * each), ("hits", m.hits), ("mass", m.mass))}
        now.clear()
        return [pa.record_batch(made)]

    def rows(batch):
        made = []
        block = plain(batch.column("block"))
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        columns = [plain(batch.column(c)) for c in ("token", "group", "n")]
        for low, high in zip(cuts, cuts[1:]):
            if now and now["block"] != block[low]:
                made += close()
            if not now:
                now.update(block=int(block[low]), mixer=Mixer(None, sent.value), rows=[x[:0] for x in columns])
            now["rows"] = [np.concatenate([x, c[low:high]]) for x, c in zip(now["rows"], columns)]
            while len(now["rows"][0]) >= batch_tokens:
                step(batch_tokens)
        return made

    order = F.xxhash64("token", "group")
    dealt = counts.select(F.pmod(order, F.lit(BLOCKS)).cast("int").alias("block"), order.alias("_order"), "group", "token", "n").repartition("block")
    dealt = dealt.sortWithinPartitions("block", "_order", "token", "group").drop("_order")
    parts = map_arrow(dealt, rows, "block int, weights array<double>, hits array<double>, mass array<double>", close).collect()  # BLOCKS small rows
    parts.sort(key=lambda r: r.block)  # sorted by Spark, the blocks would be learnt twice: once to cut them into ranges
    mixer = Mixer(tables)
    if parts:
        weights, hits, mass = (sum(np.array(r[c]) for r in parts) for c in ("weights", "hits", "mass"))
        mixer.hits, mixer.mass = (x.reshape(mixer.gates, BINS) for x in (hits, mass))
        each = mixer.mass.sum(axis=1, keepdims=True)
        mixer.weights = np.where(each > 0, weights.reshape(mixer.weights.shape) / np.maximum(each, 1e-9), mixer.weights)
    mixer.freeze()
    return mixer


def score(docs: DataFrame, held: int = HELD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of each whole text: see the module."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    training = base.where(fold("_id") != held)
    classes = learn_classes(training)
    counts = staged(class_counts(training, classes), "class-counts")
    mixer = mix(counts, context_tables(counts))
    known = staged(_scored(counts, mixer), "tokens")
    whole = known.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(whole.n), int(whole.v)
    below = n + 0.5 * (v + 1)
    top = most_frequent(known, "token", "c", HEAD).select("token", "c", F.explode("scores").alias("s")).select("token", "c", "s.*").toArrow().to_pydict()
    # One number a word: frequent tokens, then telling words that are not among them.
    place = {w: i for i, w in enumerate(dict.fromkeys(top["token"]))}
    frequent = len(place)
    for w in classes.place:
        place.setdefault(w, len(place))
    telling = np.full(len(place) + 1, -1)  # the last is for all other tokens, whose number is -1
    for w, i in classes.place.items():
        telling[place[w]] = i
    terms, ready = np.zeros(frequent), np.full((len(classes.score) + 1, frequent), np.nan)
    for g, w, c, x in zip(top["group"], top["token"], top["c"], top["score"]):
        terms[place[w]], ready[g, place[w]] = np.log10((c + 0.5) / below), x
    sent = spark.sparkContext.broadcast((classes, mixer, place, telling, terms, ready, list(place)[:frequent]))

    def rows(batch):
        classes, mixer, place, telling, terms, ready, heads = sent.value
        code, bounds, words = token_stream(batch.column("_text"))
        at = np.fromiter(map(place.get, plain(words), repeat(-1)), np.int64, len(words))[code]
        group = classes.groups(telling[at], bounds)
        there = (at >= 0) & (at < len(terms))
        mine, of = at[there], group[there]
        found = ready[of, mine]
        new = np.flatnonzero(np.isnan(found))  # frequent, but not in this class
        if len(new):
            gs, ks = np.divmod(np.unique(of[new] * len(terms) + mine[new]), len(terms))
            ready[gs, ks] = mixer.log10([heads[k] for k in ks.tolist()], gs)
            found = ready[of, mine]
        text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        known, base, scored = (np.bincount(text[there], w, batch.num_rows) for w in (None, terms[mine], found))
        each, k = np.unique((text[~there] * len(ready) + group[~there]) * len(words) + code[~there], return_counts=True)
        each, token = np.divmod(each, len(words))
        text, group = np.divmod(each, len(ready))
        rest = pa.StructArray.from_arrays([pa.array(group, pa.int32()), words.take(pa.array(token)), pa.array(k, pa.int64())], ["group", "token", "k"])
        rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(batch.num_rows + 1)), pa.int32()), rest)
        return [pa.record_batch([batch.column("_id"), *map(pa.array, (np.diff(bounds), known, base, scored)), rest], ["_id", "n_tokens", "n_known", "base_score", "score", "rest"])]

    kind = docs.schema[id_col].dataType.simpleString()
    scored = map_arrow(base, rows, f"_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, rest array<struct<group: int, token: binary, k: bigint>>")
    scored = staged(scored, "scored").withColumn("_row", F.monotonically_increasing_id())  # stable: the files do not change
    rare = scored.select("_row", F.explode("rest").alias("r")).select("_row", "r.*").join(known, "token", "left")
    rare = staged(rare.select("_row", "group", "token", "k", "c", F.expr("get(filter(scores, s -> s.group = group), 0).score").alias("score")), "rare")

    def unseen(batch):
        pairs = list(zip(batch["group"], batch["token"]))
        fresh = list(set(pairs))
        value = dict(zip(fresh, sent.value[1].log10([w for _, w in fresh], np.array([g for g, _ in fresh], np.int64)).tolist()))
        return batch | {"score": [value[p] for p in pairs]}

    columns = "_row bigint, group int, token binary, k bigint, c bigint, score double"
    fresh = map_batches(rare.where(F.col("score").isNull()), unseen, columns)
    rare = rare.where(F.col("score").isNotNull()).unionByName(fresh)
    term = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(below))
    rare = rare.groupBy("_row").agg(
        F.sum(F.col("k") * term).alias("_base"), F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("_known"), F.sum(F.col("k") * F.col("score")).alias("_score"))
    out = scored.drop("rest").join(rare, "_row", "left")
    return out.select(
        F.col("_id").alias(id_col), (fold("_id") == held).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), (F.col("base_score") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )


def _scored(counts: DataFrame, mixer: Mixer) -> DataFrame:
    """Each token with its count over all classes and the model's score in each class that has it."""
    sent = counts.sparkSession.sparkContext.broadcast(mixer)

    def rows(batch):
        score = sent.value.log10(plain(batch.column("token")), plain(batch.column("group")).astype(np.int64))
        return [batch.append_column("score", pa.array(score))]

    made = map_arrow(counts.select("group", "token", "n"), rows, "group int, token binary, n bigint, score double")
    return made.groupBy("token").agg(F.sum("n").alias("c"), F.collect_list(F.struct("group", "score")).alias("scores"))  # at most one for each class
