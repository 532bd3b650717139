"""Toxicity: a subsequence string kernel, Nyström landmarks and a linear support vector machine.

The kernel of two words sums, over all subsequences of three letters that they share, a decay for each
letter that the subsequence spans in either word, and is normalised to 1 for equal words. Letters that are left out,
inserted or changed only lower it, so ``idiiot`` and ``i.d.i.o.t`` stay near ``idiot``. Landmarks are words that labelled
toxic sentences have and clean ones do not; kernel values against them, whitened by the landmarks' own
kernel matrix, are the features of a linear SVM. As three-letter subsequences are few, its
decision for a word is one table look-up for each of them: no kernel row is formed when scoring.

Training is on sentences with their document's label, taken as bags of words: the word that decides a toxic
document is found from the labels and again from the machine (multiple instances), and clean words that come
out highest are brought in as further negatives. A document scores by its highest word, mapped to
(0, 1) by a logistic fit over training documents. At most ``CLEAN`` and ``TOXIC`` labelled documents, by hash order of
the id, are learnt from; every text is scored whole.

Defined cases: a NULL or empty text has no word and gets the score of the lowest decision; with labels of one
class only, or none, every score is the share of toxic labels (0 without labels); labels whose value or id is NULL
are not learnt from; repeated rows are each scored; a NULL id is kept; an empty table gives an empty
result; other columns are ignored (:func:`score`) or kept (:func:`drop_toxic`).
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, training_fold

DECAY = 0.7
LANDMARKS = 64
#: Labelled documents learnt from, at most.
CLEAN, TOXIC = 5000, 2500
#: Letters of one kernel argument; longer runs are read in overlapping windows.
WINDOW = 24
MEMO = 500_000
#: Digits and signs written for letters, inside words that have letters too.
SIGNS = str.maketrans("013457@$", "oieastas")
PARTS = re.compile(r"[^\W_]+")
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]+\S(?!\S)){3,}")


def windows(run: str) -> list[str]:
    if len(run) <= WINDOW:
        return [run] if len(run) > 2 else []
    return [run[k : k + WINDOW] for k in range(0, len(run) - WINDOW // 2, WINDOW // 2)]


def units(word: str) -> list[str]:
    """The letter runs that a word (lower case, without white space) is scored by: its parts and, if cut by signs, the whole."""
    parts = PARTS.findall(word.translate(SIGNS) if not word.isalpha() and any(map(str.isalpha, word)) else word)
    out = [w for p in parts for w in windows(p)]
    return out + windows("".join(parts)) if len(parts) > 1 and min(map(len, parts)) < 3 else out


def words(text: str | None) -> set[str]:
    """Distinct words of a whole text in lower case; runs of single letters count as one word."""
    low = (text or "").lower()
    found = set(low.split())
    for m in SPACED.finditer(low):
        found.add("".join(m[0].split()))
    return found


def _codes(batch: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32).reshape(len(batch), -1)


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself, by the usual recursion over both arguments."""
    n = codes.shape[1]
    same = codes[:, :, None] == codes[:, None, :]
    before = np.ones((len(codes), n + 1, n + 1), np.float32)  # decayed sums over shorter subsequences that end earlier
    total = np.zeros(len(codes), np.float32)
    for length in (1, 2, 3):
        now = np.zeros_like(before)
        for i in range(n):
            row = np.zeros(len(codes), np.float32)
            for j in range(n):
                hit = same[:, i, j] * (DECAY * DECAY * before[:, i, j])
                if length == 3:
                    total += hit
                else:
                    row = DECAY * row + hit
                    now[:, i + 1, j + 1] = DECAY * now[:, i, j + 1] + row
        before = now
    return total


class Subsequences:
    """Decayed three-letter subsequences of words over a small alphabet, as table positions."""

    def __init__(self, alphabet: str):
        self.alphabet = alphabet
        self.base = len(alphabet) + 1  # 0: any other letter, in no subsequence of a landmark
        self.points = np.array(sorted(map(ord, alphabet)), np.uint32)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.points, codes).clip(0, len(self.points) - 1)
        return np.where(self.points[at] == codes, at + 1, 0)

    def each(self, codes: np.ndarray):
        """(table positions, decay) for every choice of three places."""
        x, b = self.letters(codes), self.base
        for i, j, k in combinations(range(codes.shape[1]), 3):
            yield (x[:, i] * b + x[:, j]) * b + x[:, k], DECAY ** (k - i + 1)

    def table(self, landmarks: list[str]) -> np.ndarray:
        out = np.zeros((self.base**3, len(landmarks)), np.float32)
        for m, word in enumerate(landmarks):
            codes = _codes([word])
            for at, decay in self.each(codes):
                out[at[0], m] += decay
            out[:, m] /= np.sqrt(self_kernel(codes)[0])
        return out

    def apply(self, table: np.ndarray, batch: list[str]) -> np.ndarray:
        """Rows of ``table`` summed over each word's subsequences, normalised."""
        out = np.zeros((len(batch), *table.shape[1:]), np.float32)
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(batch):
            by_length.setdefault(len(w), []).append(i)
        for n, places in by_length.items():
            for at in range(0, len(places), 4096):
                rows = places[at : at + 4096]
                codes = _codes([batch[i] for i in rows])
                total = np.zeros((len(rows), *table.shape[1:]), np.float32)
                for index, decay in self.each(codes):
                    total += decay * table[index]
                norm = np.sqrt(self_kernel(codes))
                out[rows] = total / (norm if total.ndim == 1 else norm[:, None])
        return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 1500, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a squared-hinge linear SVM, by accelerated gradient steps."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    weight = weight / weight.sum()
    scale = 1 / (2 * np.linalg.eigvalsh((x * weight[:, None]).T @ x)[-1] + penalty)
    w = v = np.zeros(x.shape[1])
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        grad = -2 * x.T @ (weight * y * slack) + penalty * np.r_[v[:-1], 0]
        new = v - scale * grad
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and place of a logistic curve through labels that are pulled in a little, so that it stays finite."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y > 0, 1 / max(n1, 1), 1 / max(n0, 1))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * x * x).sum() + 1e-6, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * x).sum() + 1e-6 * a, g.sum()])
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return float(a), float(b)


def disturbed(word: str) -> list[str]:
    """A word with one letter put in or doubled, at each place but the ends."""
    return [word[:k] + c + word[k:] for k in range(1, len(word)) for c in (word[k - 1], "xqz"[k % 3])]


class Model:
    """What scoring needs: one number for each subsequence, the bias, the curve."""

    def __init__(self, constant: float):
        self.constant, self.table = constant, None
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def decide(self, fresh: list[str]) -> dict[str, float]:
        """The highest decision among each word's units."""
        own = [units(w) for w in fresh]
        flat = sorted({u for us in own for u in us})
        value = dict(zip(flat, self.subsequences.apply(self.table, flat).tolist()))
        return {w: max((value[u] for u in us), default=0.0) for w, us in zip(fresh, own)}

    def highest(self, texts: list[str | None]) -> np.ndarray:
        bags = [words(t) for t in texts]
        fresh = {w for b in bags for w in b if w not in self.memo}
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = set().union(*bags)
        self.memo.update(self.decide(list(fresh)))
        return np.array([max((self.memo[w] for w in b), default=0.0) for b in bags]) + self.bias

    def scores(self, texts: list[str | None]) -> list[float]:
        if self.table is None:
            return [self.constant] * len(texts)
        a, b = self.curve
        return (1 / (1 + np.exp(-np.clip(a * self.highest(texts) + b, -30, 30)))).tolist()


def train(bags: list[str], labels: list[int], landmarks: int = LANDMARKS, rounds: int = 4) -> Model:
    """Fit from documents, each as its distinct units joined by line ends."""
    y = np.array(labels)
    model = Model(float(y.mean()) if len(y) else 0.0)
    if len(set(labels)) < 2:
        return model
    place: dict[str, int] = {}
    inside = [np.array([place.setdefault(u, len(place)) for u in bag.split("\n") if u], np.int32) for bag in bags]
    flat = list(place)
    if not flat:
        return model
    count = [np.bincount(np.concatenate([i for i, v in zip(inside, labels) if v == label]), minlength=len(flat)) for label in (0, 1)]
    n0, n1 = (y == 0).sum(), y.sum()
    # How far a word's share of toxic documents stands above its share of clean ones.
    evidence = count[1] / n1 - count[0] / n0 - 2 / np.sqrt(n0 * n1)
    evidence[count[0] / n0 >= 0.1 * count[1] / n1] = 0
    chosen = [w for _, w in sorted((-evidence[i], flat[i]) for i in np.flatnonzero(evidence > 0))][:landmarks]
    if not chosen:
        return model
    sub = Subsequences("".join(sorted(set("".join(chosen)))))
    table = sub.table(chosen)
    own = sub.apply(table, chosen).astype(np.float64)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-3 * value[-1]
    whiten = vector[:, keep] / np.sqrt(value[keep])

    def features(words_: list[str]) -> np.ndarray:
        return (sub.apply(table, words_) @ whiten).astype(np.float32)

    # Landmarks with a letter put in are toxic too, unless clean documents have such a word.
    variants = sorted({v for w in chosen if len(w) > 3 for v in disturbed(w)} - place.keys())
    varied = features(variants)
    clean = np.flatnonzero(count[0] > 0)
    unclean = count[0] == 0
    toxic_bags = [i[unclean[i]] for i, label in zip(inside, labels) if label]
    decision = sub.apply(table.sum(axis=1), flat)  # at first, closeness to the landmarks
    for turn in range(rounds):
        # The word that decides each toxic document: in the first turn by the labels alone. Landmarks always count.
        by = evidence if not turn else decision
        witness = Counter(int(b[by[b].argmax()]) for b in toxic_bags if len(b) and (turn or by[b].max() > 0))
        for word in chosen:
            witness[place[word]] = max(witness[place[word]], int(count[1][place[word]]))
        # Clean words that come out highest are the negatives.
        hard = clean[np.argsort(-decision[clean], kind="stable")[:20_000]]
        positive = np.array(list(witness.values())) / sum(witness.values())
        x = np.r_[features([flat[i] for i in witness]), features([flat[i] for i in hard]), varied]
        target = np.r_[np.ones(len(witness)), -np.ones(len(hard)), np.ones(len(variants))]
        weight = np.r_[positive, np.full(len(hard), 1 / max(len(hard), 1)), np.full(len(variants), 0.5 / max(len(variants), 1))]
        w, bias = linear_svm(x, target, weight)
        combined = (table @ (whiten @ w)).astype(np.float32)
        decision = sub.apply(combined, flat) + bias
    model.subsequences, model.bias, model.table = sub, bias, combined
    top = np.array([max(bias, decision[i].max()) if len(i) else bias for i in inside])
    model.curve = logistic(top, y)
    return model


def learn(docs: DataFrame, labels: DataFrame, target: str = "toxic", held: int = 0, clean: int = CLEAN, toxic: int = TOXIC, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model from the labelled documents outside the held-out fold."""
    known = labels.where(F.col(id_col).isNotNull() & training_fold(held, id_col)).select(F.col(id_col).alias("_key"), F.col(target).cast("int").alias("_label"))
    order = [F.xxhash64("_key"), F.col("_key")]
    picked = known.where("_label = 0").orderBy(*order).limit(clean).unionByName(known.where("_label = 1").orderBy(*order).limit(toxic))
    # At most clean + toxic rows of two numbers.
    sample = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_key").select("_label", "_text")

    def rows(batch):
        return {"label": batch["_label"], "units": ["\n".join(sorted({u for w in words(t) for u in units(w)})) for t in batch["_text"]]}

    got = map_batches(sample, rows, "label int, units string").collect()
    got.sort(key=lambda r: (r.label, r.units))
    return train([r.units for r in got], [r.label for r in got])


def score(docs: DataFrame, model: Model, held: int = 0, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, held_out, score and predicted of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch):
        return {"_id": batch["_id"], "score": sent.value.scores(batch["_text"])}

    kind = docs.schema[id_col].dataType.simpleString()
    made = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), rows, f"_id {kind}, score double")
    return made.select(F.col("_id").alias(id_col), (fold("_id") == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that the model calls toxic; all columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch):
        keep = [s < threshold for s in sent.value.scores(batch[text_col])]
        return {c: [v for v, k in zip(vs, keep) if k] for c, vs in batch.items()}

    return map_batches(docs, rows, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
