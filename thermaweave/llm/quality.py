"""Quality by nearest labelled neighbours in a latent-semantic space.

A document is a vector of hashed terms: character trigrams as they are written, trigrams of character shapes with
runs of letters drawn together, the order of magnitude of its length and how often a word follows itself. Counts are dampened, weighted by inverse document
frequency and normalised per kind; the leading singular directions of a labelled sample project them to a few latent
dimensions. The labelled vectors go to every task (at most ``EACH`` of either label); cosine products
with all of them are formed exactly, in blocks, for every document; the ``NEIGHBOURS`` nearest vote for their label with their
similarity as weight. Every text is read whole.

Defined cases: a NULL or empty text has its length as only term and is judged by the shortest
labelled texts; equal similarities go to the earlier sample vector; with labels of one class only, or none, every
score is the share of label 1 (0 without labels); labels whose value or id is NULL are not learnt from; repeated rows
are each scored; a NULL id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, map_batches, training_fold

TERMS = 1024  # of each kind
DIMENSIONS = 48
NEIGHBOURS = 25
#: Labelled documents of each label learnt from, at most.
EACH = 3000
POWER = 8


def _shapes() -> np.ndarray:
    """Shape class of each code point of the basic plane."""
    out = np.full(1 << 16, 7, np.uint8)
    for c in range(1 << 16):
        kind = unicodedata.category(chr(c))
        out[c] = {"Ll": 1, "Lo": 1, "Lm": 1, "Lu": 2, "Lt": 2, "Nd": 3, "Zs": 4, "Cc": 5}.get(kind, 6 if kind[0] in "PS" else 7)
    out[10] = out[13] = 8
    return out


_SHAPE: list[np.ndarray] = []


def _hash(a, b, c) -> np.ndarray:
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)) % np.uint32(TERMS)


def terms(text: str | None) -> np.ndarray:
    """Dampened counts of the hashed terms of a whole text, each kind of unit length."""
    if not _SHAPE:
        _SHAPE.append(_shapes())
    out = np.zeros(2 * TERMS + 32 + 5, np.float32)
    x = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    out[2 * TERMS + int(len(x)).bit_length() % 32] = 0.5
    ws = (text or "").split()
    again = sum(map(eq, ws, ws[1:])) / max(len(ws) - 1, 1)
    out[2 * TERMS + 32 + sum(again > limit for limit in (0, 0.02, 0.1, 0.4))] = 0.7
    shape = _SHAPE[0][np.minimum(x, 0xFFFF)].astype(np.uint32)
    # Signs keep their identity; of a run of letters of one shape, the first is kept.
    sign = np.where(shape >= 6, x + 16, shape)
    drawn = sign[np.r_[True, sign[1:] != sign[:-1]]] if len(sign) else sign
    for k, y in enumerate((x, drawn)):
        if len(y) > 2:
            counted = np.log1p(np.bincount(_hash(y[:-2], y[1:-1], y[2:]), minlength=TERMS).astype(np.float32))
            out[k * TERMS : (k + 1) * TERMS] = counted / np.linalg.norm(counted)
    return out


class Model:
    """Projection, labelled latent vectors, labels."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS):
        self.constant = float(labels.mean()) if len(labels) else 0.0
        self.vectors = None
        if len(set(labels.tolist())) < 2:
            return
        present = (rows > 0).sum(axis=0)
        self.weight = np.log((1 + len(rows)) / (1 + present)).astype(np.float32) + 0.1
        x = rows * self.weight
        value, vector = np.linalg.eigh((x.T @ x).astype(np.float64))
        self.project = np.ascontiguousarray((self.weight[:, None] * vector[:, ::-1][:, :dimensions]).astype(np.float32))
        self.vectors, self.labels = self.latent(rows), labels.astype(np.float32)

    def latent(self, rows: np.ndarray) -> np.ndarray:
        y = rows @ self.project
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str | None], block: int = 512) -> list[float]:
        if self.vectors is None:
            return [self.constant] * len(texts)
        k = min(NEIGHBOURS, len(self.vectors))
        out = []
        for at in range(0, len(texts), block):
            cosine = self.latent(np.stack([terms(t) for t in texts[at : at + block]])) @ self.vectors.T
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 1e-6).astype(np.float64) ** POWER
            out += ((weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)).clip(0, 1).tolist()
        return out


def learn(docs: DataFrame, labels: DataFrame, target: str = "quality", held: int = 0, each: int = EACH, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model from the labelled documents outside the held-out fold."""
    known = labels.where(F.col(id_col).isNotNull() & training_fold(held, id_col)).select(F.col(id_col).alias("_key"), F.col(target).cast("int").alias("_label"))
    order = [F.xxhash64("_key"), F.col("_key")]
    picked = known.where("_label = 0").orderBy(*order).limit(each).unionByName(known.where("_label = 1").orderBy(*order).limit(each))
    # At most 2 * each rows of two numbers.
    sample = docs.select(F.col(id_col).alias("_key"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_key")

    def rows(batch):
        return {"key": batch["_key"], "label": batch["_label"], "terms": [terms(t).astype(np.float16).tobytes() for t in batch["_text"]]}

    got = map_batches(sample, rows, f"key {labels.schema[id_col].dataType.simpleString()}, label int, terms binary").collect()
    got.sort(key=lambda r: (r.key, r.label, r.terms))
    x = np.frombuffer(b"".join(r.terms for r in got), np.float16).reshape(len(got), 2 * TERMS + 37).astype(np.float32)
    return Model(x, np.array([r.label for r in got], np.int64))


def score(docs: DataFrame, model: Model, held: int = 0, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, held_out, score and predicted of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch):
        return {"_id": batch["_id"], "score": sent.value.scores(batch["_text"])}

    kind = docs.schema[id_col].dataType.simpleString()
    made = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), rows, f"_id {kind}, score double")
    return made.select(F.col("_id").alias(id_col), (fold("_id") == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
