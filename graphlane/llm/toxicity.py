"""Toxicity scores from a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlane.llm.common import held_out, id_type

BITS = 18  # terms are hashed to so many bits
FACTORS = 4
SAMPLE_DOCS = 12_000  # labelled documents that are learned from, at most
LEAST_DOCS, LEAST_SHARE = 2, 1 / 400  # a term must occur in so many of them, and in such a share
EPOCHS, STEPS, BATCH, RATE, DECAY = 12, 600, 256, 0.02, 2e-3  # so many passes and steps at least
THRESHOLD = 0.3

SPLIT = bytes(32 if (b < 128 and not chr(b).isalnum()) else b for b in range(256))  # ASCII that is no letter or digit ends a term


class Terms(dict):
    """Term -> its hash; forgets all when it has grown large."""

    MOST = 500_000

    def __missing__(self, term: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[term] = h = zlib.crc32(term) >> (32 - BITS)
        return h


TERMS = Terms()


def features(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a text."""
    words = {*(text or "").lower().encode().translate(SPLIT).split()}
    return np.unique(np.fromiter(map(TERMS.__getitem__, words), np.int32, len(words)))


class FactorizationMachine:
    """bias + sum of w + sum over pairs of v·v, over the terms of a document; a logistic link.

    Terms of few learned documents have no weights. What a term says of the class by itself doesn't matter for that, so
    pairs are learned whose terms say nothing alone. Learned with Adam on the logistic loss, with a quadratic penalty on
    all weights, in a fixed order.
    """

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray) -> None:
        seen = np.bincount(np.concatenate([np.zeros(0, np.int32), *rows]), minlength=1 << BITS)
        kept = np.flatnonzero(seen >= max(LEAST_DOCS, LEAST_SHARE * len(rows)))
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[kept] = np.arange(len(kept))
        n = len(kept)
        rng = np.random.default_rng(7)
        self.table = np.zeros((n, 1 + FACTORS), np.float32)
        self.table[:, 1:] = rng.normal(0, 0.01, (n, FACTORS))
        rate = labels.mean() if len(labels) else 0.0
        self.bias = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
        if not n or not 0 < rate < 1:
            return
        own = [self.place[r][self.place[r] >= 0] for r in rows]
        epochs = max(EPOCHS, -(-STEPS * BATCH // len(own))) if len(own) > BATCH else EPOCHS
        m, v, step = np.zeros_like(self.table), np.zeros_like(self.table), 0
        for epoch in range(epochs):
            order = rng.permutation(len(own))
            for at in range(0, len(order), BATCH):
                ids = order[at : at + BATCH]
                sizes = np.array([len(own[i]) for i in ids])
                terms = np.concatenate([own[i] for i in ids])
                doc = np.repeat(np.arange(len(ids)), sizes)
                x = self.table[terms]
                sums = np.stack([np.bincount(doc, weights=x[:, f], minlength=len(ids)) for f in range(1 + FACTORS)], 1)
                squares = np.bincount(doc, weights=(x[:, 1:] ** 2).sum(1), minlength=len(ids))
                p = sigmoid(self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares))
                error = ((p - labels[ids]) / len(ids)).astype(np.float32)
                self.bias -= RATE * float(error.sum())
                each = error[doc]
                used, back = np.unique(terms, return_inverse=True)
                grad = np.empty((len(used), 1 + FACTORS), np.float32)
                grad[:, 0] = np.bincount(back, weights=each)
                for f in range(1, 1 + FACTORS):
                    grad[:, f] = np.bincount(back, weights=each * (sums[doc, f] - x[:, f]))
                grad += DECAY * self.table[used]
                step += 1
                m[used] = 0.9 * m[used] + 0.1 * grad
                v[used] = 0.999 * v[used] + 0.001 * grad**2
                self.table[used] -= RATE * (1 - epoch / epochs) * (m[used] / (1 - 0.9**step)) / (np.sqrt(v[used] / (1 - 0.999**step)) + 1e-8)

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        own = [self.place[r][self.place[r] >= 0] for r in rows]
        doc = np.repeat(np.arange(len(own)), [len(o) for o in own])
        x = self.table[np.concatenate([np.zeros(0, np.int32), *own])]
        sums = np.stack([np.bincount(doc, weights=x[:, f], minlength=len(own)) for f in range(1 + FACTORS)], 1)
        squares = np.bincount(doc, weights=(x[:, 1:] ** 2).sum(1), minlength=len(own))
        return sigmoid(self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> FactorizationMachine:
    """From at most sample_docs labelled rows, chosen by the hash of their ids; labels that are null or not 0 or 1 are left out.

    The chosen ids are the side that is broadcast: at most 1.5 * sample_docs. Terms of their texts are hashed by the
    executors. Of several rows of one doc_id the one with the least hash is learned; if one of its labels is 1, that.
    """
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("y"))
    n = marked.count()
    h = F.xxhash64("doc_id")
    drawn = marked if n <= sample_docs else marked.where(F.pmod(h, F.lit(1 << 20)) < int((1 << 20) * 1.2 * sample_docs / n))
    drawn = drawn.orderBy(h, "y").limit(sample_docs).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "y", "text")
    hashed = chosen.mapInArrow(_hashed, f"doc_id {id_type(docs)}, h long, y int, terms binary")
    rows = [r.x for r in hashed.groupBy("doc_id").agg(F.min(F.struct("h", "y", "terms")).alias("x")).collect()]
    rows.sort(key=lambda r: (r.h, r.y, bytes(r.terms)))
    return FactorizationMachine([np.frombuffer(r.terms, np.int32) for r in rows], np.array([r.y for r in rows], np.float64))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t).tobytes() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), batch.column("y"), pa.array(rows, pa.binary())], ["doc_id", "h", "y", "terms"])


def scored(docs: DataFrame, machine: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the columns score and predicted (1 from the threshold on).

    docs needs a column text. Null and empty texts get the score of a document without terms. Other columns and
    repeated rows stay; columns of those two names are replaced.
    """
    docs = docs.drop("score", "predicted")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                s = sent.value.scores([features(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())], [*part.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, f"{fields}, score double, predicted int")


def rated(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted; learns from labels that aren't held out.

    docs needs doc_id and text, labels doc_id and toxic; other columns are left out. Rows with a null or repeated doc_id
    stay, each scored for itself; a null id is not held out and teaches nothing. Without any labels of both classes all
    scores are the share of toxic ones, smoothed.
    """
    machine = learn(docs, labels.where(~held_out("doc_id", modulus, remainder)))
    rows = docs.select("doc_id", held_out("doc_id", modulus, remainder).alias("held_out"), "text")
    return scored(rows, machine).select(F.col("doc_id").cast(id_type(docs)), "held_out", "score", "predicted")
