"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of code points of the whole text in lower case, everything but
letters read as a space, hashed into 2**16 buckets; a feature is its relative frequency times its
inverse document frequency, which Spark counts over all documents that may be learned from. Training is
follow-the-regularised-leader (proximal, one learning rate for each coordinate) with L1 and L2 penalties,
on a bounded sample of labelled documents: about SAMPLE rows by a hash of the id, twice as many at most,
as many of each language where there are enough. A fifth of the sample is kept apart to fit one
temperature, which calibrates the probabilities.

The score of a text is linear in its n-grams, so a text of any length is read in blocks and each
block adds to the sums; scoring needs no shuffle and holds one block at a time.

Defined results: a null text or one without a letter is `und` with score 0; if nothing can be
learned (no labelled text), every text is `und`; ties between languages go to the first by name;
repeated documents get equal rows; a row without an id may be learned from; columns named like the
outputs are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import add_columns, fold, tidy, worker_cached

BUCKETS = 1 << 16
BLOCK = 1 << 20
#: Rows that training sees, about; twice as many at most.
SAMPLE = 3000
#: Tasks that read the sampled texts.
TASKS = 32
UNKNOWN = "und"
SCALE = 30.0


def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams, one array for each block of the text; nothing without letters."""
    alpha = worker_cached("alpha", _letters)
    if not any(map(str.isalpha, text)):
        return
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, max(1, len(points) - 2), BLOCK):
        block = points[at : at + BLOCK + 2]
        x = np.where(alpha[block], block, 32).astype("u4")
        one = x * np.uint32(2654435761)
        two = (one[:-1] ^ (one[1:] >> np.uint32(3))) * np.uint32(2246822519)
        three = (two[:-1] ^ (one[2:] >> np.uint32(5))) * np.uint32(3266489917)
        n = len(three)
        yield np.concatenate([one[:n] >> np.uint32(16), two[:n] >> np.uint32(16), three >> np.uint32(16)])


def _counts(text: str | None) -> np.ndarray:
    """How often each bucket occurs in a text."""
    total = np.zeros(BUCKETS, "i8")
    for block in _grams(text or ""):
        total += np.bincount(block, minlength=BUCKETS)
    return total


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x languages, idf folded in
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.langs)), 0
        for block in _grams(text) if text and self.langs else ():
            total += np.take(self.weights, block, axis=0).sum(axis=0, dtype="f8")
            n += len(block)
        if not n:
            return UNKNOWN, 0.0
        logits = (SCALE * total / n + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max())
    return p / p.sum()


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seen: np.ndarray, documents: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 2) -> Model:
    """rows: (lang, buckets, counts), in a fixed order; seen: in how many of the documents each bucket occurs."""
    langs = sorted({lang for lang, _, _ in rows})
    if len(langs) < 1:
        return Model([], np.zeros((0, 0), "f4"), np.zeros(0), 1.0)
    k, at = len(langs), {lang: i for i, lang in enumerate(langs)}
    idf = np.log((1 + documents) / (1 + seen)) + 1
    data = [(at[lang], idx, SCALE * idf[idx] * counts / counts.sum()) for lang, idx, counts in rows]
    kept_apart = [d for i, d in enumerate(data) if i % 5 == 4]
    training = [d for i, d in enumerate(data) if i % 5 != 4]
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def weights(idx: np.ndarray) -> np.ndarray:
        zi = z[idx]
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[idx])) / alpha + l2))

    for _ in range(epochs):
        for y, idx, x in training:
            idx, x = np.append(idx, BUCKETS), np.append(x, 1.0)  # the last coordinate is the bias
            w = weights(idx)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            n_new = n[idx] + g * g
            z[idx] += g - (np.sqrt(n_new) - np.sqrt(n[idx])) / alpha * w
            n[idx] = n_new
    w = weights(np.arange(BUCKETS + 1))
    logits = [(y, x @ w[idx] + w[BUCKETS]) for y, idx, x in kept_apart]
    losses = {t: -sum(np.log(max(_softmax(s / t)[y], 1e-12)) for y, s in logits) for t in np.geomspace(0.1, 10, 41)}
    temperature = float(min(losses, key=losses.get)) if logits else 1.0
    return Model(langs, (w[:BUCKETS] * idf[:, None]).astype("f4"), w[BUCKETS], temperature)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and in how many any does; added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS + 1, "i8")  # the last one counts documents
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = np.zeros(BUCKETS + 1, bool)
                for block in _grams(text or ""):
                    own[block] = own[BUCKETS] = True
                seen += own
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype("i4")), pa.array(seen[some])], names=["bucket", "n"])

    seen = np.zeros(BUCKETS + 1, "i8")
    for bucket, n in docs.select("text").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        seen[bucket] = n
    return seen[:BUCKETS], int(seen[BUCKETS])


def train(docs: DataFrame, allowed: Column, sample: int = SAMPLE) -> Model:
    """Fit on about `sample` of the documents for which `allowed` holds and lang is known.

    The sample is chosen by a hash of the id, at a rate for each language that its count gives;
    its n-gram counts are made on the executors.
    """
    pool = docs.where(allowed & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    known = pool.where("lang is not null")
    counts = dict(known.groupBy("lang").count().collect())
    if not counts:
        return fit([], np.zeros(BUCKETS), 0)
    quota = sample / len(counts)
    rate = F.lit(0.0)
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, quota / n))).otherwise(rate)
    dice = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) / 1e6
    chosen = known.where(dice < rate).orderBy(dice, F.xxhash64("text")).limit(2 * sample).repartition(TASKS, F.xxhash64("text"))

    def features(texts: list[str | None]) -> list[list]:
        idx, counts = [], []
        for t in texts:
            n = _counts(t)
            idx.append(np.flatnonzero(n).tolist())
            counts.append(n[idx[-1]].tolist())
        return [idx, counts]

    rows = add_columns(chosen, "text", "idx array<int>, counts array<int>", features).where("size(idx) > 0").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id), r.lang, r.idx, r.counts))
    return fit([(r.lang, np.array(r.idx), np.array(r.counts)) for r in rows], *document_frequencies(pool))


def predict(docs: DataFrame, model: Model, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs without text_col, plus lang_pred and score (after the prefix)."""

    def run(texts: list[str | None]) -> list[list]:
        found = [model.predict(t) for t in texts]
        return [[f[0] for f in found], [f[1] for f in found]]

    return add_columns(docs, text_col, f"{prefix}lang_pred string, {prefix}score double", run)


HELD = (4, 2)


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learns from the rows that aren't held out."""
    model = train(docs, ~fold("doc_id", *HELD), sample)
    scored = predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", fold("doc_id", *HELD).alias("held_out"), "lang_pred", "score")
