"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples count as labelled; everything else that training sees is unlabelled
text, in which toxic documents hide at a known rate (the class prior, estimated from the labels of
the training rows). The risk of a linear classifier f is prior * E_P[loss(f)] + max(0, E_U[loss(-f)]
- prior * E_P[loss(-f)]): the term in brackets is what the negatives alone would cost, and when it
falls below zero the step goes the other way, which keeps f from overfitting. Three classifiers with
different seeds are averaged.

Features are hashes of each whole word and of its first 4, 5 and 6 bytes, present or not, over the whole
text; only those that tell positives from unlabelled text by four standard errors get a weight. Training
takes a bounded sample by a hash of the id: about SAMPLE positives and SAMPLE unlabelled rows, twice as
many at most.

Defined results: a null or empty text gets the score of a text without features (the bias alone); with no
positive example every score is the prior, 0 if there are no labels; repeated documents get equal
rows; columns named like the outputs are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import add_columns, fold, worker_cached
from lumenloom.llm.minhash import U8, _mix, powers_upto

BUCKETS = 1 << 18
#: Rows of each kind (positive, unlabelled) that training sees, about; twice as many at most.
SAMPLE = 2000
#: Tasks that read the sampled texts.
TASKS = 32
PREFIXES = (4, 5, 6)


def _word_bytes() -> np.ndarray:
    return np.array([chr(c).isalnum() or c >= 128 for c in range(256)])


def buckets(text: str | None) -> np.ndarray:
    """Sorted distinct feature buckets of a text."""
    if not text:
        return np.zeros(0, "i8")
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.concatenate([[False], worker_cached("word_bytes", _word_bytes)[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = powers_upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U8)
    np.cumsum((raw.astype(U8) + U8(1)) * powers[: len(raw)], out=sums[1:])
    out = []
    for k in (0, *PREFIXES):
        s, e = (starts, ends) if not k else (starts[ends - starts > k], starts[ends - starts > k] + k)
        out.append(_mix((sums[e] - sums[s]) * inverse[s] + U8(k)) >> U8(46))
    return np.unique(np.concatenate(out)).astype("i8")


@dataclass
class Model:
    weights: np.ndarray | None
    bias: float

    def score(self, text: str | None) -> float:
        idx = buckets(text)
        f = self.bias + (float(self.weights[idx].sum(dtype="f8")) if self.weights is not None and len(idx) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(f, -30, 30))))


def _telling(positive: list, unlabelled: list, least: float) -> np.ndarray:
    """Buckets whose share among the positives differs from that among the unlabelled by `least` standard errors."""
    n_p, n_u = len(positive), len(unlabelled)
    p = np.bincount(np.concatenate(positive), minlength=BUCKETS)
    u = np.bincount(np.concatenate(unlabelled), minlength=BUCKETS)
    both = (p + u) / (n_p + n_u)
    z = (p / n_p - u / n_u) / np.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    return np.flatnonzero((np.abs(z) >= least) & (p + u >= 5))


def _risk(f: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float, np.ndarray]:
    """The positives' part of the risk, the rest of it (which may be negative) and the step's gradient by f; p, u: which rows are positive, unlabelled."""
    s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    k_p, k_u = max(1, p.sum()), max(1, u.sum())
    as_negative = np.logaddexp(0, f)
    own = prior * np.logaddexp(0, -f)[p].sum() / k_p
    rest = as_negative[u].sum() / k_u - prior * as_negative[p].sum() / k_p
    g = np.zeros(len(f))
    if rest >= 0:
        g[p] = -prior / k_p  # -(1 - s) as a positive, -s no longer as a negative
        g[u] = s[u] / k_u
    else:  # step back on the part that went negative
        g[p] = prior * s[p] / k_p
        g[u] = -s[u] / k_u
    return own, rest, g


def _train_one(positive: list, unlabelled: list, prior: float, seed: int, steps: int, rate: float, l2: float) -> tuple[np.ndarray, float]:
    """Gradient steps on the non-negative risk with a logistic loss, over a random 9 tenths of the rows at a time."""
    docs = positive + unlabelled
    n_p = len(positive)
    idx = np.concatenate(docs)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(BUCKETS), 0.0
    squares, bias_squares = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(steps):
        p, u = (use := rng.random(len(docs)) < 0.9).copy(), use.copy()
        p[n_p:], u[:n_p] = False, False
        f = np.bincount(row, weights=w[idx], minlength=len(docs)) + bias
        g = _risk(f, p, u, prior)[2]
        gw = np.bincount(idx, weights=g[row], minlength=BUCKETS) + l2 * w
        gb = g.sum()
        squares = 0.95 * squares + 0.05 * gw * gw
        bias_squares = 0.95 * bias_squares + 0.05 * gb * gb
        w -= rate * gw / (np.sqrt(squares) + 1e-4)
        bias -= rate * gb / (np.sqrt(bias_squares) + 1e-4)
    return w, bias


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least: float = 4.0, steps: int = 200, rate: float = 0.03, l2: float = 1e-4) -> Model:
    """positive, unlabelled: feature buckets of documents, in a fixed order."""
    if not positive or not unlabelled or prior <= 0:
        return Model(None, float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))
    telling = np.zeros(BUCKETS, bool)
    telling[_telling(positive, unlabelled, least)] = True
    positive, unlabelled = [d[telling[d]] for d in positive], [d[telling[d]] for d in unlabelled]
    found = [_train_one(positive, unlabelled, prior, seed, steps, rate, l2) for seed in (1, 2, 3)]
    return Model(np.mean([w for w, _ in found], axis=0).astype("f4"), float(np.mean([b for _, b in found])))


def _sample(df: DataFrame, n: int, limit: int) -> DataFrame:
    """About `limit` of the n rows by a hash of the id, never more than twice as many."""
    dice = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1_000_000)) / 1e6
    return df.where(dice < min(1.0, limit / max(1, n))).orderBy(dice, "doc_id").limit(2 * limit)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE) -> Model:
    """Fit on confirmed toxic documents and unlabelled ones, all from rows for which `allowed` holds."""
    known = labels.select("doc_id", "toxic").where(allowed & F.col("toxic").isNotNull())
    n_known, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = n_toxic / n_known if n_known else 0.0
    pool = docs.select("doc_id", "text").where(allowed & F.col("text").isNotNull())
    chosen = _sample(known.where("toxic = 1").select("doc_id").distinct(), n_toxic, sample)
    make = lambda texts: [[buckets(t).tolist() for t in texts]]

    def features(df: DataFrame) -> list[np.ndarray]:
        rows = add_columns(df.repartition(TASKS, F.xxhash64("text")), "text", "idx array<int>", make).collect()
        rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id), r.idx))
        return [np.array(r.idx, "i8") for r in rows]

    # the chosen ids are at most 2 * sample rows, whatever the size of the tables
    found = pool.join(F.broadcast(chosen), "doc_id", "left_semi")
    positive = features(found.orderBy(F.xxhash64("doc_id", F.lit(29)), F.xxhash64("text")).limit(2 * sample))
    unlabelled = features(_sample(pool, pool.count(), sample))
    return fit(positive, unlabelled, prior)


HELD = (3, 1)
THRESHOLD = 0.7


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels come from rows that aren't held out."""
    model = train(docs, labels, ~fold("doc_id", *HELD), sample)
    scored = add_columns(docs.select("doc_id", "text"), "text", "score double", lambda texts: [[model.score(t) for t in texts]])
    return scored.select("doc_id", fold("doc_id", *HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
