"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of 8 bytes, a step of 4 bytes apart, run over the whole document.
Its activations are max-pooled over chunks of 512 bytes that overlap by half; the document is the
mean and the maximum over its chunks of each filter, and a hidden layer combines them into one
probability. A document is read in blocks, so memory doesn't depend on its length.

Training (Adam, back-propagation by hand) takes a bounded sample of labelled rows, whole texts, in the
order of a hash of the id: about SAMPLE rows, twice as many at most, and only as many as SAMPLE_BYTES
hold together. The rarer label weighs more, so that both weigh the same; a last step shifts the logit
back to the labels' rates.

Defined results: a null or empty text is one chunk of padding; without labels every score is 0.5; repeated
documents get equal rows; columns named like the outputs are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import add_columns, fold, materialize

#: Labelled rows that training sees, about (twice as many at most), and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 2000, 1 << 26
WIDTH, STEP, DIM, FILTERS, HIDDEN = 8, 4, 8, 32, 16
HOP = 256  # bytes; a chunk is two hops
BLOCK = 1 << 20


def _padded(text: str | None) -> np.ndarray:
    """UTF-8 bytes, padded with zeros to whole hops (two at least) and one step more."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    hops = max(2, -(-len(raw) // HOP))
    out = np.zeros(hops * HOP + STEP, np.uint8)
    out[: len(raw)] = raw
    return out


@dataclass
class Network:
    emb: np.ndarray  # 256 x DIM
    filters: np.ndarray  # STEP*DIM x 2*FILTERS: the two halves of each filter side by side
    filter_bias: np.ndarray
    hidden: np.ndarray  # 2*FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def hops(self, padded: np.ndarray, where: bool = False):
        """Maximum of each filter over each hop (and its position)."""
        rows = self.emb[padded].reshape(-1, STEP * DIM)
        both = rows @ self.filters
        conv = (both[:-1, :FILTERS] + both[1:, FILTERS:]).reshape(-1, HOP // STEP, FILTERS)
        return (conv.max(axis=1), conv.argmax(axis=1), rows) if where else conv.max(axis=1)

    def score(self, text: str | None) -> float:
        padded = _padded(text)
        parts = [self.hops(padded[at : at + BLOCK + STEP]) for at in range(0, len(padded) - STEP, BLOCK)]
        hop = np.maximum(np.concatenate(parts) + self.filter_bias, 0)
        chunk = np.maximum(hop[:-1], hop[1:])
        pooled = np.concatenate([chunk.mean(axis=0), chunk.max(axis=0)])
        h = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return float(1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30))))


def _new(seed: int) -> Network:
    r = np.random.default_rng(seed)
    f4 = lambda *s, scale: (r.normal(0, scale, s)).astype("f4")
    return Network(f4(256, DIM, scale=0.5), f4(STEP * DIM, 2 * FILTERS, scale=0.25), np.zeros(FILTERS, "f4"), f4(2 * FILTERS, HIDDEN, scale=0.2), np.zeros(HIDDEN, "f4"), f4(HIDDEN, scale=0.3), 0.0)


def fit(rows: list[tuple[int, str]], epochs: int = 6, batch: int = 16, rate: float = 3e-3, seed: int = 5) -> Network:
    """rows: (label, text), in a fixed order."""
    net = _new(seed)
    n = len(rows)
    share = sum(y for y, _ in rows) / n if n else 0.5
    if not n or not 0 < share < 1:
        net.out[:] = 0
        net.out_bias = float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5))) if n else 0.0
        return net
    data = [(y, _padded(t)) for y, t in rows]
    rng = np.random.default_rng(seed)
    names = ["emb", "filters", "filter_bias", "hidden", "hidden_bias", "out", "out_bias"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            grads = {k: np.zeros_like(getattr(net, k)) for k in names}
            for i in order[at : at + batch]:
                _backward(net, *data[i], weight[data[i][0]], grads)
            step += 1
            for k in names:
                g = grads[k] / batch
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                setattr(net, k, getattr(net, k) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6))
    for k in names[:-1]:
        setattr(net, k, getattr(net, k).astype("f4"))
    net.out_bias = float(net.out_bias + np.log(share / (1 - share)))
    return net


def _backward(net: Network, y: int, padded: np.ndarray, weight: float, grads: dict) -> None:
    """Adds the gradient of the weighted log loss of one document."""
    top, where, rows = net.hops(padded, where=True)
    hop = np.maximum(top + net.filter_bias, 0)
    chunk = np.maximum(hop[:-1], hop[1:])
    pooled = np.concatenate([chunk.mean(axis=0), chunk.max(axis=0)])
    pre = pooled @ net.hidden + net.hidden_bias
    h = np.maximum(pre, 0)
    z = float(h @ net.out + net.out_bias)
    d = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
    grads["out"] += d * h
    grads["out_bias"] += d
    dh = d * net.out * (pre > 0)
    grads["hidden"] += np.outer(pooled, dh)
    grads["hidden_bias"] += dh
    dp = net.hidden @ dh
    d_chunk = np.repeat(dp[None, :FILTERS] / len(chunk), len(chunk), axis=0)
    d_chunk[chunk.argmax(axis=0), np.arange(FILTERS)] += dp[FILTERS:]
    left = hop[:-1] >= hop[1:]
    d_hop = np.zeros_like(hop)
    d_hop[:-1] += d_chunk * left
    d_hop[1:] += d_chunk * ~left
    d_hop *= hop > 0
    grads["filter_bias"] += d_hop.sum(axis=0)
    # each hop passes its gradient to the one position where its filter was largest
    pos = (where + np.arange(len(where))[:, None] * (HOP // STEP)).ravel()
    f = np.tile(np.arange(FILTERS), len(where))
    g = d_hop.ravel()
    use = np.flatnonzero(g)
    pos, f, g = pos[use], f[use], g[use]
    d_rows = np.zeros_like(rows)
    for half in (0, 1):
        np.add.at(grads["filters"].T, f + half * FILTERS, g[:, None] * rows[pos + half])
        np.add.at(d_rows, pos + half, g[:, None] * net.filters[:, f + half * FILTERS].T)
    np.add.at(grads["emb"], padded, d_rows.reshape(-1, DIM))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Fit on at most 2 * `sample` labelled documents for which `allowed` holds, about `sample` by a hash of the id."""
    known = labels.select("doc_id", "quality").where(allowed & F.col("quality").isNotNull())
    counts = {q: n for q, n in known.groupBy("quality").count().collect()}
    dice = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1_000_000)) / 1e6
    rate = F.when(F.col("quality") == 1, F.lit(min(1.0, sample / 2 / max(1, counts.get(1, 0))))).otherwise(min(1.0, sample / 2 / max(1, counts.get(0, 0))))
    # at most 2 * sample ids, whatever the size of the tables
    chosen = known.where(dice < rate).orderBy(dice, "doc_id", "quality").limit(2 * sample)
    order = [F.xxhash64("doc_id", F.lit(31)), "size", "hash"]
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", "quality", "text", F.octet_length("text").alias("size"), F.xxhash64("text", "quality").alias("hash"))
    rows = materialize(rows.orderBy(*order).limit(2 * sample), "training")
    sizes = [r.size for r in rows.orderBy(*order).select("size").collect()]
    fitting = int(np.searchsorted(np.cumsum(sizes), sample_bytes, side="right"))
    rows = rows.orderBy(*order).limit(fitting).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id), r.text))
    return fit([(int(r.quality), r.text) for r in rows])


HELD = (5, 0)
THRESHOLD = 0.3


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels come from rows that aren't held out."""
    net = train(docs, labels, ~fold("doc_id", *HELD), sample)
    scored = add_columns(docs.select("doc_id", "text"), "text", "score double", lambda texts: [[net.score(t) for t in texts]])
    return scored.select("doc_id", fold("doc_id", *HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
