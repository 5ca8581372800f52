"""The learned operators against plain versions: loops, dictionaries and numerical gradients."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from edges import SCHEMA, prose, rows
from lumenloom.llm import langid, quality, toxicity


def grams(text):
    """Buckets of a text's n-grams, one code point at a time."""
    chars = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
    cut, out = (1 << 32) - 1, []
    for i in range(len(chars) - 2):
        one = [c * 2654435761 & cut for c in chars[i : i + 3]]
        two = (one[0] ^ one[1] >> 3) * 2246822519 & cut
        three = (two ^ one[2] >> 5) * 3266489917 & cut
        out += [one[0] >> 16, two >> 16, three >> 16]
    return out


def softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain_language(texts, sample):
    """Predictions for (id, text, lang): dictionaries of weights, one coordinate at a time."""
    letters = lambda t: any(c.isalpha() for c in t or "")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    pool = [(i, t, x) for i, t, x in texts if t is not None and not held(i)]
    seen, n = Counter(), 0
    for _, t, _ in pool:
        if letters(t):
            seen.update(set(grams(t)))
            n += 1
    idf = lambda b: math.log((1 + n) / (1 + seen[b])) + 1
    known = sorted((zlib.crc32(str(i).encode()), str(i), x, t) for i, t, x in pool if x is not None and letters(t))
    langs = sorted({x for _, _, x, _ in known})
    alpha, beta, l1, l2 = 0.5, 1.0, 0.02, 0.1
    z, sq = defaultdict(float), defaultdict(float)

    def weight(c):
        if abs(z[c]) <= l1:
            return 0.0
        return -(z[c] - math.copysign(l1, z[c])) / ((beta + math.sqrt(sq[c])) / alpha + l2)

    def features(t):
        counts = Counter(grams(t))
        total = sum(counts.values())
        return {b: 30 * idf(b) * c / total for b, c in counts.items()} | {"bias": 1.0}

    logits = lambda x: [sum(v * weight((b, k)) for b, v in x.items()) for k in range(len(langs))]
    data = [(langs.index(x), features(t)) for _, _, x, t in known]
    for _ in range(2):
        for at, (y, x) in enumerate(data):
            if at % 5 == 4:
                continue
            p = softmax(logits(x))
            steps = []
            for b, v in x.items():
                for k in range(len(langs)):
                    g, c = v * (p[k] - (k == y)), (b, k)
                    steps.append((c, g, weight(c)))
            for c, g, w in steps:
                z[c] += g - (math.sqrt(sq[c] + g * g) - math.sqrt(sq[c])) / alpha * w
                sq[c] += g * g
    apart = [(y, logits(x)) for at, (y, x) in enumerate(data) if at % 5 == 4]
    cost = {t: -sum(math.log(max(softmax([v / t for v in s])[y], 1e-12)) for y, s in apart) for t in np.geomspace(0.1, 10, 41)}
    temperature = min(cost, key=cost.get)
    out = {}
    for i, t, _ in texts:
        p = softmax([v / temperature for v in logits(features(t))]) if letters(t) else None
        out[i] = (langs[p.index(max(p))], max(p)) if p else ("und", 0.0)
    return out


def test_language_equals_the_plain_version(spark):
    words = {"aa": "der die und nicht ein mit haus wald", "bb": "the and not with house wood one water", "cc": "le la les maison avec pas une eau"}
    texts = []
    for k in range(72):
        lang = "abc"[k % 3] * 2
        own = words[lang].split()
        texts.append((k, " ".join(own[(k * 7 + j * j) % 8] for j in range(12 + k % 5)) + " 42!", lang if k % 7 else None))
    texts += [(100, None, "aa"), (101, "12 34", "bb"), (102, "", None), (103, "Eau Maison ü", None)]
    want = plain_language(texts, langid.SAMPLE)
    got = langid.identify(spark.createDataFrame(texts, "doc_id long, text string, lang string")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.lang_pred == want[r.doc_id][0] and math.isclose(r.score, want[r.doc_id][1], abs_tol=1e-4), r


def test_language_sample_does_not_depend_on_partitions(spark):
    texts = [(k, prose(20, k), "ab"[k % 2] * 2) for k in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    one, other = (langid.train(d, d["doc_id"].isNotNull(), 40) for d in (df.coalesce(1), df.repartition(7)))
    assert np.array_equal(one.weights, other.weights) and one.temperature == other.temperature


def test_risk_has_the_gradient_of_its_parts():
    rng = np.random.default_rng(2)
    for shift, prior in ((0.0, 0.3), (3.0, 0.9), (-3.0, 0.1)):
        f = rng.normal(0, 1, 12)
        p = np.arange(12) < 5
        f[p] += shift
        own, rest, g = toxicity._risk(f, p, ~p, prior)
        for i in range(12):
            step = np.zeros(12)
            step[i] = 1e-6
            up, down = toxicity._risk(f + step, p, ~p, prior), toxicity._risk(f - step, p, ~p, prior)
            slope = ((up[0] + up[1]) - (down[0] + down[1])) / 2e-6 if rest >= 0 else -(up[1] - down[1]) / 2e-6
            assert math.isclose(g[i], slope, abs_tol=1e-6)
        plain = sum(prior * math.log(1 + math.exp(-x)) for x in f[:5]) / 5
        assert math.isclose(own, plain, rel_tol=1e-9)
    assert toxicity._risk(np.array([9.0, -9.0]), np.array([True, False]), np.array([False, True]), 0.9)[1] < 0


def test_toxicity_scores_are_sums_of_weights(spark):
    bad, good = "grok snarl vex", "meadow tulip brook"
    texts = [(k, f"{prose(30, k)} {bad if k % 4 == 0 else good} Ünïcode {k}") for k in range(240)] + [(900, None), (901, ""), (902, "...")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(240)], "doc_id long, toxic int")
    from lumenloom.llm.common import fold

    model = toxicity.train(d, labels, ~fold("doc_id", 3, 1))
    for r in toxicity.score_toxicity(d, labels).collect():
        text = dict(texts)[r.doc_id]
        f = model.bias + sum(float(model.weights[b]) for b in set(toxicity.buckets(text).tolist()))
        assert math.isclose(r.score, 1 / (1 + math.exp(-f)), rel_tol=1e-6) and r.predicted == int(r.score >= 0.7)
    found = {r.doc_id: r.score for r in toxicity.score_toxicity(d, labels).collect()}
    assert min(found[k] for k in range(0, 240, 4)) > max(found[k] for k in range(240) if k % 4)


def plain_forward(net, text):
    """The network's probability, one position and one filter at a time."""
    raw = (text or "").encode()
    hops = max(2, -(-len(raw) // quality.HOP))
    data = raw + bytes(hops * quality.HOP + quality.STEP - len(raw))
    half = quality.STEP * quality.DIM
    tops = []
    for h in range(hops):
        best = [-math.inf] * quality.FILTERS
        for at in range(h * quality.HOP, (h + 1) * quality.HOP, quality.STEP):
            window = [float(x) for b in data[at : at + quality.WIDTH] for x in net.emb[b]]
            for f in range(quality.FILTERS):
                weights = [*net.filters[:, f], *net.filters[:, quality.FILTERS + f]]
                best[f] = max(best[f], sum(a * float(b) for a, b in zip(window, weights)))
        assert len(weights) == 2 * half
        tops.append([max(0.0, b + float(c)) for b, c in zip(best, net.filter_bias)])
    chunks = [[max(a, b) for a, b in zip(x, y)] for x, y in zip(tops, tops[1:])]
    pooled = [sum(c) / len(chunks) for c in zip(*chunks)] + [max(c) for c in zip(*chunks)]
    hidden = [max(0.0, sum(p * float(net.hidden[i, j]) for i, p in enumerate(pooled)) + float(net.hidden_bias[j])) for j in range(quality.HIDDEN)]
    z = sum(h * float(o) for h, o in zip(hidden, net.out)) + float(net.out_bias)
    return 1 / (1 + math.exp(-z))


def test_network_equals_the_plain_version():
    net = quality._new(3)
    for text in (None, "", "a", prose(60, 1), "ü🙂" * 400):
        assert math.isclose(net.score(text), plain_forward(net, text), rel_tol=1e-4)


def test_network_gradient_is_the_numerical_one():
    net = quality._new(4)
    for k in ("emb", "filters", "filter_bias", "hidden", "hidden_bias", "out"):
        setattr(net, k, getattr(net, k).astype("f8"))
    padded = quality._padded(prose(180, 2))
    names = ["emb", "filters", "filter_bias", "hidden", "hidden_bias", "out", "out_bias"]
    grads = {k: np.zeros_like(np.asarray(getattr(net, k), "f8")) for k in names}
    quality._backward(net, 1, padded, 0.7, grads)
    text = prose(180, 2)
    loss = lambda: -0.7 * math.log(net.score(text))
    rng = np.random.default_rng(1)
    for k in names[:-1]:
        value = getattr(net, k)
        for at in [tuple(rng.integers(0, s) for s in value.shape) for _ in range(25)] + [np.unravel_index(np.abs(grads[k]).argmax(), value.shape)]:
            kept = value[at]
            value[at] = kept + 1e-6
            up = loss()
            value[at] = kept - 1e-6
            down = loss()
            value[at] = kept
            assert math.isclose(grads[k][at], (up - down) / 2e-6, rel_tol=1e-3, abs_tol=1e-6), (k, at)


def test_quality_sample_is_bounded_in_bytes(spark):
    texts = [(k, prose(200, k)) for k in range(60)] + [(7, prose(200, 99))]
    d = spark.createDataFrame(rows(texts), SCHEMA)
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    given, fit = [], quality.fit
    quality.fit = lambda rows: given.append(rows) or fit(rows)
    try:
        for parts in (1, 5):
            quality.train(d.repartition(parts), labels, labels["doc_id"].isNotNull(), 40, 20_000)
    finally:
        quality.fit = fit
    assert given[0] == given[1] and 5 < len(given[0]) and sum(len(t.encode()) for _, t in given[0]) <= 20_000
