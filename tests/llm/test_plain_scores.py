"""Scores of the learned models against plain versions that take features one at a time."""

import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from provloom.llm import classifier, language
from provloom.llm.blocks import U64, mix, window_hashes
from provloom.llm.mixing import solve_rates

RNG = random.Random(21)
LETTERS = "abcdefghijklmnoprstuvwäßñé"
TEXTS = [" ".join("".join(RNG.choice(LETTERS) for _ in range(RNG.randint(1, 9))) for _ in range(RNG.randint(0, 40))) for _ in range(60)] + ["", "a", "one two", "Ünï\ncödé  x y z", "!!! 42", "日本 語"]


def plain_buckets(text, buckets):
    words, out = text.split(), []
    hashes = [xxhash.xxh3_64_intdigest(w) for w in words]
    for w, h in zip(words, hashes):
        out.append(h % buckets)
        marked = np.array([ord(c) for c in f"<{w}>"], U64)
        out += [int(window_hashes(mix(marked[k : k + n] + U64(n << 32)), n)[0] % U64(buckets)) for n in classifier.NGRAMS for k in range(len(marked) - n + 1)]
    for n in classifier.PHRASES:
        out += [int(window_hashes(mix(np.array(hashes[k : k + n], U64) + U64(n)), n)[0] % U64(buckets)) for k in range(len(words) - n + 1)]
    return out


def test_classifier_scores_are_means_of_bucket_logits():
    rng, buckets = np.random.default_rng(1), 4096
    model = classifier.SubwordModel([0, 1, 2], rng.standard_normal((buckets, 3)).astype(np.float32), np.array([0.1, -0.2, 0.3]))
    got = model.probabilities(pa.array(TEXTS))
    for text, row in zip(TEXTS, got):
        at = plain_buckets(text, buckets)
        logits = model.bias + (model.logits[at].astype(float).mean(0) if at else 0)
        p = np.exp(logits - logits.max())
        assert np.allclose(row, p / p.sum(), atol=1e-5), text
    for text, (at, weight) in zip(TEXTS, classifier.features(pa.array(TEXTS), buckets)):
        own = plain_buckets(text, buckets)
        assert dict(zip(at.tolist(), weight.tolist())) == {b: np.float32(own.count(b) / max(1, len(own))) for b in set(own)}


def plain_places(text):
    """The places of each length that a text's n-grams fill."""
    s = [ord(c) if c.isalpha() else 0 for c in "\0\0\0" + text.lower() + "\0\0\0"]
    found = {}
    for n, places in language.PLACES.items():
        found[n] = set()
        for i in range(len(s) - 3):
            if i + n > len(s) or not (s[i] if n == 1 else s[i] or s[i + 1]):
                continue
            h = s[i]
            for k in range(2, n + 1):
                h = (h * 0x01000193 + s[i + k - 1] * (2 * k + 1)) & 0xFFFFFFFF
            found[n].add((((h * 0x9E3779B1) & 0xFFFFFFFF) >> 12) % places)
    return found


def kernel(x, y):
    return sum(len(x[n] & y[n]) / math.sqrt(max(1, len(x[n])) * max(1, len(y[n]))) for n in language.PLACES) / len(language.PLACES)


def test_language_decisions_equal_kernels_of_sets():
    taught = [t for t in TEXTS if any(c.isalpha() for c in t)][:50]
    names = ["aa" if "e" in t[: len(t) // 2] else "bb" for t in taught]
    filled, seen = language.presence(TEXTS)
    assert seen.tolist() == [any(c.isalpha() for c in t) for t in TEXTS]
    model = language.solve(language.presence(taught)[0], names, landmarks=12, ridge=0.1)
    sets, asked = [plain_places(t) for t in taught], [plain_places(t) for t in TEXTS]
    marks = [sets[i] for name in ("aa", "bb") for i in [k for k, x in enumerate(names) if x == name][:6]]
    gram = np.array([[kernel(x, y) for y in marks] for x in marks])
    values, vectors = np.linalg.eigh(gram)
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    near = lambda rows: np.array([[kernel(x, y) for y in marks] for x in rows]) @ root
    y = np.array([["aa", "bb"].index(x) for x in names])
    weight = np.sqrt(len(y) / (2 * np.bincount(y)))[y][:, None]
    design = np.hstack([near(sets), np.ones((len(y), 1))]) * weight
    penalty = 0.1 * np.eye(design.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.solve(design.T @ design + penalty, design.T @ (np.where(y[:, None] == np.arange(2), 1.0, -1.0) * weight))
    assert np.allclose(model.decisions(filled), near(asked) @ solved[:-1] + solved[-1], atol=2e-3)


def test_rates_equal_plain_projected_gradient(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.6, 0.5, 0.4], 300)
    n = rng.integers(0, 90, 300)
    frame = spark.createDataFrame([(k, int(a), [float(x) for x in b]) for k, (a, b) in enumerate(zip(n, p))], "doc_id long, tokens long, posterior array<double>").repartition(4)
    mix_, reached, wanted = solve_rates(frame, ["a", "b", "c"], {"a": 0.5, "b": 0.3, "c": 0.2})
    target = np.array([0.5, 0.3, 0.2]) * n.sum()
    rate, inverse = np.ones(300), np.linalg.pinv((p * n[:, None]).T @ p, rcond=1e-9)
    for _ in mix_.steps:
        rate = np.maximum(0, rate - p @ (inverse @ ((rate * n) @ p - target)))
    assert len(mix_.steps) > 0 and np.allclose(wanted, target)
    assert np.allclose(mix_.rate(p), rate, atol=1e-6) and np.allclose((rate * n) @ p, reached) and np.allclose(reached, target, rtol=2e-3)
