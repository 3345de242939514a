"""Bounds of what is learned: unseen words, many languages, small targets."""

import random

import numpy as np
import pytest

from provloom.llm import language
from provloom.llm.blocks import crc_bucket
from provloom.llm.mixing import solve_rates
from provloom.llm.suffix_tree import Root, score_texts


def test_gibberish_scores_below_prose(spark):
    """As many unknown words are no likelier than words of the language, whichever score is asked."""
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    weights = [1 / (k + 1) for k in range(3000)]
    prose = [" ".join(rng.choices(vocabulary, weights, k=200)) for _ in range(120)]
    noise = [" ".join("".join(rng.choice(letters) for _ in range(9)) for _ in range(200)) for _ in range(400)]
    held = (crc_bucket(np.arange(1000, 1400), 7) == 2).nonzero()[0][:20]
    rows = list(enumerate(prose)) + [(1000 + int(k), noise[k]) for k in held]
    got = {r["doc_id"]: r for r in score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    best_noise = max(got[1000 + int(k)]["score"] for k in held)
    worst_prose = min(r["score"] for d, r in got.items() if d < 1000 and r["held_out"])
    assert len(held) == 20 and best_noise < worst_prose - 100


def test_unseen_words_share_their_mass():
    root = Root(tokens=1000, distinct=300, once=200, twice=49)
    assert root.unseen_words() == 200 * 199 / 100 and root.word(np.array([0.0]))[0] == pytest.approx(0.2 / 398)
    assert root.word(np.array([0.0]))[0] < root.word(np.array([1.0]))[0]
    assert Root().word(np.array([0.0]))[0] == 0.5


def test_every_language_is_learned_or_the_column_refused(spark):
    rng = random.Random(2)
    tongues = {f"l{k:03d}": "".join(chr(0x4E00 + 40 * k + j) for j in range(12)) for k in range(300)}
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(30)), name, "x") for i, (name, a) in enumerate(list(tongues.items()) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = language.fit(docs, max_rows=600, landmarks=300)
    assert model.languages == sorted(tongues)
    got = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("lang_pred = lang").count()
    assert got > 0.8 * len(rows)
    with pytest.raises(ValueError, match="more than 299"):
        language.fit(docs, max_rows=299)


def test_small_targets_are_met_as_closely_as_large_ones(spark):
    rng = np.random.default_rng(7)
    p = rng.dirichlet([8, 0.5, 0.2], 4000)
    n = rng.integers(10, 90, 4000)
    frame = spark.createDataFrame([(k, int(a), b.tolist()) for k, (a, b) in enumerate(zip(n, p))], "doc_id long, tokens long, posterior array<double>").repartition(4)
    for weights in ({"a": 0.93, "b": 0.06, "c": 0.01}, {"a": 0.9, "b": 0.07, "c": 0.03}):
        _, reached, wanted = solve_rates(frame, ["a", "b", "c"], weights)
        assert (np.abs(reached - wanted) <= 1e-3 * wanted).all(), (weights, reached, wanted)
