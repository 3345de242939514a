"""The join against all pairs compared one by one."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from provloom.llm import ngram_join
from provloom.llm.ngram_join import jaccard_components, keep_firsts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    if text is None:
        return frozenset()
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute_force(rows):
    """(doc_id, set size, least reachable doc_id) of (doc_id, text) rows with distinct ids."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            common = len(x & y) if x and y else 0
            if common and 100 * common >= 75 * (len(x) + len(y) - common):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((d, len(s), find(d)) for d, s in sets)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = [None, "", "  \n", "one", "One", "a b c", "A B c", "a b c d e", "x " * 40]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 80))]
        if rng.random() < 0.4:
            base[rng.randint(0, len(base)) :] = passage + base[:5]
        for _ in range(rng.choice([1, 1, 1, 2, 5, 9])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
                words = words or ["w"]
            texts.append(" ".join(words).upper() if rng.random() < 0.2 else "\n".join(words))
    ids = rng.sample(range(-50, 4000), len(texts))
    return list(zip(ids, texts))


def test_equals_brute_force(spark):
    rows = corpus(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as name", "2 as component_id").repartition(3)
    assert sorted(map(tuple, jaccard_components(docs).collect())) == brute_force(rows)


def test_links_that_no_min_hash_finds(spark):
    """Without keys every set is a group of its own, and opened blocks must find all links."""
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard_components(docs, keys=0).collect())) == brute_force(rows)


def test_empty_and_repeated_rows(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "q")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None), (2, 1, 2)], key=str)


def test_large_cluster_and_common_passage(spark, monkeypatch):
    """Near copies around the bound, and a passage that most of the other texts share."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(500)]
    base, passage = ([rng.choice(vocabulary) for _ in range(n)] for n in (90, 40))
    texts = []
    for _ in range(160):
        words = list(base)
        for at in rng.sample(range(90), rng.randint(0, 3)):
            words[at] = rng.choice(vocabulary)
        texts.append(" ".join(words))
    texts += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(1, 14))]) for _ in range(120)]
    rows = list(zip(rng.sample(range(5000), len(texts)), texts))
    expected = brute_force(rows)
    assert 4 < len({c for _, _, c in expected}) < 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for keys in (0, 1, 6):
        assert sorted(map(tuple, jaccard_components(docs, keys=keys).collect())) == expected


def test_one_row_of_each_group_stays(spark):
    a, b = "a b c d e f g", "q r s t u v w"
    rows = [(1, a, 0), (2, a, 0), (2, b, 0), (3, b, 1), (7, "x y", 0), (7, "x y", 0), (7, "x y", 0), (None, "m n", 5), (None, "m n", 5), (None, "m n", 6), (None, a, 0), (4, None, 0), (4, None, 0), (5, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, later int").withColumns({"Row_1": F.lit(1), "keep": F.lit("k"), "many": F.array(F.lit(1)), "h1": F.create_map(F.lit("a"), F.lit(1)), "a.b": F.lit(2)})
    kept = keep_firsts(frame.repartition(4))
    assert kept.columns == frame.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter([(1, a), (2, b), (7, "x y"), (None, "m n"), (4, None), (4, None), (5, "")])
    assert keep_firsts(frame.where("false")).collect() == []
