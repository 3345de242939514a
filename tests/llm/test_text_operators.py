"""Each operator against a plain Python version, and on nulls, ties, repeats and empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provloom.llm import classifier, language
from provloom.llm.embeddings import near_vectors
from provloom.llm.mixing import mixing_rates, resample
from provloom.llm.packing import pack_documents
from provloom.llm.rules import QualityRule, cascade, estimate_rules
from provloom.llm.suffix_tree import score_texts
from provloom.llm.token_files import pack_ids, read_token_files, token_digests, unpack_ids, write_token_files
from provloom.llm.urls import Rule, judge_urls, judge_urls_by_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(11)
EN = "the and of to in is that it was for on with as be at by this have from or one had not but what all were when we there can an your which".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split()
ODD = [None, "", "  \n\t", "x", "#### ####", "日本語 テキスト", "Ünï cödé " * 3, "a\nb\na\nb\n", "word " * 5000]


def prose(words, n):
    return " ".join(RNG.choice(words) + RNG.choice(["", "", "", ","]) for _ in range(n))


def corpus():
    texts = [prose(EN, RNG.randint(5, 90)) for _ in range(60)] + [prose(DE, RNG.randint(5, 90)) for _ in range(40)] + ODD
    return [(3 * k - 20, t) for k, t in enumerate(texts)] + [(10_001, "twice the same row"), (10_001, "twice the same row"), (None, "no id")]


ROWS = corpus()


def docs_of(spark, rows=None):
    frame = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string")
    lang = F.when(F.col("text").rlike("der|und|von"), "de").when(F.col("text").rlike("the|and|of"), "en")
    return frame.withColumn("lang", lang).withColumn("score", F.lit("clash")).withColumn("n_words", F.lit("clash")).repartition(3)


def empty(spark):
    return docs_of(spark).where("false")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def held(doc_id, mod):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % mod


# Token files


def test_variable_length_ids_round_trip():
    values = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1] * 5 + [7], np.uint32)
    for n in (0, 1, 3, 4, 5, len(values)):
        raw = pack_ids(values[:n])
        assert unpack_ids(raw, n).tolist() == values[:n].tolist()


def test_token_files(spark, tmp_path):
    path, file = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/ids"
    write_token_files(docs_of(spark), file, path)
    tokenizer = Tokenizer.from_file(path)
    expected, start = [], 0
    for doc_id, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        expected.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4"))))
        start += len(ids)
    assert sorted(map(tuple, token_digests(spark, file).collect()), key=lambda r: r[1]) == expected
    assert {r["doc_id"]: len(r["ids"]) for r in read_token_files(spark, file).collect()} == {d: n for d, _, n, _ in expected}
    write_token_files(empty(spark), f"{file}-none", path)
    assert token_digests(spark, f"{file}-none").collect() == []


# Packing


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = list(ROWS) + [(9000 + k, prose(EN, RNG.randint(1, 1500))) for k in range(60)]
    got = [r.asDict() for r in pack_documents(docs_of(spark, rows), path, open_windows=4).collect()]
    tokenizer, ids = Tokenizer.from_file(path), {}
    for doc_id, text in rows:
        ids[doc_id] = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
    copies = Counter(d for d, _ in rows)
    pieces = {}
    for p in got:
        assert p["doc_tokens"] == len(ids[p["doc_id"]]) and zlib.crc32(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]) == p["ids_crc32"]
        pieces.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for doc_id, n in copies.items():
        assert Counter(i for s, k in pieces[doc_id] for i in range(s, s + k)) == {i: n for i in range(len(ids[doc_id]))}
    fill = {}
    for p in sorted(got, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == fill.get(p["sequence_id"], 0)
        fill[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(fill.values()) <= 1024 and sum(1024 - f for f in fill.values()) < 0.06 * sum(fill.values())
    assert pack_documents(empty(spark), path).collect() == []


# URLs


@pytest.mark.parametrize("judge", ["trie", "join"])
def test_urls(spark, judge):
    rules = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "a.org", "/fr/x")]
    urls = [None, "", "no scheme", "http://", "http://x.NET", "http://X.net/", "https://m.example.net/en/1?q#f", "http://example.net/en", "http://notexample.net/en/1", "http://example.com/de/9", "http://example.com/dex",
            "http://b.a.org/fr/xyz", "http://a.org/fr/", "x://net/y", "http://net?/en/", "http://example.com#/de/", "ftp://u:p@example.com:80/de/", "http://.net/", "a://b://c.net/en/"]
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(None, "http://x.net/a"), (3, "http://")], "page_id long, url string").withColumn("verdict", F.lit(0))
    got = by_id(judge_urls(frame, rules) if judge == "trie" else judge_urls_by_join(frame, spark.createDataFrame(rules, "verdict string, host string, path string")))

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.text), default=None)
        return host, path, best and best.text, best.verdict if best else "allow"

    expected = [(k, *brute(u)) for k, u in enumerate(urls)] + [(None, *brute("http://x.net/a")), (3, *brute("http://"))]
    assert got == sorted(expected, key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    assert judge_urls(frame.where("false"), rules).collect() == []


def test_rules_of_equal_length_and_equal_rules(spark):
    rules = [Rule("allow", "z.org", "/ab"), Rule("block", "org", "/abcd"), Rule("block", "b.com", "/x"), Rule("allow", "b.com", "/x"), Rule("allow", "c.com", "/y"), Rule("block", "c.com", "/y"), Rule("block", "", "/any"), Rule("allow", "d.com", "")]
    urls = ["http://z.org/abcd/e", "http://a.b.com/xy", "http://c.com/y/", "http://q.q/anything", "http://d.com", "http://e.d.com/any", "http://z.org/ab/" + "long/" * 3000]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    expected = [("z.org/ab", "allow"), ("b.com/x", "block"), ("c.com/y", "block"), ("/any", "block"), ("d.com", "allow"), ("d.com", "allow"), ("z.org/ab", "allow")]
    for order in (rules, rules[::-1]):
        for judged in (judge_urls(frame, order), judge_urls_by_join(frame, spark.createDataFrame(order, "verdict string, host string, path string"))):
            assert [(r["rule"], r["verdict"]) for r in judged.orderBy("page_id").collect()] == expected


# Quality rules


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), failed


def test_quality_rules(spark):
    rows = list(ROWS) + [(900, "LOUD WORDS " * 15), (901, " ".join(f"w{k}|" for k in range(40))), (902, prose(EN, 60)), (903, " ".join(w for k in range(30) for w in [f"u{k}"] * 3))]
    got = {r["doc_id"]: r for r in cascade(docs_of(spark, rows)).collect()}
    for doc_id, text in rows:
        r = got[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == measures(text), text
        assert not (r["base_failed"] and r["kept"])
    assert [got[k]["kept"] for k in (900, 901, 902, 903)] == [False, False, True, False]
    assert cascade(empty(spark)).collect() == []


def test_rules_are_ordered_by_rejection_per_cost(spark):
    import time

    def slow(texts):
        time.sleep(0.02)
        return np.ones(len(texts), bool)

    rules = [QualityRule("never", lambda t: np.zeros(len(t), bool)), QualityRule("slow", slow), QualityRule("fast", lambda t: np.ones(len(t), bool))]
    assert [name for name, _, _ in estimate_rules(docs_of(spark), rules)] == ["fast", "slow", "never"]


# Classifiers


def test_quality_classifier_on_held_out_rows(spark):
    rows = [(k, prose(EN, 40) if k % 2 else " ".join(w + "###" for w in prose(EN, 40).split())) for k in range(300)]
    docs = docs_of(spark, rows + [(1000, None), (1001, ""), (None, "the and of")])
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(1, 1), (5000, 0), (None, 1), (4, None)], "doc_id long, quality int")
    model = classifier.fit(docs, labels, "quality", may_learn=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    got = {r["doc_id"]: r for r in classifier.score_quality(docs, model).collect()}
    out = [k for k in range(300) if held(k, 4) == 2]
    assert all(got[k]["held_out"] for k in out) and sum(got[k]["predicted"] == k % 2 for k in out) >= 0.97 * len(out)
    assert got[1000]["score"] == got[1001]["score"] and 0 <= got[1000]["score"] <= 1 and got[None]["held_out"] is False
    assert classifier.score_quality(empty(spark), model).collect() == []
    kept = classifier.keep_rows(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["predicted"]}
    nothing = classifier.fit(docs, labels.where("false"), "quality")
    assert {r["score"] for r in classifier.score_quality(docs, nothing).collect()} == {0.5}


def test_language_id_on_held_out_rows(spark):
    docs = docs_of(spark)
    model = language.fit(docs, may_learn=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    known = {r["doc_id"]: r["lang"] for r in docs.collect() if r["lang"] and r["doc_id"] is not None}
    out = [k for k in known if held(k, 5) == 0]
    assert out and all(got[k]["held_out"] for k in out)
    assert sum(got[k]["lang_pred"] == known[k] for k in out) >= 0.95 * len(out)
    for doc_id, text in ROWS:
        assert (got[doc_id]["lang_pred"] == "und") == (not any(c.isalpha() for c in text or "")) and 0 <= got[doc_id]["score"] <= 1
    assert language.identify(empty(spark), model).collect() == []
    none = language.fit(docs.where("false"))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.keep_rows(docs, model).columns == docs.columns


# Language model


def test_lm_scores(spark):
    low = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [None]
    rows = list(ROWS)
    counts = Counter(w for d, t in rows if held(d, 7) not in (2, None) for w in low(t))
    total, distinct = sum(counts.values()), len(counts)
    got = score_texts(docs_of(spark), min_gain=2.0).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r for r in got}
    for doc_id, text in rows:
        r, words = found[doc_id], low(text)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words)
        assert r["base_score"] == pytest.approx(base) and r["n_tokens"] == len(words) and r["train_tokens"] == total
        assert r["n_known"] == sum(counts[w] > 0 for w in words) and r["held_out"] == (held(doc_id, 7) == 2) and r["score"] <= 0
    assert score_texts(empty(spark)).collect() == []


def test_suffix_tree_learns_contexts(spark):
    rows = [(k, " ".join(["red", "rose", "blue", "sky"] * 20)) for k in range(60)]
    got = [r for r in score_texts(docs_of(spark, rows)).collect() if r["held_out"]]
    assert got and all(r["score"] > r["base_score"] / 4 for r in got)


def test_words_and_contexts_of_a_share_of_3e_5_are_learned(spark):
    """Of 200,000 tokens, six are "qx", each before "zz"; "yy" is as frequent and never follows it."""
    rng = random.Random(3)
    learned = [k for k in range(100) if held(k, 7) != 2][:50]
    texts = [[rng.choice(EN) for _ in range(4000)] for _ in learned]
    for k in range(6):
        texts[k][100:102], texts[k][200] = ["qx", "zz"], "yy"
    asked = [k for k in range(1000, 1100) if held(k, 7) == 2][:2]
    rows = [(k, " ".join(t)) for k, t in zip(learned, texts)] + [(asked[0], "the qx zz"), (asked[1], "the qx yy")]
    got = {r["doc_id"]: r["score"] for r in score_texts(docs_of(spark, rows)).collect()}
    assert got[asked[0]] > got[asked[1]] + 1


def plain_tree(rows, depth, min_count, min_gain, weight):
    """(learned text symbols -> score of any text), counted with dicts of tuples."""
    low = lambda t: ["<"] + WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + [">"]
    learned = [low(t) for d, t in rows if held(d, 7) not in (2, None)]
    grams = Counter(tuple(s[i - n + 1 : i + 1]) for s in learned for i in range(len(s)) for n in range(1, depth + 2) if i - n + 1 >= 0)
    words = {g[0]: n for g, n in grams.items() if len(g) == 1 and g[0] != "<"}
    total, distinct, once = sum(words.values()), len(words), sum(n == 1 for n in words.values())
    twice = sum(n == 2 for n in words.values())
    unseen = min(0.5, max(once, 1) / max(total, 2)) / max(1, once * (once - 1) / (2 * (twice + 1)))
    mass = min(0.5, max(once, 1) / max(total, 2))
    root = lambda w: (1 - mass) * (words[w] + 1) / (total + distinct) if w in words else unseen
    states = set()

    def probability(s, i, longest):
        p = root(s[i])
        for d in range(1, longest + 1):
            context = tuple(s[i - d : i])
            if i - d >= 0 and context in states:
                p = (grams[context + (s[i],)] + weight * p) / (grams[context] + weight)
        return p

    for d in range(1, depth + 1):
        gain = Counter()
        for s in learned:
            for i in range(max(1, d), len(s)):
                context = tuple(s[i - d : i])
                if grams[context] >= min_count and not (d > 1 and grams[context] == grams[context[1:]]):
                    p = probability(s, i, d - 1)
                    gain[context] += math.log((grams[context + (s[i],)] - 1 + weight * p) / (grams[context] - 1 + weight) / p)
        states |= {c for c, g in gain.items() if round(g * 16) >= min_gain * 16}
    return lambda t: sum(math.log10(probability(low(t), i, depth)) for i in range(1, len(low(t)))), states


def test_lm_scores_equal_a_plain_tree(spark):
    rng = random.Random(6)
    phrases = [[rng.choice(EN) for _ in range(5)] for _ in range(12)]
    texts = [" ".join(w for _ in range(rng.randint(0, 12)) for w in (rng.choice(phrases) if rng.random() < 0.6 else [rng.choice(DE)])) for _ in range(90)]
    rows = list(enumerate(texts)) + [(500, None), (501, "Never Seen words"), (None, texts[0])]
    score, states = plain_tree(rows, 3, 3, 1.5, 2.0)
    assert {len(c) for c in states} == {1, 2, 3}
    got = score_texts(docs_of(spark, rows).coalesce(1), depth=3, min_count=3, min_gain=1.5, weight=2.0).collect()
    for r in got:
        assert r["score"] == pytest.approx(score(dict(rows)[r["doc_id"]]), abs=1e-6)


# Vectors


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        rows += [(c % 3, (centre + 0.12 * rng.standard_normal(16)).tolist()) for _ in range(rng.integers(1, 9))]
    rows += [rows[3]] * 6 + [(None, rows[0][1]), (1, None), (1, [0.0] * 16), (1, [float("nan")] * 16), (1, [1.0, None] + [0.0] * 14), (1, [1.0, 2.0]), (1, [2.0, 4.0]), (1, [float("inf")] * 16), (1, [])]
    frame = spark.createDataFrame([(5 * k + 2, lab, v) for k, (lab, v) in enumerate(rows)], "vec_id long, label int, embedding array<double>").withColumn("kept", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame, bits=4, tables=24, block=6).collect()}
    ids = [5 * k + 2 for k in range(len(rows))]
    good = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and lab is not None for lab, v in rows]
    link = {i: set() for i in ids}
    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and rows[a][0] == rows[b][0] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1]), np.array(rows[b][1])
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                    link[ids[a]].add(ids[b])
                    link[ids[b]].add(ids[a])

    def least(i):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return min(seen)

    assert got == {i: (len(link[i]), least(i), least(i) == i) for i in ids}
    assert near_vectors(frame.where("false")).collect() == []


# Mixing


def test_mixing(spark):
    rows = [(k, prose(EN if k % 3 else DE, 50)) for k in range(240)] + [(900, None), (None, "the and")]
    docs = docs_of(spark, rows)
    labels = spark.createDataFrame([(k, "en" if k % 3 else "de") for k in range(240)], "doc_id long, domain string")
    model = classifier.fit(docs, labels, "domain", epochs=10, rate=1.5)
    got = mixing_rates(docs, model, {"en": 0.5, "de": 0.5, "never seen": 3.0}).collect()
    totals = sum(np.array(r["posterior"]) * r["tokens"] * r["rate"] for r in got)
    assert len(got) == len(rows) and min(r["rate"] for r in got) >= 0
    assert totals == pytest.approx([sum(r["tokens"] for r in got) / 2] * 2, rel=0.01)
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in got)
    drawn = resample(docs, model, {"en": 0.5, "de": 0.5})
    assert drawn.columns == docs.columns and drawn.count() == sum(r["copies"] for r in mixing_rates(docs, model, {"en": 0.5, "de": 0.5}).collect())
    assert mixing_rates(empty(spark), model, {"en": 1.0}).collect() == []
