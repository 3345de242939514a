"""Counts of every prefix against the sentencepiece library's own encodings."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from provloom.llm.piece_counts import PrefixCounter, fitting_characters, longest_prefix, piece_tables, prefix_table, prefix_tokens, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["the", "Thing", "é", " ", "\n", "  ", "'s", "12", "#", "ß", "\t", "ö", "ing", ".", "<s>", "▁", "日本", "🙂", "a", "e", "er", "return", "    ", "\x00", "tion", "(", "==", "é", "ﬁ", "Ａ", " " * 15, " " * 20]
ODD = ["", " ", "  ", "a", "a ", " a ", "\n", "▁▁a", "=" * 70, "a" * 50, " " * 40, " " * 47 + "x", "日本語テキスト", "　", "x" * 3000, "<unk></s>", "\r\n"]


@pytest.fixture(scope="module")
def tables():
    return piece_tables(PATH)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


def made(n, seed, most=30):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_every_prefix_counts_as_the_library_encodes_it(tables, library):
    texts = ODD + made(250, 1)
    counts = PrefixCounter(tables, limit=100).count(pa.array(texts))
    for i, text in enumerate(texts):
        expected = [len(x) for x in library.encode([text[: k + 1] for k in range(len(text))])]
        assert np.cumsum(counts.steps(i), dtype=int).tolist() == expected, text


def test_totals_over_several_batches_with_few_words_remembered(tables, library):
    counter = PrefixCounter(tables, limit=50)
    for seed in range(6):
        texts = made(300, 100 + seed, 60)
        assert counter.count(pa.array(texts)).totals().tolist() == [len(x) for x in library.encode(texts)]


def test_longest_prefix_is_the_last_that_fits(tables, library):
    texts = [t for t in made(40, 9) if t]
    counts = PrefixCounter(tables).count(pa.array(texts))
    for i, text in enumerate(texts):
        sizes = [len(x) for x in library.encode([text[:k] for k in range(len(text) + 1)])]
        for limit in (0, 1, 3, 7, 10_000):
            assert longest_prefix(counts.steps(i), limit) == max(k for k, n in enumerate(sizes) if n <= limit)


def test_table_answers_without_the_texts(spark, library):
    texts = made(20, 3) + [None, ""]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    table = prefix_table(docs, PATH).withColumnRenamed("n_bytes", "ask")
    by_id = {r["doc_id"]: r for r in prefix_tokens(table.selectExpr("doc_id", "steps", "5L ask"), "ask").collect()}
    fits = {r["doc_id"]: r["answer"] for r in fitting_characters(table.selectExpr("doc_id", "steps", "4L budget"), "budget").collect()}
    for k, text in enumerate(texts):
        text = text or ""
        assert by_id[k]["answer"] == len(library.encode(text[:5]))
        assert fits[k] == max(n for n in range(len(text) + 1) if len(library.encode(text[:n])) <= 4)


def test_rows_nulls_repeats_and_limits(spark, library):
    long = "wordé and " * 3000
    rows = [(1, "a b", "p"), (1, "a b", "q"), (None, None, None), (2, "", "r"), (3, long, "s"), (4, None, "t")]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_bytes string"), PATH, limit=50).collect()
    assert [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got] == [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in rows]
    assert [r["over_limit"] for r in got] == [False, False, False, False, True, False]
    cut = long.encode()[: got[4]["fit_bytes"]].decode()
    assert len(library.encode(cut)) <= 50 < len(library.encode(long[: len(cut) + 1]))
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
