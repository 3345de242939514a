"""Remembered pieces must give the ids that the library gives for whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from provloom.llm.tokens import TextEncoder

ODD = ["", " ", "\n", "a  b", " a", "a ", "x\n\ny", "\nx", "x\n", "a \n b", "naïve café's", "İstanbul", "éa", "<|endoftext|> x", "a  <|endoftext|>",
       "日本語 text", "tab\tbed", "nb sp", "it's I'LL 12 345 a1b2", "### $$$ %%%", "ª² x_y-z", "a\u0085b", "x" * 3000, "end.\nStart here.", "🙂 ok", "'s 's'd", "a\x1cb c"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_same_ids_as_the_library(name):
    path, rng = public_tokenizers.path(name), random.Random(3)
    alphabet = ["the", "Thing", "é", " ", "\n", "  ", "'s", "12", "#", "ß", "\t", "ö", "ing", "Ñ", ".", "<|"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(800)]
    texts += [" ".join(rng.choice(["thorre", "Thing,", "ééle", "ander\nOver", "it's", "42"]) for _ in range(40)) for _ in range(200)]
    own = TextEncoder(path, limit=50)
    ids, sizes = own.encode(pa.array(texts))
    expected = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(e) for e in expected]
    got = np.split(ids, np.cumsum(sizes)[:-1])
    bad = [(t, g.tolist(), e) for t, g, e in zip(texts, got, expected) if g.tolist() != e]
    assert not bad, bad[:3]


def test_no_texts():
    own = TextEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, sizes = own.encode(pa.array([], pa.string()))
    assert len(ids) == 0 and len(sizes) == 0
