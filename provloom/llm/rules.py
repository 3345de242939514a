"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds a text) and selectivity (share of texts rejected) are estimated
on a sample of the texts that the base measures pass, since only those meet the rules; the
cascade then runs the rules by rejection per cost, each on the texts that all rules before
it have passed.  The verdict is that of all rules, whatever their order.  What is measured
once (``Measures``) is not measured again by a later rule.

Defined cases: null text counts as empty and fails; null, repeated or tied doc_ids are
carried as they are; texts of any length are measured whole; an empty table gives no rows;
other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.blocks import mix, offsets, segment_sums, text_blocks, texts_of, window_hashes, coded_words, U64
from provloom.storage import attach

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def _class(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


SYMBOLS = _class(b"#*$%&|<>")
UPPER = _class(bytes(range(65, 91)))
ASCII_LETTERS = _class(bytes(range(65, 91)) + bytes(range(97, 123)))
WORDLIKE = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the number of bytes of each."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), sizes
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
    return np.frombuffer(texts.buffers()[2], np.uint8, int(sizes.sum()), int(first)), sizes


def count_in(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Bytes of each text that are in a class."""
    data, sizes = text_bytes(texts)
    return segment_sums(table[data].astype(np.int32), sizes).astype(np.int64)


def word_starts(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    space = SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = space[:-1]
    first[offsets(sizes)[:-1][sizes > 0]] = True
    return first & ~space


def count_words(texts: pa.Array) -> np.ndarray:
    data, sizes = text_bytes(texts)
    return segment_sums(word_starts(data, sizes).astype(np.int32), sizes).astype(np.int64)


def line_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, of each text."""
    lists = pc.split_pattern(texts, "\n")
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    if not len(flat):
        return np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    full = count_words(flat) > 0
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)[full]
    distinct = np.unique(owner * (codes.max() + 1) + codes[full]) // (codes.max() + 1)
    lines = np.bincount(owner, minlength=len(sizes))
    return lines, lines - np.bincount(distinct, minlength=len(sizes))


def repeated_words(codes: np.ndarray, sizes: np.ndarray, width: int = 8) -> np.ndarray:
    """Words of each text inside a window of ``width`` words that the text holds twice or more."""
    hashes = window_hashes(mix(codes.astype(U64) + U64(1)), width)
    covered = np.zeros(len(codes) + 1, np.int32)
    if len(hashes):
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.flatnonzero(owner[: len(hashes)] == owner[width - 1 :])
        keys = hashes[inside] ^ mix(owner[inside].astype(U64) + U64(1))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + width, -1)
    return segment_sums((np.cumsum(covered[:-1]) > 0).astype(np.int64), sizes)


class Measures:
    """Texts with what is known of them; each measure is taken when it is first asked for."""

    def __init__(self, texts: pa.Array, known: dict[str, np.ndarray] | None = None):
        self.texts, self.known = texts, known or {}

    def __len__(self) -> int:
        return len(self.texts)

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known |= MEASURES[name](self.texts)
        return self.known[name]

    def take(self, at: np.ndarray) -> Measures:
        return Measures(self.texts.take(pa.array(at)), {name: values[at] for name, values in self.known.items()})


def _sizes(texts: pa.Array) -> dict[str, np.ndarray]:
    data, sizes = text_bytes(texts)
    chars = (~SPACE[data] & ((data & 0xC0) != 0x80)).astype(np.int32)
    return {
        "n_words": segment_sums(word_starts(data, sizes).astype(np.int32), sizes).astype(np.int64),
        "word_chars": segment_sums(chars, sizes).astype(np.int64),
        "n_symbols": segment_sums(SYMBOLS[data].astype(np.int32), sizes).astype(np.int64),
    }


def _lines(texts: pa.Array) -> dict[str, np.ndarray]:
    lines, again = line_counts(texts)
    return {"n_lines": lines, "n_dup_lines": again}


def _repeats(texts: pa.Array) -> dict[str, np.ndarray]:
    """Also how many words equal the word before them."""
    _, codes, sizes = coded_words(texts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    same = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    return {"n_repeat_words": repeated_words(codes, sizes), "n_again": np.bincount(owner[1:][same], minlength=len(sizes))}


def _letters(texts: pa.Array) -> dict[str, np.ndarray]:
    return {"n_upper": count_in(texts, UPPER), "n_letters": count_in(texts, ASCII_LETTERS)}


def _letterless_words(texts: pa.Array) -> dict[str, np.ndarray]:
    """Words that have neither a letter nor a byte beyond ASCII."""
    data, sizes = text_bytes(texts)
    starts = word_starts(data, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    words = np.cumsum(starts) - 1
    good = WORDLIKE[data] & ~SPACE[data]
    lettered = np.zeros(int(starts.sum()), bool)
    lettered[words[good]] = True
    total = np.bincount(owner[starts], minlength=len(sizes))
    return {"n_letterless": total - np.bincount(owner[starts], weights=lettered, minlength=len(sizes)).astype(np.int64)}


MEASURES = {
    name: take
    for take, names in ((_sizes, ("n_words", "word_chars", "n_symbols")), (_lines, ("n_lines", "n_dup_lines")), (_repeats, ("n_repeat_words", "n_again")), (_letters, ("n_upper", "n_letters")), (_letterless_words, ("n_letterless",)))
    for name in names
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class QualityRule(NamedTuple):
    """``rejects`` maps measures of texts to a mask; it stands alone, so that the cascade may order it freely."""

    name: str
    rejects: Callable[[Measures], np.ndarray]


RULES = [
    QualityRule("symbols", lambda m: 5 * m["n_symbols"] > m["n_words"]),
    QualityRule("capitals", lambda m: 2 * m["n_upper"] > m["n_letters"]),
    QualityRule("letterless", lambda m: 10 * m["n_letterless"] > 3 * m["n_words"]),
    QualityRule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"])),
    QualityRule("same_lines", lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    QualityRule("stutter", lambda m: 5 * m["n_again"] > m["n_words"]),
]


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Base(NamedTuple):
    """The least words, and the percent of words in repeated windows, of texts that pass."""

    min_words: int = 20
    max_repeat_percent: int = 30

    def fails(self, m: Measures) -> np.ndarray:
        for name in BASE:
            m[name]
        return (m["n_words"] < self.min_words) | (100 * m["n_repeat_words"] > self.max_repeat_percent * m["n_words"])


def estimate_rules(docs: DataFrame, rules: list[QualityRule], sample_rows: int = 2000, base: Base = Base()) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) on the sampled texts that the base passes, by rejection per cost, best first."""
    share = min(1.0, 2.0 * sample_rows / max(1, docs.select("doc_id").count()))

    def run(batches):
        for batch in text_blocks(batches):
            all_texts = Measures(texts_of(batch))
            met = all_texts.take(np.flatnonzero(~base.fails(all_texts)))
            if not len(met):
                continue
            for k, rule in enumerate(rules):
                began = time.perf_counter()
                lost = int(rule.rejects(Measures(met.texts, dict(met.known))).sum())
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([time.perf_counter() - began]), pa.array([lost], pa.int64()), pa.array([len(met)], pa.int64())], names=["rule", "s", "lost", "n"])

    sample = _plain(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))).limit(sample_rows)
    got = {r["rule"]: r for r in sample.mapInArrow(run, "rule long, s double, lost long, n long").groupBy("rule").agg(F.sum("s").alias("s"), F.sum("lost").alias("lost"), F.sum("n").alias("n")).collect()}
    found = [(rule.name, got[k]["s"] / got[k]["n"], got[k]["lost"] / got[k]["n"]) if k in got else (rule.name, 1.0, 0.0) for k, rule in enumerate(rules)]
    return sorted(found, key=lambda x: -x[2] / max(x[1], 1e-9))


def cascade(docs: DataFrame, rules: list[QualityRule] | None = None, *, min_words: int = 20, max_repeat_percent: int = 30, sample_rows: int = 2000) -> DataFrame:
    """Base measures of every document, whether they fail it, and the cascade's verdict.

    Map-only.  ``kept`` is false for documents that the base fails and for those that a
    rule rejects.
    """
    attach(docs.sparkSession)
    rules, base = RULES if rules is None else rules, Base(min_words, max_repeat_percent)
    by_name = {r.name: r for r in rules}
    ordered = [by_name[name] for name, _, _ in estimate_rules(docs, rules, sample_rows, base)]

    def run(batches):
        for batch in text_blocks(batches):
            measures = Measures(texts_of(batch))
            failed = base.fails(measures)
            alive = np.flatnonzero(~failed)
            passed = measures.take(alive)
            for rule in ordered:
                if not len(alive):
                    break
                good = np.flatnonzero(~rule.rejects(passed))
                if len(good) < len(alive):
                    alive, passed = alive[good], passed.take(good)
            kept = np.zeros(len(measures), bool)
            kept[alive] = True
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(measures[name].astype(np.int64)) for name in BASE], pa.array(failed), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "kept"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return _plain(docs).mapInArrow(run, schema)
