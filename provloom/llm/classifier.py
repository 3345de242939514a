"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax.

A document's features are its words, the word pairs and triples in it, and the character
n-grams of its words (between word marks), hashed into ``buckets`` rows of a learned table.
The vectors of all occurrences are averaged and a softmax layer gives class probabilities.
Table and layer are trained together by numpy stochastic gradient descent on a bounded
sample of labelled documents (``max_rows`` and ``max_entries``, chosen by hash); scoring
covers whole texts.

After training, bucket vectors times the output layer are per-bucket class logits, so a
document's score is a mean over its words and phrases of numbers that depend on these alone.

Defined cases: null text counts as empty and gets the probabilities of the bias; null or
repeated doc_ids are carried as they are; labels without a class or a document are not
learned from; without any labelled row all classes are as likely; texts of any length are
read whole; an empty table gives no rows; other columns of the input are neither read nor
returned (``keep_rows`` returns the input's own columns).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.llm.blocks import U64, coded_words, crc_bucket, mix, offsets, ragged, release_memory, segment_sums, text_blocks, texts_of, window_hashes, word_hashes
from provloom.storage import Scratch, attach

NGRAMS = (2, 3, 4)
PHRASES = (2, 3)


def phrase_features(hashes: np.ndarray, sizes: np.ndarray, buckets: int):
    """For each length: buckets of the word n-grams, text after text, and how many each text has."""
    first = offsets(sizes)[:-1]
    for n in PHRASES:
        many = np.maximum(sizes - n + 1, 0)
        yield (window_hashes(mix(hashes + U64(n)), n)[ragged(first, many)] % U64(buckets)).astype(np.int64), many


def word_features(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and its n-grams, word after word, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
    ends = np.cumsum(sizes)
    parts, counts = [(word_hashes(words), np.arange(len(words)))], np.ones(len(words), np.int64)
    for n in NGRAMS:
        hashes = window_hashes(mix(chars + U64(n << 32)), n)
        many = np.maximum(sizes - n + 1, 0)
        parts.append((hashes[ragged(ends - sizes, many)], np.repeat(np.arange(len(words)), many)))
        counts += many
    owner = np.concatenate([p[1] for p in parts])
    found = (np.concatenate([p[0] for p in parts]) % U64(buckets)).astype(np.int64)
    return found[np.argsort(owner, kind="stable")], counts


@dataclass
class SubwordModel:
    """``logits[b]`` is bucket b's vector times the output layer; ``bias`` the layer's bias."""

    classes: list
    logits: np.ndarray
    bias: np.ndarray

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        words, codes, sizes = coded_words(texts)
        out = np.repeat(self.bias[None, :], len(texts), 0)
        if len(words):
            per_word, counts = np.zeros((len(words), len(self.bias))), np.zeros(len(words), np.int64)
            for a in range(0, len(words), 10_000):  # a few thousand words' features at a time
                found, counts[a : a + 10_000] = word_features(words[a : a + 10_000], len(self.logits))
                own = counts[a : a + 10_000]
                per_word[a : a + 10_000] = np.add.reduceat(self.logits[found].astype(np.float64), np.cumsum(own) - own, 0)
            n, total = segment_sums(counts[codes], sizes), np.stack([segment_sums(per_word[codes, k], sizes) for k in range(per_word.shape[1])], 1)
            for found, many in phrase_features(word_hashes(words)[codes], sizes, len(self.logits)):
                n += many
                for k in range(per_word.shape[1]):
                    total[:, k] += segment_sums(self.logits[found, k].astype(np.float64), many)
            out += total / np.maximum(n, 1)[:, None]
        out -= out.max(1, keepdims=True)
        out = np.exp(out)
        return out / out.sum(1, keepdims=True)


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], classes: list, buckets: int, *, dim: int = 16, epochs: int = 15, rate: float = 1.5, seed: int = 7) -> SubwordModel:
    """samples: (class number, distinct buckets, weights summing to 1) of each document."""
    rng, n = np.random.default_rng(seed), len(classes)
    table = (rng.random((buckets, dim), np.float32) - 0.5) / dim
    layer = np.zeros((dim, n), np.float32)
    seen = np.bincount([y for y, _, _ in samples], minlength=n) + 1.0
    bias = np.log(seen / seen.sum()).astype(np.float32)
    steps, done = max(1, epochs * len(samples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            y, at, weight = samples[i]
            rows = table[at]
            mean = weight @ rows
            p = mean @ layer + bias
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - done / steps)
            to_rows = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            table[at] = rows - (step * len(at) ** 0.5) * np.outer(weight, to_rows)
            done += 1
    return SubwordModel(list(classes), (table @ layer).astype(np.float32), bias.astype(np.float64))


def features(texts: pa.Array, buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their weights."""
    words, codes, sizes = coded_words(texts)
    found, counts = word_features(words, buckets) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    starts, first = np.cumsum(counts) - counts, offsets(sizes)
    phrases = [(b, offsets(many)) for b, many in phrase_features(word_hashes(words)[codes] if words else np.zeros(0, U64), sizes, buckets)]
    rows = []
    for i in range(len(sizes)):
        own = codes[first[i] : first[i + 1]]
        parts = [found[ragged(starts[own], counts[own])], *[b[cut[i] : cut[i + 1]] for b, cut in phrases]]
        at, n = np.unique(np.concatenate(parts), return_counts=True)
        rows.append((at.astype("<u4"), (n / max(1, n.sum())).astype("<f4")))
    return rows


def _features_of(buckets: int):
    def run(batches):
        for batch in text_blocks(batches):
            rows = features(texts_of(batch), buckets)
            packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in zip(*rows)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("doc_id"), pa.array([len(at) for at, _ in rows], pa.int64()), *packed], names=["label", "doc_id", "n", "at", "weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, *, may_learn: Column | None = None, max_rows: int = 3000, max_entries: int = 12_000_000, buckets: int = 1 << 18, **training) -> SubwordModel:
    """Learn ``label`` of the table ``labels`` from at most ``max_rows`` of its documents.

    The rows are those of least hash among the labels that have a document and that
    ``may_learn`` (over doc_id) admits, as long as their features number ``max_entries``
    at most; their features, not their texts, come to the driver.  The sampled labels are
    broadcast: they have ``max_rows`` rows at most.
    """
    scratch = Scratch(docs.sparkSession, "classifier")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).dropna()
    if may_learn is not None:
        known = known.where(may_learn)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text", "doc_id").mapInArrow(_features_of(buckets), f"label {dict(chosen.dtypes)['label']}, doc_id long, n long, at binary, weight binary")
    rows = scratch.keep(rows, "features")
    # One document for each doc_id, in the order of the hash, until the features are enough.
    sizes = rows.groupBy("doc_id").agg(F.min("n").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    used = takewhile(lambda x: x[1] <= max_entries, zip(sizes, np.cumsum([r["n"] for r in sizes])))
    ids = docs.sparkSession.createDataFrame([(r["doc_id"],) for r, _ in used], "doc_id long")
    least = list(rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("n", "at", "weight", "label")).alias("row")).select("row.*").toLocalIterator())
    scratch.drop("features")
    least.sort(key=lambda r: (r["label"], bytes(r["at"]), bytes(r["weight"])))
    classes = sorted({r["label"] for r in least})
    number = {c: k for k, c in enumerate(classes)}
    samples = [(number[r["label"]], np.frombuffer(r["at"], "<u4"), np.frombuffer(r["weight"], "<f4")) for r in least]
    model = train(samples, classes, buckets, **training)
    del least, samples
    release_memory()  # the driver lives on after the fit
    return model


def score_quality(docs: DataFrame, model: SubwordModel, *, positive=1, threshold: float = 0.7, held_out: int | None = 2, mod: int = 4) -> DataFrame:
    """doc_id, held_out, score (probability of ``positive``) and predicted of every document."""
    spark = attach(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in text_blocks(batches):
            score = _positive(shared.value, texts_of(batch), positive)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(crc_bucket(batch.column("doc_id"), mod) == held_out), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def _positive(model: SubwordModel, texts: pa.Array, positive) -> np.ndarray:
    if positive not in model.classes:
        return np.full(len(texts), 0.0 if model.classes else 0.5)
    return model.probabilities(texts)[:, model.classes.index(positive)]


def keep_rows(docs: DataFrame, model: SubwordModel, *, positive=1, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``threshold`` or more."""
    spark = attach(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in text_blocks(batches):
            yield batch.filter(pa.array(_positive(shared.value, texts_of(batch), positive) >= threshold))

    return docs.mapInArrow(run, docs.schema)
