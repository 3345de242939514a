"""Mixing documents to target weights with soft domain membership.

A classifier learned from a labelled table gives every document a posterior over domains.
Document d with n_d tokens and rate r_d adds r_d * n_d * p_dk tokens to domain k.  Rates
start at 1 and follow projected gradient steps on the generalized least squares of the
domain totals against their targets, in the metric that weighs a document by its tokens;
a step adds up a few numbers per domain over all documents and sends them to the driver.
A document's rate follows from its posterior and the list of steps alone, so rates need
neither be stored between steps nor joined back.

Defined cases: null text is empty, has no tokens and the posterior of the classifier's
bias; null or repeated doc_ids are carried row by row; domains without a labelled document
are left out of the targets, the rest keep their proportions; without any, or without
tokens, all rates are 1; an empty table gives no rows; other columns of the input are
neither read nor returned by ``mixing_rates`` and all returned by ``resample``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.blocks import split_words, text_blocks, texts_of
from provloom.llm.classifier import SubwordModel
from provloom.storage import Scratch


@dataclass
class Mix:
    """Steps found: ``rate`` folds them, with the projection after each."""

    domains: list[str]
    steps: list[np.ndarray]

    def rate(self, posterior: np.ndarray) -> np.ndarray:
        out = np.ones(len(posterior))
        for step in self.steps:
            out = np.maximum(0.0, out - posterior @ step)
        return out


def _posteriors(shared):
    def run(batches):
        for batch in text_blocks(batches):
            texts = texts_of(batch)
            p = shared.value.probabilities(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(split_words(texts)[1]), pa.array(p.tolist(), pa.list_(pa.float64()))], names=["doc_id", "tokens", "posterior"])

    return run


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("posterior").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _sums(posteriors: DataFrame, make) -> np.ndarray:
    """Sum over all documents of a small array that ``make`` computes from a batch."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = make(batch.column("tokens").to_numpy(zero_copy_only=False).astype(float), _matrix(batch)).ravel()
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["k", "value"])

    rows = posteriors.select("tokens", "posterior").mapInArrow(run, "k long, value double").groupBy("k").agg(F.sum("value").alias("value")).orderBy("k").collect()
    return np.array([r["value"] for r in rows])


def solve_rates(posteriors: DataFrame, domains: list[str], weights: dict[str, float], *, anchor: str | None = None, tolerance: float = 1e-3, max_steps: int = 60) -> tuple[Mix, np.ndarray, np.ndarray]:
    """The mix, the domain totals it reaches and their targets.

    Targets share out all tokens by ``weights``; with ``anchor`` they are scaled so that
    this domain's target is what it has at rate 1.
    """
    mix = Mix(domains, [])
    start = _sums(posteriors, lambda n, p: n @ p)
    share = np.array([weights.get(d, 0.0) for d in domains])
    if not domains or not len(start) or start.sum() == 0 or share.sum() == 0:
        return mix, start, start
    whole = start[domains.index(anchor)] / share[domains.index(anchor)] if anchor in domains and share[domains.index(anchor)] else start.sum() / share.sum()
    target = share * whole
    gram = _sums(posteriors, lambda n, p: (p * n[:, None]).T @ p).reshape(len(domains), -1)
    metric = np.linalg.pinv(gram, rcond=1e-9)
    scale = np.where(target > 0, target, max(target.max(), 1.0))  # each domain's own target
    off = lambda totals: (np.abs(totals - target) / scale).max()
    reached, best = start, (off(start), 0, start)
    while off(reached) > tolerance and len(mix.steps) < min(max_steps, best[1] + 6):
        mix.steps.append(metric @ (reached - target))
        reached = _sums(posteriors, lambda n, p: (mix.rate(p) * n) @ p)
        best = min(best, (off(reached), len(mix.steps), reached), key=lambda b: b[:2])
    del mix.steps[best[1] :]  # targets out of reach: where the totals came nearest
    return mix, best[2], target


class Mixed(NamedTuple):
    """Rates of all documents, and each domain's total as it was wanted and as it is reached."""

    rates: DataFrame
    mix: Mix
    wanted: np.ndarray
    reached: np.ndarray


def mix_documents(docs: DataFrame, model: SubwordModel, weights: dict[str, float], **solving) -> Mixed:
    """Rates: doc_id, tokens, posterior (in the order of the model's classes), rate and copies."""
    posteriors, mix, reached, wanted = _solve(docs, model, weights, **solving)

    def run(batches):
        for batch in batches:
            rate = mix.rate(_matrix(batch)) if mix.domains else np.ones(batch.num_rows)
            copies = copies_of(batch.column("doc_id").to_pylist(), rate)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate), pa.array(copies)], names=[*batch.schema.names, "rate", "copies"])

    rates = posteriors.mapInArrow(run, "doc_id long, tokens long, posterior array<double>, rate double, copies long")
    return Mixed(rates, mix, wanted, reached)


def mixing_rates(docs: DataFrame, model: SubwordModel, weights: dict[str, float], **solving) -> DataFrame:
    """The rates of ``mix_documents``."""
    return mix_documents(docs, model, weights, **solving).rates


def _solve(docs: DataFrame, model: SubwordModel, weights: dict[str, float], **solving) -> tuple[DataFrame, Mix, np.ndarray, np.ndarray]:
    scratch = Scratch(docs.sparkSession, "mixing")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    posteriors = scratch.keep(plain.mapInArrow(_posteriors(shared), "doc_id long, tokens long, posterior array<double>"), "posteriors")
    return posteriors, *solve_rates(posteriors, model.classes, weights, **solving)


def copies_of(doc_ids: list, rate: np.ndarray) -> np.ndarray:
    """Whole copies whose mean is the rate; the fraction is drawn from a hash of doc_id."""
    draw = np.array([zlib.crc32(f"mix {d}".encode()) / 2.0**32 for d in doc_ids])
    return np.floor(rate + 1 - draw - 1e-12).astype(np.int64)


def resample(docs: DataFrame, model: SubwordModel, weights: dict[str, float], **solving) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its rate says."""
    _, mix, _, _ = _solve(docs, model, weights, **solving)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in text_blocks(batches):
            rate = mix.rate(shared.value.probabilities(texts_of(batch))) if mix.domains else np.ones(batch.num_rows)
            copies = copies_of(batch.column("doc_id").to_pylist(), rate)
            at = np.repeat(np.arange(batch.num_rows), copies)
            for k in range(0, len(at), 4096):
                yield batch.take(pa.array(at[k : k + 4096]))

    return docs.mapInArrow(run, docs.schema)
