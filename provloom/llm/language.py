"""Language identification with string kernels.

Kernel: character n-grams of 1 to 4 letters (words lower-cased, what is between them as
one mark), by presence, each length normalized by the sizes of both sets and the lengths
averaged.  n-grams are hashed into a fixed number of places per length.  A bounded sample
of labelled documents trains it: ``landmarks`` of them span a Nyström map, on whose
features one ridge regression per language is solved.  Since kernel values to landmarks
are products of presence matrices, scoring multiplies a batch's presence matrix by one
matrix (landmarks times regression weights) per length.

Defined cases: null text, or text without a letter, is ``und`` with score 1; with no
labelled document everything is ``und``; ties go to the language first in order; null or
repeated doc_ids are carried as they are; whole texts are read, whatever their length; an
empty table gives no rows; other columns of the input are neither read nor returned
(``keep_rows`` returns the input's own columns).
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provloom.llm.blocks import crc_bucket, text_blocks, texts_of
from provloom.storage import attach

#: Places per n-gram length.
PLACES = {1: 512, 2: 2048, 3: 4096, 4: 4096}
STARTS = dict(zip(PLACES, np.cumsum([0, *PLACES.values()]).tolist()))
WIDTH = sum(PLACES.values())
ROWS = 256
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Which places each text's n-grams fill, and whether it has a letter."""
    # Marks stand for all that is no letter; three between texts keep windows of four apart.
    texts = [t.lower() for t in texts]
    joined = "".join(f"\0\0\0{t}" for t in texts) + "\0\0\0"
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = _letter_table()[chars]
    chars[~letter] = 0
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 3
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)  # of the marks before and the text
    solid = letter[1:] | letter[:-1]  # one mark is enough between words
    out = np.zeros(len(texts) * WIDTH, bool)
    hashes = chars.astype(np.uint32)
    for n, places in PLACES.items():
        if n > 1:
            hashes = hashes[:-1] * np.uint32(0x01000193) + chars[n - 1 :] * np.uint32(n * 2 + 1)
        at = ((hashes * np.uint32(0x9E3779B1)) >> np.uint32(12)) % np.uint32(places)
        m = len(at)
        good = letter.copy() if n == 1 else solid[: len(chars) - 1]
        use = min(m, len(owner))
        keep = good[:use]
        rows = owner[:use][keep].astype(np.int64)
        out[rows * WIDTH + STARTS[n] + at[:use][keep]] = True
    seen = np.zeros(len(texts), bool)
    seen[owner[letter[: len(owner)]]] = True
    return out.reshape(len(texts), WIDTH), seen


def _blocks_of_rows(batches):
    for batch in text_blocks(batches):
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _inverse_norms(filled: np.ndarray) -> np.ndarray:
    """1 / sqrt(n-grams present) per text and length."""
    counts = np.stack([filled[:, STARTS[n] : STARTS[n] + p].sum(1) for n, p in PLACES.items()], 1)
    return 1 / np.sqrt(np.maximum(counts, 1))


@dataclass
class KernelModel:
    languages: list[str]
    weights: np.ndarray  # places x languages: landmark presence times regression weights
    bias: np.ndarray

    def decisions(self, filled: np.ndarray) -> np.ndarray:
        out = np.repeat(self.bias[None, :], len(filled), 0)
        norms = _inverse_norms(filled)
        for k, (n, p) in enumerate(PLACES.items()):
            part = slice(STARTS[n], STARTS[n] + p)
            out += (filled[:, part].astype(np.float32) @ self.weights[part]) * norms[:, [k]]
        return out

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        filled, seen = presence([t or "" for t in texts])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.ones(len(texts))
        f = 4 * self.decisions(filled)
        best = f.argmax(1)
        p = np.exp(f - f.max(1, keepdims=True))
        score = np.where(seen, p.max(1) / p.sum(1), 1.0)
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), seen)], score


def solve(filled: np.ndarray, languages: list[str], landmarks: int, ridge: float) -> KernelModel:
    """Nyström map over the first rows of each language as landmarks, then one-versus-rest ridge regression."""
    names = sorted(set(languages))
    if not names:
        return KernelModel([], np.zeros((WIDTH, 0), np.float32), np.zeros(0))
    scaled = np.zeros(filled.shape, np.float32)
    norms = _inverse_norms(filled) / np.sqrt(len(PLACES))
    for k, (n, p) in enumerate(PLACES.items()):
        part = slice(STARTS[n], STARTS[n] + p)
        scaled[:, part] = filled[:, part] * norms[:, [k]]
    y = np.array([names.index(x) for x in languages])
    each = max(1, landmarks // len(names))
    chosen = np.concatenate([np.flatnonzero(y == k)[:each] for k in range(len(names))])
    marks = scaled[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = (scaled @ marks.T).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = np.sqrt(len(y) / (len(names) * np.bincount(y, minlength=len(names))))[y][:, None]  # languages count alike
    design = np.hstack([features, np.ones((len(y), 1))]) * weight
    penalty = ridge * np.eye(design.shape[1])
    penalty[-1, -1] = 0
    solved = np.linalg.solve(design.T @ design + penalty, design.T @ (target * weight))
    collapsed = marks.T @ (root @ solved[:-1]) / np.sqrt(len(PLACES))
    return KernelModel(names, collapsed.astype(np.float32), solved[-1])


def _sampled_presence(batches):
    for batch in _blocks_of_rows(batches):
        filled, seen = presence([t or "" for t in batch.column("text").to_pylist()])
        packed = [np.packbits(r).tobytes() for r in filled]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(packed, pa.binary()), pa.array(seen)], names=["doc_id", "lang", "filled", "seen"])


def fit(docs: DataFrame, *, may_learn: Column | None = None, rows_per_language: int = 400, max_rows: int = 6_000, landmarks: int = 200, ridge: float = 0.1) -> KernelModel:
    """Learn every value of ``lang``, from about ``rows_per_language`` documents of each at most.

    ``max_rows`` bounds the labelled rows that are learned from: of more languages each gives
    fewer.  A column with more values than that is not one of languages and is refused.  The bounds
    are kept by a hash of doc_id against each language's share; what comes to the driver is one
    row per language, then the sampled documents' packed presence.
    """
    attach(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("doc_id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    if may_learn is not None:
        known = known.where(may_learn)
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    per_language = {r["lang"]: (r["n"], r["first"]) for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.min(hashed).alias("first")).limit(max_rows + 1).collect()}
    if len(per_language) > max_rows:
        raise ValueError(f"lang has more than {max_rows} values")
    rows_per_language = min(rows_per_language, max(1, max_rows // max(1, len(per_language))))
    if not per_language:
        return solve(np.zeros((0, WIDTH), bool), [], landmarks, ridge)
    # Its share of each language, and the first row by hash in any case.
    shares = F.create_map(*[F.lit(v) for name, (n, first) in sorted(per_language.items()) for v in (name, max(min(1.0, rows_per_language / n), first + 2.0**-30))])
    rows = known.where(hashed < shares[F.col("lang")]).mapInArrow(_sampled_presence, "doc_id long, lang string, filled binary, seen boolean").where("seen").collect()
    rows.sort(key=lambda r: (zlib.crc32(f"landmark {r['doc_id']}".encode()), r["doc_id"], r["lang"], bytes(r["filled"])))
    filled = np.array([np.unpackbits(np.frombuffer(r["filled"], np.uint8), count=WIDTH) for r in rows], bool).reshape(len(rows), WIDTH)
    return solve(filled, [r["lang"] for r in rows], landmarks, ridge)


def identify(docs: DataFrame, model: KernelModel, *, held_out: int = 0, mod: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    spark = attach(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in _blocks_of_rows(batches):
            names, score = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(crc_bucket(batch.column("doc_id"), mod) == held_out), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_rows(docs: DataFrame, model: KernelModel, *, least_score: float = 0.4, column: str | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, with a known language of ``least_score`` or more.

    ``column``: where to put the predicted language, in place of what that column held.
    """
    spark = attach(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in _blocks_of_rows(batches):
            names, score = shared.value.predict(texts_of(batch).to_pylist())
            if column is not None:
                batch = batch.set_column(batch.schema.names.index(column), batch.schema.field(column), pa.array(names, batch.schema.field(column).type))
            yield batch.filter(pa.array((score >= least_score) & np.array([n != UNKNOWN for n in names], bool)))

    return docs.mapInArrow(run, docs.schema)
