"""Token-id files: frequency-ranked ids, byte-aligned, with separate control bytes.

Ids are replaced by their rank of frequency over the whole table, so common ids take one
byte.  A frame holds the ids of consecutive documents: a header, the document ids and
lengths, control bytes (two bits an id: its bytes less one, four ids a byte) and the
ids' bytes.  Frames are rows of a Parquet folder, which any store that Spark reaches can
hold; ``ranks`` beside them maps ranks to ids and is bounded by the vocabulary.

Defined cases: null text is empty and holds its end id only; null doc_ids come first;
repeated doc_ids follow each other in the order of the input's partitions, and may lie in
several of the output's, so that an id of a third of all rows fills no single task; a very
long text is a frame of its own; an empty table gives an empty folder; other columns of
the input are neither read nor written.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provloom.llm.blocks import offsets, ragged, text_blocks, texts_of
from provloom.llm.tokens import encoder
from provloom.storage import Scratch, attach

MAGIC = b"TIDS"
HEADER = struct.Struct("<4sIQQ")  # magic, documents, ids, ids of all documents before
#: Bytes of each of the four ids of a control byte.
LENGTHS = np.array([[1 + (c >> s & 3) for s in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack_ids(values: np.ndarray) -> bytes:
    """Control bytes, then as many bytes of each value as it needs (1 to 4)."""
    v = values.astype("<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    used = np.arange(4) <= extra[:, None]
    return control.tobytes() + v.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack_ids(raw: bytes, n: int) -> np.ndarray:
    """Inverse of ``pack_ids`` for n values; lengths come from the table of control bytes."""
    n_control = -(-n // 4)
    size = LENGTHS[np.frombuffer(raw, np.uint8, n_control)].reshape(-1)[:n].astype(np.int64)
    data = np.frombuffer(raw, np.uint8, int(size.sum()), n_control)
    data = np.append(data, np.zeros(3, np.uint8))
    start = np.cumsum(size) - size
    out = data[start].astype(np.uint32)
    for k in (1, 2, 3):
        at = np.flatnonzero(size > k)
        out[at] |= data[start[at] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def write_frame(doc_ids: list, sizes: np.ndarray, ranks: np.ndarray, start: int) -> bytes:
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    plain = np.array([d or 0 for d in doc_ids], "<i8")
    return HEADER.pack(MAGIC, len(doc_ids), len(ranks), start) + nulls.tobytes() + plain.tobytes() + sizes.astype("<u8").tobytes() + pack_ids(ranks)


def read_frame(raw: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """doc_ids, ids per document, ranks of all ids, and the number of ids before."""
    magic, docs, n, start = HEADER.unpack_from(raw)
    if magic != MAGIC:
        raise ValueError("not a token-id frame")
    at = HEADER.size
    nulls = np.frombuffer(raw, np.uint8, docs, at)
    plain = np.frombuffer(raw, "<i8", docs, at + docs)
    sizes = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
    return [None if e else d for d, e in zip(plain.tolist(), nulls)], sizes, unpack_ids(raw[at + 17 * docs :], n), start


def _tokenize(path: str, end_id: int):
    def run(batches):
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        encode = encoder(path).encode
        for batch in text_blocks(batches):
            ids, sizes = encode(texts_of(batch))
            own = np.full(len(ids) + len(sizes), end_id, np.uint32)
            own[ragged(offsets(sizes + 1)[:-1], sizes)] = ids
            row = [[shard], [block], [before], [len(own)], [batch.column("doc_id").to_pylist()], [(sizes + 1).tolist()], [own.astype("<u2" if own.max() < 65536 else "<u4").tobytes()]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["shard", "block", "before", "n", "doc_ids", "sizes", "ids"])
            block, before = block + 1, before + len(own)

    return run


def _plain_ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw, n in zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist()):
            own = np.bincount(_plain_ids(raw, n))
            if len(own) > len(total):
                own, total = total, own.astype(np.int64)
            total[: len(own)] += own
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["token_id", "n"])


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, end_id: int = 1) -> None:
    """Write every document's ids, each followed by ``end_id``, in ascending doc_id order.

    One range shuffle of the texts puts them in order; they are tokenized once into an
    intermediate table, from which the counts and then the frames are made.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "token-ids")
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = ordered.mapInArrow(_tokenize(tokenizer_path, end_id), "shard long, block long, before long, n long, doc_ids array<long>, sizes array<long>, ids binary")
    blocks = scratch.keep(blocks, "plain", codec="zstd")
    counts = blocks.select("ids", "n").mapInArrow(_count, "token_id long, n long").groupBy("token_id").agg(F.sum("n").alias("n"))
    ranked = sorted(((-r["n"], r["token_id"]) for r in counts.collect()))  # bounded by the vocabulary
    spark.createDataFrame([(k, t, -n) for k, (n, t) in enumerate(ranked)], "rank long, token_id long, n long").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(max((t for _, t in ranked), default=0) + 1, np.uint32)
    rank[[t for _, t in ranked]] = np.arange(len(ranked), dtype=np.uint32)
    shards = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect())  # one row a partition
    base = dict(zip([s for s, _ in shards], offsets(np.array([n for _, n in shards], np.int64)).tolist()))
    shared = spark.sparkContext.broadcast((rank, base))

    def encode(batches):
        rank, base = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                frame = write_frame(r["doc_ids"], np.array(r["sizes"]), rank[_plain_ids(r["ids"], r["n"])], base[r["shard"]] + r["before"])
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]]), pa.array([r["block"]]), pa.array([frame], pa.binary())], names=["shard", "block", "frame"])

    blocks.mapInArrow(encode, "shard long, block long, frame binary").write.option("compression", "zstd").parquet(f"{path}/frames")
    scratch.drop("plain")


def _read(spark: SparkSession, path: str, schema: str, column):
    ranks = attach(spark).read.parquet(f"{path}/ranks").orderBy("rank").collect()  # bounded by the vocabulary
    shared = spark.sparkContext.broadcast(np.array([r["token_id"] for r in ranks], np.uint32))

    def run(batches):
        ids_of = shared.value
        for batch in batches:
            for raw in batch.column("frame").to_pylist():
                doc_ids, sizes, ranks, start = read_frame(raw)
                ids, first = ids_of[ranks], offsets(sizes)
                last = column(ids, first)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(first[:-1] + start), pa.array(sizes), last], names=["doc_id", "start", "n_tokens", "value"])

    frames = spark.read.schema("shard long, block long, frame binary").parquet(f"{path}/frames")
    return frames.select("frame").mapInArrow(run, f"doc_id long, start long, n_tokens long, value {schema}")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the ids themselves."""
    make = lambda ids, first: pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int64)))
    return _read(spark, path, "array<long>", make).withColumnRenamed("value", "ids")


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""
    def make(ids, first):
        raw, cuts = ids.astype("<u4").tobytes(), (first * 4).tolist()
        return pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64())

    return _read(spark, path, "long", make).withColumnRenamed("value", "ids_crc32")
