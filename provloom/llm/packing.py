"""Packing token sequences into fixed windows: bounded-space online best fit.

Every partition streams its documents through ``open_windows`` open windows.  A document
first yields its full windows; what remains goes into the open window that it fills best.
If none has room, the fullest is emitted: as it is if it lacks ``max_slack`` tokens at
most, else topped up with the head of the waiting remainder.  Windows still open at the
end of a partition are merged, best fit decreasing, in groups of ``fan_in`` partitions.

Defined cases: null text is empty and still holds its end id; a null or repeated doc_id
is carried as it is, each row packed on its own; texts of any length are cut into windows;
an empty table gives no pieces; other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provloom.llm.blocks import offsets, text_blocks, texts_of
from provloom.llm.tokens import encoder
from provloom.storage import Scratch

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
MERGED_IDS = 1 << 30


class OnlinePacker:
    """Open windows of one partition; ``place`` returns the pieces of windows that closed."""

    def __init__(self, size: int, open_windows: int, max_slack: int, first_id: int):
        self.size, self.limit, self.max_slack, self.next_id = size, open_windows, max_slack, first_id
        self.free: list[tuple[int, int]] = []
        self.windows: dict[int, list[tuple]] = {}

    def _id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def full(self, doc: tuple, start: int, crc: int) -> tuple:
        return (doc[0], start, self.size, crc, doc[1], self._id(), 0)

    def _put(self, at: int | None, doc: tuple, start: int, ids: np.ndarray) -> list[tuple]:
        if at is None:
            room, window = self.size, self._id()
            self.windows[window] = []
        else:
            room, window = self.free.pop(at)
        piece = (doc[0], start, len(ids), zlib.crc32(ids), doc[1], window, self.size - room)
        self.windows[window].append(piece)
        if room == len(ids):
            return self.windows.pop(window)
        insort(self.free, (room - len(ids), window))
        return []

    def place(self, doc: tuple, start: int, ids: np.ndarray) -> list[tuple]:
        closed: list[tuple] = []
        at = bisect_left(self.free, (len(ids), -1))
        if at < len(self.free):
            return self._put(at, doc, start, ids)
        if len(self.free) >= self.limit:
            slack, window = self.free[0]
            if slack <= self.max_slack:
                self.free.pop(0)
                closed += self.windows.pop(window)
            else:
                closed += self._put(0, doc, start, ids[:slack])
                return closed + self.place(doc, start + slack, ids[slack:])
        return closed + self._put(None, doc, start, ids)

    def leftovers(self) -> list[tuple]:
        return [piece for window in self.windows.values() for piece in window]


def _columns(rows: list[tuple], closed: bool, part: int) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in range(7)]
    arrays = [pa.array(c, pa.int64()) for c in cols]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([closed] * len(rows), pa.bool_()), pa.array([part] * len(rows), pa.int64())], names=[*names, "closed", "part"])


def _pack_partition(path: str, size: int, end_id: int, open_windows: int, max_slack: int, remembered: int):
    def run(batches):
        part = TaskContext.get().partitionId()
        packer = OnlinePacker(size, open_windows, max_slack, part << 32)
        encode = encoder(path, remembered).encode
        for batch in text_blocks(batches):
            ids, counts = encode(texts_of(batch))
            rows: list[tuple] = []
            first = offsets(counts).tolist()
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                own = np.append(ids[first[i] : first[i + 1]], np.uint32(end_id)).astype("<u4")
                doc, whole = (doc_id, len(own)), len(own) // size * size
                for at in range(0, whole, size):
                    rows.append(packer.full(doc, at, zlib.crc32(own[at : at + size])))
                if whole < len(own):
                    rows += packer.place(doc, whole, own[whole:])
            if rows:
                yield _columns(rows, True, part)
        if left := packer.leftovers():
            yield _columns(left, False, part)

    return run


def _merge_group(size: int, fan_in: int):
    def run(table: pa.Table) -> pa.Table:
        """Best fit decreasing over the leftover pieces of ``fan_in`` partitions."""
        rows = sorted(table.select(["length", "doc_id", "start", "ids_crc32", "doc_tokens"]).to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"]))
        first = (MERGED_IDS + table.column("part")[0].as_py() // fan_in) << 32
        free: list[tuple[int, int]] = []
        used, out = 0, []
        for r in rows:
            at = bisect_left(free, (r["length"], -1))
            if at < len(free):
                room, window = free.pop(at)
            else:
                room, window = size, used
                used += 1
            out.append((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], first + window, size - room))
            insort(free, (room - r["length"], window))
        return pa.Table.from_batches([_columns(out, True, 0)]).drop_columns(["closed", "part"])

    return run


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, size: int = 1024, end_id: int = 0, open_windows: int = 32, max_slack: int = 12, fan_in: int = 16, remembered: int = 400_000,
) -> DataFrame:
    """One row per piece: where its ids stand in the document and in its sequence.

    Memory per task: the open windows, one block of ids, and the ids of ``remembered`` words.  The only shuffle carries the
    leftover pieces of each partition (``open_windows`` windows at most).
    """
    scratch = Scratch(docs.sparkSession, "packing")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _pack_partition(tokenizer_path, size, end_id, open_windows, max_slack, remembered), f"{PIECES}, closed boolean, part long")
    packed = scratch.keep(packed, "pieces")
    names = [x.split()[0] for x in PIECES.split(", ")]
    merged = packed.where(~F.col("closed")).groupBy(F.floor(F.col("part") / fan_in).alias("merge_group")).applyInArrow(_merge_group(size, fan_in), PIECES)
    return packed.where("closed").select(*names).unionByName(merged)
