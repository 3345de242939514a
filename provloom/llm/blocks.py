"""Columnar helpers shared by the text operators: bounded blocks, words, hashes.

A block holds at most ``MAX_BYTES`` of text, or one longer document, so that a task's
memory follows the block and the longest document, never the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

MAX_BYTES = 6 << 20
U64 = np.uint64


def release_memory() -> None:
    """Give freed memory back to the system, since workers live on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def text_blocks(batches: Iterable[pa.RecordBatch], max_bytes: int = MAX_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches, cut before the text of a slice passes ``max_bytes``."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
            release_memory()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The texts, null as empty."""
    return pc.fill_null(batch.column(column), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text in order, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.not_equal(pc.binary_length(flat), 0)
    if pc.all(full).as_py() is False:
        keep = full.to_numpy(zero_copy_only=False)
        sizes = segment_sums(keep.astype(np.int64), sizes)
        flat = flat.filter(full)
    return flat, sizes


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of a block, the words as codes into them, and words per text."""
    flat, sizes = split_words(texts)
    coded = flat.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes


def segment_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``values`` whose lengths are ``sizes`` (zeros allowed)."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions start, start+1, ... of every run, one run after another."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(total, dtype=np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=U64, count=len(words))


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` consecutive values (fewer values: none)."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = codes[:n].copy()
    for k in range(1, width):
        out *= U64(0x9E3779B97F4A7C15)
        out += codes[k : k + n]
        out ^= out >> U64(29)
    return mix(out)


def crc_bucket(ids: pa.Array | np.ndarray, mod: int) -> np.ndarray:
    """crc32 of each id's decimal text, modulo ``mod``; null ids give -1."""
    import zlib

    values = ids.to_pylist() if isinstance(ids, pa.Array) else ids.tolist()
    return np.fromiter((-1 if v is None else zlib.crc32(str(v).encode()) % mod for v in values), dtype=np.int64, count=len(values))


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """One binary value that holds several arrays."""
    head = np.array([len(arrays), *[len(a) for a in arrays]], "<u4").tobytes() + "".join(a.dtype.str[1:] for a in arrays).encode()
    return head + b"".join(a.tobytes() for a in arrays)


def unpack_arrays(raw: bytes) -> list[np.ndarray]:
    many = int(np.frombuffer(raw, "<u4", 1)[0])
    sizes = np.frombuffer(raw, "<u4", many, 4).tolist()
    at, out = 4 + 4 * many, []
    kinds = raw[at : at + 2 * many].decode()
    at += 2 * many
    for k, size in enumerate(sizes):
        out.append(np.frombuffer(raw, kinds[2 * k : 2 * k + 2], size, at))
        at += out[-1].nbytes
    return out


def squeeze_arrays(*arrays: np.ndarray) -> bytes:
    """``pack_arrays`` in less space: bytes of equal weight side by side, then compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T for a in arrays]
    head = np.array([len(arrays), *[len(a) for a in arrays]], "<u4").tobytes() + "".join(a.dtype.str[1:] for a in arrays).encode()
    body = b"".join(p.tobytes() for p in planes)
    return np.array([len(head), len(body)], "<u8").tobytes() + head + pa.Codec("zstd").compress(body, asbytes=True)


def unsqueeze_arrays(raw: bytes) -> list[np.ndarray]:
    head, size = np.frombuffer(raw, "<u8", 2).tolist()
    many = int(np.frombuffer(raw, "<u4", 1, 16)[0])
    counts = np.frombuffer(raw, "<u4", many, 20).tolist()
    kinds = raw[20 + 4 * many : 16 + head].decode()
    body = pa.Codec("zstd").decompress(raw[16 + head :], size, asbytes=True) if size else b""
    at, out = 0, []
    for k, count in enumerate(counts):
        kind = np.dtype(kinds[2 * k : 2 * k + 2])
        planes = np.frombuffer(body, np.uint8, count * kind.itemsize, at).reshape(kind.itemsize, count)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += planes.size
    return out
