"""Chunks: a table of documents as one row per few megabytes of text, and exchanges between chunks and hash ranges.

A chunk is named once and stored, so that answers can be sent back to it: a hash range sees one sorted list of
distinct hashes per chunk (never one row per document), and answers with a bitmap over that list.  A key that a
third of all documents share thus costs at most one entry per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import partitions, stored
from .words import WordRule, buffers, find_words, pieces

U64 = np.uint64
#: Largest id: stands for a null one, which thus never counts as the smaller.
NO_ID = np.iinfo(np.int64).max


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    codec = pa.Codec("zstd", compression_level=6)  # a fifth smaller than the default level; chunks cross the network twice
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=codec)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_batch(body: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.BufferReader(body)) as stream:
        return next(iter(stream))


@dataclass
class Chunks:
    table: DataFrame  # chunk long, body binary, n_words long
    schema: T.StructType  # of the documents
    n_words: int
    ranges: int  # hash ranges for all words


def in_chunks(df: DataFrame, text_col: str, rule: WordRule, name: str, chunk_bytes: int, words_a_range: int = 1_000_000) -> Chunks:
    """Store df as chunks.  The number of hash ranges follows the number of words, so each stays small."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for piece in pieces(batch, text_col, chunk_bytes):
                n = len(find_words(piece.column(text_col), rule).hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([pack_batch(piece)], pa.binary()), pa.array([n], pa.int64())], ["chunk", "body", "n_words"]
                )
                number += 1

    table = stored(df.mapInArrow(pack, "chunk long, body binary, n_words long"), f"{name}-chunks")
    n_words = table.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n")).first()["n"]
    return Chunks(table, df.schema, n_words, max(2 * partitions(df.sparkSession), -(-n_words // words_a_range)))


def ids(batch: pa.RecordBatch, id_col: str) -> np.ndarray:
    return batch.column(id_col).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, order that sorts the given ones, where each distinct one begins in that order)."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return ordered[begins], order, begins


def planes(values: np.ndarray, n_bytes: int) -> bytes:
    """The lowest bytes of 64-bit values, byte by byte: the nearly constant ones compress to nothing."""
    return values.view(np.uint8).reshape(-1, 8)[:, n_bytes - 1 :: -1 if n_bytes == 8 else -1][:, :n_bytes].T.tobytes()


def from_planes(raw: bytes, n: int, n_bytes: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :n_bytes] = np.frombuffer(raw, np.uint8, n * n_bytes).reshape(n_bytes, n).T[:, ::-1]
    return out.reshape(-1).view(U64)


def range_of(hashes: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """The hash range of each hash of so many bits; it rises with the hash."""
    top = (hashes << U64(64 - bits)) >> U64(32)
    return ((top * U64(ranges)) >> U64(32)).astype(np.int64)


def bits_of(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def answered(hashes: np.ndarray, ranges: int, bits: int, answers: dict[int, bytes]) -> np.ndarray:
    """The flags of a chunk's sorted distinct hashes from the bitmaps that the ranges sent."""
    out = np.zeros(len(hashes), bool)
    part = range_of(hashes, ranges, bits)
    for number, raw in answers.items():
        a, b = np.searchsorted(part, (number, number + 1)).tolist()
        out[a:b] = flags_of(raw, b - a)
    return out


def ask(rows: DataFrame, judge: Callable[[np.ndarray, list[bytes], np.ndarray], np.ndarray], n_bytes: int) -> DataFrame:
    """Bring the lists of each hash range together and send each chunk its bitmap.

    rows: part int, chunk long, n int, hashes binary, extra binary.  judge(all hashes, extras, list number of each
    hash) gives one flag per hash.  Lists without a set flag get no answer.
    """

    def one_range(key: tuple, table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        bodies, extras = table.column("hashes").to_pylist(), table.column("extra").to_pylist()
        hashes = np.concatenate([from_planes(b, k, n_bytes) for b, k in zip(bodies, n.tolist(), strict=True)])
        flags = judge(hashes, extras, np.repeat(np.arange(len(n)), n))
        ends = np.cumsum(n)
        replies = [(c, bits_of(flags[e - k : e])) for c, k, e in zip(table.column("chunk").to_pylist(), n.tolist(), ends.tolist(), strict=True) if flags[e - k : e].any()]
        part = key[0].as_py()
        return pa.table(
            [pa.array([c for c, _ in replies], pa.int64()), pa.array([part] * len(replies), pa.int32()), pa.array([b for _, b in replies], pa.binary())],
            names=["chunk", "part", "bits"],
        )

    return rows.groupBy("part").applyInArrow(one_range, "chunk long, part int, bits binary")


def to_ranges(chunk: int, hashes: np.ndarray, extra: Callable[[int, int], bytes], ranges: int, n_bytes: int) -> pa.RecordBatch:
    """One row for each hash range in which this chunk has hashes (sorted, distinct); ranges without any cost nothing."""
    part = range_of(hashes, ranges, 8 * n_bytes)
    cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else np.zeros(1, np.int64)
    spans = list(zip(part[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([p for p, _, _ in spans], pa.int32()),
            pa.array([chunk] * len(spans), pa.int64()),
            pa.array([b - a for _, a, b in spans], pa.int32()),
            pa.array([planes(hashes[a:b], n_bytes) for _, a, b in spans], pa.binary()),
            pa.array([extra(a, b) for _, a, b in spans], pa.binary()),
        ],
        ["part", "chunk", "n", "hashes", "extra"],
    )


RANGE_ROWS = "part int, chunk long, n int, hashes binary, extra binary"


def text_bytes(batch: pa.RecordBatch, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    return buffers(batch.column(text_col))
