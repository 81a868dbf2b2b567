"""Substring dedup by fixed-block anchors.

1. Every document is cut into non-overlapping blocks of ``block`` words: the reference index.
2. Every rolling window of ``block`` words of every document probes that index.  A window of ``window`` words has
   ``window >= 2 * block - 1`` words, so it holds a whole reference block of each document that it repeats: a
   window without a hit repeats nothing.
3. Hits are extended: only windows of ``window`` words around hits are compared, each with the smallest document id
   that has it.  The union of the windows that an earlier document has are the maximal exact repeats.

All comparisons run between chunks and hash ranges (see ``chunks``): work and shuffle are linear in the number of
words whatever the size of a group of copies, and no pair of documents is ever formed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks as C
from .shared import drop, stored
from .words import SPACED, U64, Words, find_words


def _probes(words: Words, block: int, window: int, n_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash of n_bytes) of each window of ``block`` words in rows that have a whole ``window``."""
    at, hashes = words.windows(block)
    long = np.repeat(words.counts >= window, words.counts)[at]
    return at[long], hashes[long] >> U64(64 - 8 * n_bytes)


def _around_hits(words: Words, at: np.ndarray, live: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows that hold a live anchor."""
    marks = np.zeros(len(words.hashes) + 1, np.int32)
    marks[at[live] + 1] = 1
    marks = np.cumsum(marks, dtype=np.int32)  # live anchors that begin before word i
    first, hashes = words.windows(window)
    near = marks[first + window - block + 1] > marks[first]
    return first[near], hashes[near]


def join_words(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of each row's kept words, joined by one space."""
    rows = words.rows()[kept]
    start, size = words.start[kept], (words.end - words.start)[kept] + 1
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    size[last] -= 1  # no space after the last word of a row
    out_end = np.cumsum(size)
    total = int(out_end[-1]) if len(out_end) else 0
    source = np.repeat(start - (out_end - size), size) + np.arange(total)
    text = words.data[np.minimum(source, max(len(words.data) - 1, 0))].copy()
    text[out_end[~last] - 1] = 0x20
    per_row = np.bincount(rows, weights=size, minlength=len(words.first) - 1).astype(np.int64)
    return text, np.concatenate(([0], np.cumsum(per_row)))


def _string_array(text: np.ndarray, offsets: np.ndarray) -> pa.Array:
    wide = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(text.tobytes()))
    return wide.cast(pa.string())


def remove_repeats(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, block: int = 7, chunk_bytes: int = 2 << 20
) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also occurs in a row with a smaller id.

    Words are runs of anything but ASCII white space, unchanged.  Windows are judged on the input.  Returns all
    columns of df plus ``kept_text`` (kept words joined by one space), ``n_words`` and ``n_removed``; columns of df
    with these names are replaced.  Null text has no words and kept_text ''.  A null id counts as larger than any
    other; rows with equal ids never remove each other's words.  A row with fewer than ``window`` words keeps all.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block at any alignment: window >= 2 * block - 1")
    df = df.drop(*[c for c in df.columns if c.lower() in ("kept_text", "n_words", "n_removed")])
    parts = C.in_chunks(df, text_col, SPACED, "repeats", chunk_bytes)
    ranges = parts.ranges
    n_bytes = min(8, max(4, math.ceil((math.log2(max(parts.n_words, 2)) + 12) / 8)))  # a false hit in 4,000 words

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                words = find_words(C.unpack_batch(body.as_py()).column(text_col), SPACED)
                at, hashes = _probes(words, block, window, n_bytes)
                found, order, begins = C.distinct(hashes)
                if not len(found):
                    continue
                row = words.rows()[at]
                fixed = ((at - words.first[row]) % block == 0).astype(np.uint8)[order]
                row = row[order]
                several = np.minimum.reduceat(row, begins) != np.maximum.reduceat(row, begins)
                flags = np.maximum.reduceat(fixed, begins) | (several.astype(np.uint8) << 1)
                yield C.to_ranges(chunk, found, lambda a, b, f=flags: f[a:b].tobytes(), ranges, n_bytes)

    def live(hashes: np.ndarray, extras: list[bytes], which: np.ndarray) -> np.ndarray:
        flags = np.frombuffer(b"".join(extras), np.uint8)
        found, order, begins = C.distinct(hashes)
        size = np.diff(np.append(begins, len(hashes)))
        flags = np.bitwise_or.reduceat(flags[order], begins)
        good = ((flags & 1) > 0) & ((size > 1) | ((flags & 2) > 0))  # indexed by a document, met in another
        out = np.zeros(len(hashes), bool)
        out[order] = np.repeat(good, size)
        return out

    hits = stored(C.ask(parts.table.select("chunk", "body").mapInArrow(anchors, C.RANGE_ROWS), live, n_bytes), "repeats-hits")

    def regain(words: Words, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        at, hashes = _probes(words, block, window, n_bytes)
        found, order, begins = C.distinct(hashes)
        flags = C.answered(found, ranges, 8 * n_bytes, answers)
        is_live = np.zeros(len(at), bool)
        is_live[order] = np.repeat(flags, np.diff(np.append(begins, len(hashes))))
        return _around_hits(words, at, is_live, block, window)

    def local_first(words: Words, batch: pa.RecordBatch, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct window hashes, the smallest id of each in this chunk, and for each window its number and id."""
        found, order, begins = C.distinct(hashes)
        own = C.ids(batch, id_col)[words.rows()[first]]
        smallest = np.minimum.reduceat(own[order], begins) if len(found) else np.zeros(0, np.int64)
        number = np.zeros(len(first), np.int64)
        number[order] = np.repeat(np.arange(len(found)), np.diff(np.append(begins, len(hashes))))
        return found, smallest, number, own

    def windows(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for chunk, body in zip(left.column("chunk").to_pylist(), left.column("body"), strict=True):
            batch = C.unpack_batch(body.as_py())
            words = find_words(batch.column(text_col), SPACED)
            first, hashes = regain(words, dict(zip(right.column("part").to_pylist(), right.column("bits").to_pylist(), strict=True)))
            found, smallest, _, _ = local_first(words, batch, first, hashes)
            if len(found):
                out.append(C.to_ranges(chunk, found, lambda a, b, s=smallest: C.planes(s[a:b], 8), ranges, 8))
        empty = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("hashes", pa.binary()), ("extra", pa.binary())])
        return pa.Table.from_batches(out, empty)

    def earlier(hashes: np.ndarray, extras: list[bytes], which: np.ndarray) -> np.ndarray:
        own = np.concatenate([C.from_planes(x, len(x) // 8, 8) for x in extras]).view(np.int64)
        _, order, begins = C.distinct(hashes)
        first = np.minimum.reduceat(own[order], begins)
        out = np.zeros(len(hashes), bool)
        out[order] = own[order] > np.repeat(first, np.diff(np.append(begins, len(hashes))))
        return out

    chunk_rows = parts.table.select("chunk", "body").groupBy("chunk")
    asked = chunk_rows.cogroup(hits.groupBy("chunk")).applyInArrow(windows, C.RANGE_ROWS)
    repeats = stored(C.ask(asked, earlier, 8), "repeats-windows")
    schema = T.StructType([*df.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        answers: dict[int, dict[int, bytes]] = {0: {}, 1: {}}
        for kind, part, raw in zip(*(right.column(c).to_pylist() for c in ("kind", "part", "bits")), strict=True):
            answers[kind][part] = raw
        for body in left.column("body"):
            batch = C.unpack_batch(body.as_py())
            words = find_words(batch.column(text_col), SPACED)
            gone = np.zeros(len(words.hashes), bool)
            if answers[0]:
                first, hashes = regain(words, answers[0])
                found, smallest, number, own = local_first(words, batch, first, hashes)
                if len(found):
                    before = C.answered(found, ranges, 64, answers[1])
                    repeated = first[before[number] | (own > smallest[number])]
                    marks = np.zeros(len(gone) + 1, np.int32)
                    marks[repeated] += 1  # no position repeats, so plain indexing adds each once
                    marks[repeated + window] -= 1
                    gone = np.cumsum(marks[:-1]) > 0
            removed = np.bincount(words.rows()[gone], minlength=batch.num_rows).astype(np.int64)
            text = _string_array(*join_words(words, ~gone))
            out.append(pa.RecordBatch.from_arrays([*batch.columns, text, pa.array(words.counts.astype(np.int64)), pa.array(removed)], [*batch.schema.names, "kept_text", "n_words", "n_removed"]))
        return pa.Table.from_batches(out)

    both = hits.withColumn("kind", F.lit(0)).unionByName(repeats.withColumn("kind", F.lit(1)))
    return chunk_rows.cogroup(both.groupBy("chunk")).applyInArrow(cut, schema)
