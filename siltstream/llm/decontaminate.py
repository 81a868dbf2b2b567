"""Benchmark decontamination by winnowing.

A text's fingerprints are the smallest k-gram hash of every ``window - k + 1`` consecutive k-grams (the rightmost of
equal ones).  Two texts that share ``window`` words in a row choose the same k-gram there, so joining fingerprints
finds every shared window.  Hits are then extended: the windows around a common fingerprint are compared whole.
Items with fewer words than a window are one window each, which is its own fingerprint.

The benchmark side is broadcast only if its text has at most ``broadcast_bytes``; a larger one is joined by
shuffles of distinct fingerprints per chunk of documents, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chunks as C
from .shared import stored
from .words import ALNUM_LOWER, U64, Words, find_words, pieces

ADDED = ("n_words", "n_hit", "items")


def winnow(words: Words, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the chosen k-grams of each row that has a whole window."""
    at, hashes = words.windows(k)
    span = window - k + 1
    n = len(hashes) - span + 1
    if n < 1:
        return at[:0], hashes[:0]
    least, where = hashes[:n].copy(), np.arange(n)
    for j in range(1, span):
        other = hashes[j : j + n]
        lower = other <= least
        least[lower] = other[lower]
        where[lower] = j + np.flatnonzero(lower)
    one_row = at[span - 1 :] - at[:n] == span - 1  # k-gram starts are consecutive only within a row
    rows = words.rows()
    one_row &= rows[at[span - 1 :]] == rows[at[:n]]
    chosen = np.zeros(len(at), bool)
    chosen[where[one_row]] = True
    return at[chosen], hashes[chosen]


def _member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(values):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def fingerprints(words: Words, k: int, window: int, short: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, first word, hash) for the winnowed k-grams, then for all n-grams of each short length."""
    return [(window, *winnow(words, k, window)), *((n, *words.windows(n)) for n in short)]


def around(words: Words, k: int, window: int, short: list[int], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, hash) of the windows that hold a known fingerprint."""
    out = []
    for length, at, hashes in fingerprints(words, k, window, short):
        hit = _member(hashes, known)
        if not hit.any():
            continue
        first, whole = at[hit], hashes[hit]
        if length == window:
            marks = np.zeros(len(words.hashes) + 1, np.int32)
            marks[first + 1] = 1
            marks = np.cumsum(marks, dtype=np.int32)
            first, whole = words.windows(window)
            near = marks[first + window - k + 1] > marks[first]
            first, whole = first[near], whole[near]
        out.append((first, np.full(len(first), length), whole))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def item_windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the windows of each item; an item with fewer words is one."""
    first, hashes = words.windows(window)
    rows = [words.rows()[first]]
    found = [hashes]
    for n in range(1, window):
        at, short = words.windows(n)
        row = words.rows()[at]
        own = words.counts[row] == n
        rows.append(row[own])
        found.append(short[own])
    return np.concatenate(rows), np.concatenate(found)


class Index:
    """Fingerprints and windows of a benchmark, or of what one chunk needs of it."""

    def __init__(self, known: np.ndarray, hashes: np.ndarray, item_of: np.ndarray, names: list[str]):
        """hashes, item_of: one entry for each window of each item; names: sorted, item_of points into them."""
        self.known, self.names = known, names
        order = np.lexsort((item_of, hashes))
        hashes, item_of = hashes[order], item_of[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (item_of[1:] != item_of[:-1])
        hashes, self.item_of = hashes[fresh], item_of[fresh]
        self.hashes, begins = np.unique(hashes, return_index=True)
        self.begins = np.append(begins, len(hashes))


def mark(batch: pa.RecordBatch, words: Words, first: np.ndarray, length: np.ndarray, hashes: np.ndarray, index: Index) -> pa.RecordBatch:
    """The batch with its counts of words and hit words, and the sorted names of the items that occur in each row."""
    good = _member(hashes, index.hashes)
    first, length, hashes = first[good], length[good], hashes[good]
    marks = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(marks, first, 1)
    np.add.at(marks, first + length, -1)
    rows = words.rows()
    hit = np.bincount(rows[np.cumsum(marks[:-1]) > 0], minlength=batch.num_rows)
    which = np.searchsorted(index.hashes, hashes)
    pairs = np.unique(np.stack([rows[first], which]), axis=1) if len(first) else np.zeros((2, 0), np.int64)
    sizes = (index.begins[1:] - index.begins[:-1])[pairs[1]]
    flat = np.repeat(index.begins[pairs[1]] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    found = np.unique(np.repeat(pairs[0], sizes) * max(len(index.names), 1) + index.item_of[flat]) if len(flat) else np.zeros(0, np.int64)
    row, item = np.divmod(found, max(len(index.names), 1))
    offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=batch.num_rows))))
    items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([index.names[i] for i in item.tolist()], pa.string()))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(words.counts.astype(np.int64)), pa.array(hit.astype(np.int64)), items], [*batch.schema.names, *ADDED])


def mark_benchmark(
    df: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    k: int = 5,
    broadcast_bytes: int = 16 << 20,
    chunk_bytes: int = 2 << 20,
) -> DataFrame:
    """All columns of df plus ``n_words``, ``n_hit`` (words inside any occurrence of an item's window) and ``items``
    (ids, as strings in code point order, of the items with an occurring window).

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased.  Columns of df with the added names
    are replaced.  Null or empty texts, of documents or items, have no words and match nothing.  Items with equal ids
    count as one; a null item id is written as ''.  An empty benchmark hits nothing.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in ADDED])
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*df.schema.fields, *fields])
    items = benchmark.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item") + 16), F.lit(0)).alias("n")).first()["n"]
    if size > broadcast_bytes:
        return _mark_by_shuffle(df, items, schema, text_col, window, k, chunk_bytes)
    rows = items.collect()  # at most broadcast_bytes
    words = find_words(pa.array([r["text"] for r in rows], pa.large_string()), ALNUM_LOWER)
    names = sorted({r["item"] for r in rows})
    number = {x: i for i, x in enumerate(names)}
    row, hashes = item_windows(words, window)
    short = sorted({int(n) for n in words.counts if 0 < n < window})
    own = np.array([number[r["item"]] for r in rows], np.int64)[row]
    known = np.unique(np.concatenate([winnow(words, k, window)[1], *(h for n in short for h in [hashes[words.counts[row] == n]])]))
    index = df.sparkSession.sparkContext.broadcast(Index(known, hashes, own, names))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col, chunk_bytes):
                words = find_words(piece.column(text_col), ALNUM_LOWER)
                yield mark(piece, words, *around(words, k, window, short, index.value.known), index.value)

    return df.mapInArrow(scan, schema)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _mark_by_shuffle(df: DataFrame, items: DataFrame, schema: T.StructType, text_col: str, window: int, k: int, chunk_bytes: int) -> DataFrame:
    """For a benchmark of any size: rows of distinct fingerprints, then of distinct windows, for each chunk."""

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", chunk_bytes):
                words = find_words(piece.column("text"), ALNUM_LOWER)
                row, hashes = item_windows(words, window)
                prints = np.concatenate([winnow(words, k, window)[1], hashes[words.counts[row] < window]])
                n = words.counts[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [len(prints), len(hashes)])), _signed(np.concatenate([prints, hashes])), pa.array([None] * len(prints) + [piece.column("item")[int(i)].as_py() for i in row], pa.string()), pa.array(np.concatenate([np.full(len(prints), window), n]), pa.int64())],
                    ["kind", "hash", "item", "n"],
                )

    bench = stored(items.mapInArrow(item_rows, "kind long, hash long, item string, n long"), "benchmark")
    short = [r["n"] for r in bench.filter(f"kind = 1 and n < {window}").select("n").distinct().orderBy("n").collect()]  # at most window - 1 lengths
    parts = C.in_chunks(df, text_col, ALNUM_LOWER, "decontaminate", chunk_bytes)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body"), strict=True):
                words = find_words(C.unpack_batch(body.as_py()).column(text_col), ALNUM_LOWER)
                found = np.unique(np.concatenate([h for _, _, h in fingerprints(words, k, window, short)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk)), _signed(found)], ["chunk", "hash"])

    chunk_rows = parts.table.select("chunk", "body")
    known = chunk_rows.mapInArrow(prints, "chunk long, hash long").join(bench.filter("kind = 0").select("hash").distinct(), "hash", "left_semi")
    known = stored(known.select("chunk", "hash"), "decontaminate-prints")

    def candidates(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, U64)]
        for body in left.column("body"):
            words = find_words(C.unpack_batch(body.as_py()).column(text_col), ALNUM_LOWER)
            found.append(around(words, k, window, short, np.sort(right.column("hash").to_numpy().view(U64)))[2])
        hashes = np.unique(np.concatenate(found))
        chunk = left.column("chunk")[0].as_py() if left.num_rows else 0
        return pa.table([pa.array(np.full(len(hashes), chunk)), _signed(hashes)], names=["chunk", "hash"])

    asked = chunk_rows.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(candidates, "chunk long, hash long")
    met = asked.join(bench.filter("kind = 1").select("hash", "item").distinct(), "hash")
    both = known.select("chunk", "hash", F.lit(None).cast("string").alias("item")).unionByName(met.select("chunk", "hash", "item"))

    def finish(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, item = right.column("hash").to_numpy().view(U64), right.column("item").to_pylist()
        windows = np.array([x is not None for x in item], bool)
        names = sorted({x for x in item if x is not None})
        number = {x: i for i, x in enumerate(names)}
        index = Index(np.sort(hashes[~windows]), hashes[windows], np.array([number[x] for x in item if x is not None], np.int64), names)
        out = []
        for body in left.column("body"):
            batch = C.unpack_batch(body.as_py())
            words = find_words(batch.column(text_col), ALNUM_LOWER)
            out.append(mark(batch, words, *around(words, k, window, short, index.known), index))
        return pa.Table.from_batches(out)

    return chunk_rows.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finish, schema)
