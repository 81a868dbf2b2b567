"""Near-duplicate documents by one-permutation MinHash, confirmed on full shingle sets.

Sketch: the hashes of a document's distinct shingles fall into ``bins`` bins; each bin keeps its smallest.  An empty
bin takes the value of the first filled bin in a random order of bins that depends on the empty bin only (optimal
densification), so bins agree with probability J whatever the size of the sets.  ``rows`` bins make a band; documents
with an equal band share a bucket.  64 bands of 6 bins miss a pair at J = 0.75 with probability 4e-6.

Candidates are stars: each bucket links its members to a centre, never all pairs.  Pairs are confirmed on the full
sets of both texts.  One star would lose members that are similar to each other but not to the centre.  So where the
members of a bucket lie in several components after the stars, those of different components are compared by a finer
sketch, in blocks of about 256 x 256: two bits of each of 2,048 bins estimate J with a deviation of 0.012.  Only pairs
less than 4 deviations below the threshold (one at the threshold is missed with probability 3e-5) become candidates:
first one for each member, then, in the buckets that this leaves in several components, all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import drop, stored
from .words import SPACED_LOWER, U64, Words, find_words, mix, pieces

#: Bits of a sorting key that hold the row; ``pieces`` gives at most so many rows.
ROW_BITS = 12
HASH_BITS = 64 - ROW_BITS


def shingle_keys(words: Words, shingle: int) -> np.ndarray:
    """Sorted distinct (row, shingle hash) keys; a row with fewer words is one shingle, without words none."""
    at, hashes = words.windows(shingle)
    rows = words.rows()
    parts = [(rows[at].astype(U64) << U64(HASH_BITS)) | (hashes >> U64(ROW_BITS))]
    few = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    if len(few):
        whole = mix(words.whole()[few])
        parts.append((few.astype(U64) << U64(HASH_BITS)) | (whole >> U64(ROW_BITS)))
    keys = np.sort(np.concatenate(parts))
    return keys[np.concatenate(([True], keys[1:] != keys[:-1]))] if len(keys) else keys


@lru_cache(4)
def _orders(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin a random order of all bins, the same everywhere, and the place of each bin in it."""
    scores = mix(np.arange(bins * bins, dtype=U64) + (U64(1) << U64(40))).reshape(bins, bins)
    orders = np.argsort(scores, axis=1).astype(np.int32)
    places = np.empty_like(orders)
    np.put_along_axis(places, orders, np.arange(bins, dtype=np.int32)[None, :], axis=1)
    return orders, places


def sketches(keys: np.ndarray, n_rows: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(n_rows x bins smallest hashes with empty bins filled, rows that have any)."""
    bin_bits = bins.bit_length() - 1
    cell = keys >> U64(HASH_BITS - bin_bits)
    begins = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    table = np.zeros((n_rows, bins), U64)
    filled = np.zeros((n_rows, bins), bool)
    where = cell[begins].astype(np.int64)
    table.reshape(-1)[where] = keys[begins] & U64((1 << HASH_BITS) - 1)
    filled.reshape(-1)[where] = True
    count = filled.sum(axis=1)
    orders, places = _orders(bins)
    for i in np.flatnonzero((count > 0) & (count <= 32)).tolist():  # few filled bins: find the first of them directly
        own = np.flatnonzero(filled[i])
        table[i] = np.where(filled[i], table[i], table[i, own[np.argmin(places[:, own], axis=1)]])
    row, col = np.nonzero(~filled & (count > 32)[:, None])
    step = 0
    while len(row):
        source = orders[col, step]
        ok = filled[row, source]
        table[row[ok], col[ok]] = table[row[ok], source[ok]]
        row, col, step = row[~ok], col[~ok], step + 1
    return table, count > 0


def band_keys(table: np.ndarray, bands: int, rows: int) -> np.ndarray:
    weights = mix(np.arange(1, rows + 1, dtype=U64))
    salted = (table[:, : bands * rows].reshape(len(table), bands, rows) * weights).sum(axis=2, dtype=U64)
    return mix(salted + mix(np.arange(1, bands + 1, dtype=U64) << U64(32)))


def bit_sketch(table: np.ndarray) -> np.ndarray:
    """Two bits of each bin, salted by the bin, as two planes of 64-bit numbers."""
    values = mix(table + np.arange(table.shape[1], dtype=U64) * U64(0x9E3779B97F4A7C15))
    return np.concatenate([np.packbits(((values >> U64(i)) & U64(1)).astype(np.uint8), axis=1).view(np.int64) for i in (0, 1)], axis=1)


def _lists(values: np.ndarray, some: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists; empty for rows without words."""
    offsets = np.concatenate(([0], np.cumsum(some))) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values[some].reshape(-1)))


def fine_sketches(texts: DataFrame, shingle: int, bins: int, chunk_bytes: int) -> DataFrame:
    """(rep, bits) for texts(id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", chunk_bytes, 1024):
                table, some = sketches(shingle_keys(find_words(piece.column("text"), SPACED_LOWER), shingle), piece.num_rows, bins)
                yield pa.RecordBatch.from_arrays([piece.column("id"), _lists(bit_sketch(table), some)], ["rep", "bits"])

    return texts.mapInArrow(run, "rep long, bits array<long>")


def sketch_table(df: DataFrame, text_col: str, shingle: int, bands: int, rows: int, bins: int, chunk_bytes: int) -> DataFrame:
    """id, n (size of the shingle set), s1 and s2 (128 bits that stand for the set), keys (one for each band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text_col, chunk_bytes, 1 << ROW_BITS):
                n = piece.num_rows
                keys = shingle_keys(find_words(piece.column(text_col), SPACED_LOWER), shingle)
                row = (keys >> U64(HASH_BITS)).astype(np.int64)
                size = np.bincount(row, minlength=n)
                value = keys & U64((1 << HASH_BITS) - 1)
                edges = np.concatenate(([0], np.cumsum(size)))
                sums = []
                for salt in (0x51ED270B, 0x2545F491):
                    total = np.zeros(len(value) + 1, U64)
                    np.cumsum(mix(value + (U64(salt) << U64(24))), out=total[1:])
                    sums.append(pa.array((total[edges[1:]] - total[edges[:-1]]).view(np.int64)))
                table, some = sketches(keys, n, bins)
                keys_of = _lists(band_keys(table, bands, rows).view(np.int64), some)
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(size.astype(np.int64)), *sums, keys_of], ["id", "n", "s1", "s2", "keys"])

    return df.mapInArrow(run, "id long, n long, s1 long, s2 long, keys array<long>")


#: Pairs with the same first document in one group of ``confirm``.
STAR = 256


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, chunk_bytes: int) -> DataFrame:
    """Those of pairs (a, b) whose shingle sets have 100 * intersection >= percent * union.

    The pairs of one a are dealt out into groups of about ``STAR``; a group gets the text of a once, then those of its b.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, U64)
        for batch in batches:
            for piece in pieces(batch, "text", chunk_bytes, 1 << ROW_BITS):
                keys = shingle_keys(find_words(piece.column("text"), SPACED_LOWER), shingle)
                edges = np.searchsorted(keys, np.arange(piece.num_rows + 1, dtype=U64) << U64(HASH_BITS))
                edges[-1] = len(keys)
                values = keys & U64((1 << HASH_BITS) - 1)
                first, good = piece.column("b").is_null().to_pylist(), np.zeros(piece.num_rows, bool)
                for i in range(piece.num_rows):
                    mine = values[edges[i] : edges[i + 1]]
                    if first[i]:
                        centre = mine
                    elif len(mine) and len(centre):
                        spots = np.minimum(np.searchsorted(centre, mine), len(centre) - 1)
                        both = int((centre[spots] == mine).sum())
                        good[i] = 100 * both >= percent * (len(mine) + len(centre) - both)
                flags = pa.array(good)
                yield pa.RecordBatch.from_arrays([piece.column("a").filter(flags), piece.column("b").filter(flags)], ["a", "b"])

    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("groups"))
    dealt = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    members = dealt.join(texts.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "text")
    centres = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    ordered = members.union(centres).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(run, "a long, b long")


#: Members of a bucket in one block of comparisons.
BLOCK = 256
_MEMBER = ("rep", "n", "root")
NO_ROOT = np.iinfo(np.int64).max


def _close_pairs(x: dict[str, np.ndarray], y: dict[str, np.ndarray] | None, percent: int, most: int, one: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of different components, of sizes that allow a link, whose sketches differ in few bins.

    y None: within x, each pair once.  one: only the most promising partner of each member, which is that of the
    component with the smallest root among those that seem to reach the threshold, or else the closest.
    """
    other = x if y is None else y
    half = x["bits"].shape[1] // 2
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(x["rep"])):
        from_ = i + 1 if y is None and not one else 0
        n, m = x["n"][i], other["n"][from_:]
        fits = (other["root"][from_:] != x["root"][i]) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * percent)
        at = np.flatnonzero(fits) + from_
        if not len(at):
            continue
        differ = (other["bits"][at] ^ x["bits"][i]).view(U64)  # unsigned: a count of signed numbers drops the sign
        bins = np.bitwise_count(differ[:, :half] | differ[:, half:]).sum(axis=1)
        close = bins <= most
        at, bins = at[close], bins[close]
        if one and len(at):
            likely = bins <= 64 * half * (100 - percent) * 3 // 400  # as many as at the threshold
            root = np.where(likely, other["root"][at], NO_ROOT)
            at = at[np.lexsort((bins, root))[:1]]
        left.append(np.full(len(at), x["rep"][i]))
        right.append(other["rep"][at])
    return np.concatenate(left), np.concatenate(right)


def _pairs_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    out = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _MEMBER}
    return out | {"bits": batch.column("bits").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)}


def deal_members(members: DataFrame) -> DataFrame:
    """Deal members(key, size, rep, ...) of each bucket out into blocks by hash: adds blocks and block."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    return members.select("*", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int").alias("block"))


def compare_members(dealt: DataFrame, percent: int, most: int, one: bool = False) -> DataFrame:
    """Distinct candidate pairs (a, b) of dealt members(key, block, blocks, rep, n, root, bits) of the same bucket.

    A bucket of one block is compared where it is put together.  The blocks of a larger one become one row each, and
    so does each pair of them, so that no task gets a whole bucket and all rows of a stage cost about the same.
    one: a block with itself only, one partner for each member.
    """
    ordered = dealt.repartition("key", "block").sortWithinPartitions("key", "block")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of one block at a time; blocks lie together, but may go on in the next batch."""
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            key, block = batch.column("key").to_numpy(), batch.column("block").to_numpy()
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                part = batch.slice(a, b - a)
                if i == 0 and rest and part.num_rows and (rest[0].column("key")[0], rest[0].column("block")[0]) != (part.column("key")[0], part.column("block")[0]):
                    yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                    rest = []
                if i > 0:
                    yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                    rest = []
                if part.num_rows:
                    rest.append(part)
        if rest:
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for group in groups(batches):
            found.append(_close_pairs(_columns(group), None, percent, most, one))
            if len(found) >= 4096:
                yield _pairs_batch(found)
                found = []
        yield _pairs_batch(found)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches):
            x = _columns(group)
            head = [group.column(c).slice(0, 1) for c in ("key", "block", "blocks")]
            yield pa.RecordBatch.from_arrays([*head, *[pa.array([x[c].astype(np.int64).tobytes()], pa.binary()) for c in (*_MEMBER, "bits")]], ["key", "block", "blocks", *_MEMBER, "bits"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                same, sides = batch.column("i")[i] == batch.column("j")[i], []
                for side in ("l_", "r_"):
                    if batch.column(side + "rep")[i].is_valid:
                        x = {c: np.frombuffer(batch.column(side + c)[i].as_py(), np.int64) for c in (*_MEMBER, "bits")}
                        sides.append(x | {"bits": x["bits"].reshape(len(x["rep"]), -1)})
                if same or len(sides) == 2:  # a block may have no members
                    yield _pairs_batch([_close_pairs(sides[0], None if same else sides[1], percent, most)])

    alone = ordered if one else ordered.filter("blocks = 1")
    small = alone.mapInArrow(within, "a long, b long").distinct()
    if one:
        return small
    packed = ordered.filter("blocks > 1").mapInArrow(pack, "key long, block int, blocks int, rep binary, n binary, root binary, bits binary")
    packed = stored(packed, "blocks")
    names = (*_MEMBER, "bits")
    # Both sides of a pair of blocks are dealt by the pair; a block is also paired with itself, as a row without a right side.
    later = F.sequence(F.col("block"), F.col("blocks") - 1)
    left = packed.select("key", F.col("block").alias("i"), F.explode(later).alias("j"), *[F.col(c).alias(f"l_{c}") for c in names])
    right = packed.filter("block > 0").select("key", F.explode(F.sequence(F.lit(0), F.col("block") - 1)).alias("i"), F.col("block").alias("j"), *[F.col(c).alias(f"r_{c}") for c in names])
    large = left.join(right, ["key", "i", "j"], "left").mapInArrow(across, "a long, b long").distinct()
    return small.union(large).distinct()


def near_duplicates(
    df: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 75,
    bands: int = 64,
    rows: int = 6,
    bins: int = 512,
    fine_bins: int = 2048,
    deviations: float = 4.0,
    chunk_bytes: int = 1 << 20,
) -> DataFrame:
    """One row (``id_col``, ``n_shingles``, ``component_id``, ``kept``) per row of df.

    Words are runs of anything but ASCII white space, A-Z lower-cased.  Two ids are linked if a text of the one and a
    text of the other reach ``percent`` per cent Jaccard similarity; component_id is the smallest id that can be
    reached; kept says that it is the row's own.  Null or empty texts have n_shingles 0 and no link.  A row with a
    null id has a null component, links with nothing and is kept.  Repeated rows and ids share their component.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = stored(sketch_table(docs, "text", shingle, bands, rows, bins, chunk_bytes), "sketches")
    # One representative of each distinct set: copies never meet in a bucket.
    same = sketched.filter("n > 0 and id is not null").groupBy("n", "s1", "s2")
    classes = stored(same.agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "classes")
    in_band = classes.select("rep", "n", F.explode("keys").alias("key"))
    buckets = stored(in_band.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("size")).filter("size > 1").select("key", "c"), "buckets")
    members = stored(in_band.join(buckets, "key").select("key", "rep", "n", "c"), "members")

    # The likeliest centre of each member: that of most of its buckets.
    near = F.least("n", "c.n") * 100 >= F.greatest("n", "c.n") * percent
    star = members.filter((F.col("rep") != F.col("c.rep")) & near).groupBy(F.col("c.rep").alias("a"), F.col("rep").alias("b")).count()
    texts = stored(docs.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"), "candidates")
    tested = stored(star.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b"), "pairs")
    links = stored(confirm(tested, texts, shingle, percent, chunk_bytes), "links")
    roots = components(links)

    # Buckets that still lie in several components.
    def with_roots(rows: DataFrame) -> DataFrame:
        joined = rows.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
        return joined.select(*rows.columns, F.coalesce("root", "rep").alias("root"))

    def still_open(rows: DataFrame) -> DataFrame:
        ends = with_roots(rows.select("key", "rep", "n")).groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size"))
        return stored(ends.filter("x <> y").select("key", "size"), "open")

    left = stored(members.select("key", "rep", "n").join(still_open(members), "key"), "left")
    needed = texts.join(left.select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    bits = fine_sketches(needed, shingle, fine_bins, chunk_bytes)
    dealt = stored(deal_members(left.join(bits, "rep")), "dealt")
    share = (1 - percent / 100) * 3 / 4  # of bins that differ at the threshold
    most = math.ceil(fine_bins * share + deviations * math.sqrt(fine_bins * share * (1 - share)))
    # First one partner for each member, which joins most of what belongs together; then all that are left.
    for one in (True, False):
        current = dealt if one else dealt.join(still_open(dealt).select("key"), "key", "left_semi")
        candidates = compare_members(with_roots(current), percent, most, one)
        more = stored(candidates.join(tested, ["a", "b"], "left_anti"), "pairs")
        found = stored(confirm(more, texts, shingle, percent, chunk_bytes), "links")
        tested = tested.union(more)
        if not found.isEmpty():
            links = links.union(found)
            roots = components(links)

    named = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("n", "s1", "s2", F.coalesce("root", "rep").alias("root"))
    out = sketched.select("id", "n", "s1", "s2").join(stored(named, "roots"), ["n", "s1", "s2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "id"))
    drop(texts, members, buckets)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
