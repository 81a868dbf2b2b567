"""Exact top-k search by distributed histogram selection.

All scores of a query against the rows are computed in blocks (block of queries x block of rows, one matrix product).
The pairs of blocks are dealt as a grid, a cell for each task: a cell gets a share of the queries and a share of the
rows, so neither side is copied to all tasks, and a task holds its queries and one block of rows at a time.
No score leaves its task: a round sends, for each query and cell, a histogram over the query's open interval, cut off
once it holds the wanted count.  The summed histograms tell in which bin the k-th best score lies; the next round opens
only that bin.  An interval of one score that many rows tie on is refined by id in the same way.  When few rows are left
in the interval, one last pass keeps what reaches it, and the order (score, then smaller id) gives the ranks.
After the first round a query meets only those shares of the rows in which its histogram has a bin up to that of the k-th.

Scores are exact integers whatever the size of the components; one that no long holds counts as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions, stored

BINS = 4096
#: An interval with so many rows beyond k is not refined any further.
SLACK = 64
_STATE = ["s_lo", "s_hi", "i_lo", "i_hi", "need"]
_BLOCK = "block long, share int, dim int, width int, body binary, ids binary"
#: Products of this many queries and rows stay in a core's cache.
_PRODUCT = (1024, 512)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, dim int, vec array<double>): rows with a null id or an unusable vector go."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
    fine &= F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.filter(fine).select(F.col(id_col).cast("long").alias("id"), F.size(x).alias("dim"), x.alias("vec"))


def _floors(x: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(x * scale)


def _blocks(rows: int, extra: list[str], scale: int):
    """Pack rows (id, dim, vec, share, extra longs) of each task into blocks of one dimension and share: the floors of the
    scaled components as integers of 1 or 2 bytes where all are small, or else the components as they are (8 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            dims, shares = batch.column("dim").to_numpy(), batch.column("share").to_numpy()
            for dim, share in np.unique(np.stack([dims, shares])[:, dims > 0], axis=1).T.tolist():
                own = batch.filter(pa.array((dims == dim) & (shares == share)))
                for at in range(0, own.num_rows, rows):
                    part = own.slice(at, rows)
                    columns = [part.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("id", *extra)]
                    body = part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float)
                    floors = _floors(body, scale)
                    most = float(np.abs(floors).max())
                    width = 1 if most < 2**7 else 2 if most < 2**15 else 8
                    body = body if width == 8 else floors.astype(f"i{width}")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number]), *[pa.array([x], pa.int32()) for x in (share, dim, width)], *[pa.array([c], pa.binary()) for c in (body.tobytes(), *columns)]],
                        ["block", "share", "dim", "width", "body", "ids", *extra],
                    )
                    number += 1

    return run


class _Side:
    """One block of vectors: ``floors`` as floating-point numbers, exact below 2**53; ``raw``: the components, if not small."""

    def __init__(self, body: bytes, width: int, dim: int, scale: int):
        self.raw = np.frombuffer(body, float).reshape(-1, dim) if width == 8 else None
        self.scale = scale
        self.floors = np.frombuffer(body, f"i{width}").astype(np.float32).reshape(-1, dim) if width < 8 else _floors(self.raw, scale)
        self.most = np.abs(self.floors).max(axis=1, initial=0.0).astype(float)

    def integers(self, row: int) -> list[int]:
        if self.raw is None:
            return [int(v) for v in self.floors[row].tolist()]
        return [int(v) * self.scale if abs(v) >= 2.0**53 else int(np.floor(v * self.scale)) for v in self.raw[row].tolist()]


def _scores(q: _Side, r: _Side) -> np.ndarray:
    """Exact integer inner products, cut to the range of a long: as floating-point numbers where these are exact."""
    dim = q.floors.shape[1]
    most = float(q.most.max(initial=0)) * float(r.most.max(initial=0)) * dim
    kind = np.float32 if most < 2.0**24 else np.float64
    a, b = q.floors.astype(kind, copy=False), r.floors.astype(kind, copy=False)
    if most < 2.0**53:
        return a @ b.T
    with np.errstate(all="ignore"):
        close = a @ b.T
        bound = q.most[:, None] * r.most[None, :] * dim
        easy = bound < 2.0**53
        out = np.where(easy, close, 0).astype(np.int64)
        rows, cols = np.flatnonzero(~easy.all(axis=1)), np.flatnonzero(~easy.all(axis=0))
        close, bound = close[np.ix_(rows, cols)], bound[np.ix_(rows, cols)]
        error = bound * 2.0**-40  # more than all roundings of up to 2**12 products
        longs = lambda x: np.where(np.abs(x) < 2.0**62, x, 0).astype(np.int64)
        wrapped = longs(a[rows]) @ longs(b[cols]).T  # right modulo 2**64
        fits = (q.most[rows, None] < 2.0**62) & (r.most[None, cols] < 2.0**62) & (np.abs(close) + error < 2.0**63)
        beyond = np.isfinite(close) & np.isfinite(error) & (np.abs(close) - error >= 2.0**63)
        edge = np.where(close > 0, np.iinfo(np.int64).max, np.iinfo(np.int64).min)
    hard = np.where(fits, wrapped, np.where(beyond, edge, 0))
    cache: dict[tuple[int, int], list[int]] = {}
    for i, j in zip(*(x.tolist() for x in np.nonzero(~fits & ~beyond)), strict=True):
        for key, side, row in (((0, i), q, rows[i]), ((1, j), r, cols[j])):
            if key not in cache:
                cache[key] = side.integers(row)
        exact = sum(a * b for a, b in zip(cache[0, i], cache[1, j], strict=True))
        hard[i, j] = max(np.iinfo(np.int64).min, min(np.iinfo(np.int64).max, exact))
    out[np.ix_(rows, cols)] = np.where(easy[np.ix_(rows, cols)], out[np.ix_(rows, cols)], hard)
    return out


def _as_kind(bounds: np.ndarray, kind: np.dtype) -> np.ndarray:
    """Longs as bounds of scores of this kind: floating-point scores lie within the numbers that it holds exactly."""
    if kind == np.int64:
        return bounds
    most = 2**24 if kind == np.float32 else 2**53
    return np.clip(bounds, -most, most).astype(kind)


def _reaching(scores: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the scores that are no smaller than the floor of their row."""
    floor = _as_kind(floor, scores.dtype)
    rows = np.flatnonzero(scores.max(axis=1) >= floor)
    i, j = np.nonzero(scores[rows] >= floor[rows, None])
    return rows[i], j


class _Open:
    """One block of queries with their open intervals, and histograms of what lies in them, from the best value on.

    Bins are counted from s_hi down or from i_lo up.  Differences are taken modulo 2**64, so any two longs may be the
    ends.  A bin after ``last`` can't hold the k-th best value: those before it hold as many by themselves.
    """

    def __init__(self, side: _Side, ids: np.ndarray, s_lo: np.ndarray, s_hi: np.ndarray, i_lo: np.ndarray, i_hi: np.ndarray, need: np.ndarray):
        self.side, self.ids, self.s_lo, self.s_hi, self.i_lo, self.i_hi, self.need = side, ids, s_lo, s_hi, i_lo, i_hi, need
        self.by_score = s_lo < s_hi
        self.span = np.where(self.by_score, s_hi - s_lo, i_hi - i_lo).view(np.uint64)
        self.width = self.span // np.uint64(BINS) + np.uint64(1)
        self.last = np.full(len(ids), BINS - 1)
        self.floor, self.met = s_lo, False
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def bins(self, i: np.ndarray, values: np.ndarray) -> np.ndarray:
        away = np.where(self.by_score[i], self.s_hi[i] - values, values - self.i_lo[i]).view(np.uint64)
        return (away // self.width[i]).view(np.int64)

    def ends(self, i: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest value of the bins."""
        first = bins.astype(np.uint64) * self.width[i]
        last = first + (self.width[i] - np.uint64(1))
        last = np.where((last < first) | (last > self.span[i]), self.span[i], last)
        first, last = first.view(np.int64), last.view(np.int64)
        by = self.by_score[i]
        return np.where(by, self.s_hi[i] - last, self.i_lo[i] + first), np.where(by, self.s_hi[i] - first, self.i_lo[i] + last)

    def cut(self, i: np.ndarray, bins: np.ndarray) -> None:
        self.last[i] = np.minimum(self.last[i], bins)
        every = np.arange(len(self.ids))
        self.floor = np.where(self.by_score, self.ends(every, self.last)[0], self.s_lo)

    def first_cut(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Cut by the first block alone, so that its many worse scores are not counted one by one."""
        self.met, need = True, int(self.need.max())
        if need > scores.shape[1]:
            return
        low, high = (_as_kind(x, scores.dtype)[:, None] for x in (self.s_lo, self.s_hi))
        none = np.iinfo(np.int64).min if scores.dtype == np.int64 else scores.dtype.type(-np.inf)
        fine = (scores >= low) & (scores <= high) & (self.ids[:, None] != ids[None, :])
        best = np.partition(np.where(fine, scores, none), -need, axis=1)[:, -need]
        i = np.flatnonzero(self.by_score & (best > none))
        self.cut(i, self.bins(i, best[i].astype(np.int64)))

    def count(self, r: _Side, ids: np.ndarray) -> None:
        scores = _scores(self.side, r)
        if not self.met:
            self.first_cut(scores, ids)
        i, j = _reaching(scores, self.floor)
        s, own, by = scores[i, j].astype(np.int64), ids[j], self.by_score[i]
        fine = (own != self.ids[i]) & (s <= self.s_hi[i]) & (by | ((own >= self.i_lo[i]) & (own <= self.i_hi[i])))
        i, values = i[fine], np.where(by, s, own)[fine]
        bins = self.bins(i, values)
        near = bins <= self.last[i]
        i, bins = i[near], bins[near]
        if not len(i):
            return
        keys, place = np.unique(np.concatenate([self.keys, i * BINS + bins]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([self.counts, np.ones(len(i), np.int64)])).astype(np.int64)
        i = keys // BINS
        upto = np.cumsum(counts)
        upto -= (upto - counts)[np.searchsorted(i, i)]  # less what the queries before hold
        keep = upto - counts < self.need[i]
        full = keep & (upto >= self.need[i])
        self.keys, self.counts = keys[keep], counts[keep]
        self.cut(i[full], keys[full] % BINS)

    def histogram(self) -> tuple[np.ndarray, ...]:
        i, bins = self.keys // BINS, self.keys % BINS
        return self.ids[i], bins, *self.ends(i, bins), self.counts, self.need[i]

    def survivors(self, r: _Side, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        scores = _scores(self.side, r)
        i, j = _reaching(scores, self.s_lo)
        s, own = scores[i, j].astype(np.int64), ids[j]
        good = (own != self.ids[i]) & ((s > self.s_hi[i]) | (own <= self.i_hi[i]))
        return self.ids[i][good], own[good], s[good]


def _table(names: list[str], found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _parts(rows: list[dict], names: list[str], size: int, scale: int) -> Iterator[tuple]:
    """(vectors, longs of these names) of blocks of one dimension and width, joined and cut anew."""
    dim, width = rows[0]["dim"], rows[0]["width"]
    body, longs = b"".join(x["body"] for x in rows), [np.frombuffer(b"".join(x[c] for x in rows), np.int64) for c in names]
    for at in range(0, len(longs[0]), size):
        yield _Side(body[at * dim * width : (at + size) * dim * width], width, dim, scale), *(x[at : at + size] for x in longs)


def _cells(scale: int, last_pass: bool):
    """Of each cell first the blocks of queries come, which are held, then those of rows, one at a time."""
    names = ["query_id", "vec_id", "score"] if last_pass else ["query_id", "share", "bin", "low", "high", "n", "need"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, share, packed, held = None, 0, {}, {}

        def counted() -> Iterator[pa.RecordBatch]:
            for q in [q for x in held.values() for q in x if not last_pass]:
                ids, *columns = q.histogram()
                yield _table(names, [(ids, np.full(len(ids), share), *columns)])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["cell"] != cell:
                    yield from counted()
                    cell, share, packed, held = row["cell"], row["share"], {}, {}
                if not row["side"]:
                    packed.setdefault((row["dim"], row["width"]), []).append(row)
                    continue
                for (dim, _), blocks in packed.items():
                    held.setdefault(dim, []).extend(_Open(*x) for x in _parts(blocks, ["ids", *_STATE], _PRODUCT[0], scale))
                packed = {}
                if row["dim"] not in held:
                    continue
                for side, ids in _parts([row], ["ids"], _PRODUCT[1], scale):
                    found = [q.survivors(side, ids) if last_pass else q.count(side, ids) for q in held[row["dim"]]]
                    if last_pass:
                        yield _table(names, found)
        yield from counted()

    return run


def exact_top_k(
    df: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, scale: int = 256, query_block: int = 256, row_block: int = 4096
) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): the k best rows for each query, ties to the smaller id.

    Queries: rows whose id is divisible by ``every``.  Candidates: all rows but those with the query's id.  Score:
    integer inner product of floor(scale * x), or the nearest long to it.  Rows with a null id, a null vector, or a null or non-finite component
    take no part; vectors of different lengths are not compared, and empty ones give nothing.  Fewer candidates than k
    are all returned.  Of rows that repeat a query's id, one (the smallest vector) is the query; as candidates each
    row counts.
    """
    spark = df.sparkSession
    vectors = usable(df, id_col, vector_col)
    rows = stored(vectors.withColumn("share", F.lit(0)).mapInArrow(_blocks(row_block, [], scale), _BLOCK).drop("share"), "rows")
    largest = F.array_max(F.transform("vec", lambda v: F.abs(v)))
    limits = vectors.agg(F.max(largest).alias("top"), F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).first()
    top, first_id, last_id = limits["top"] or 0.0, limits["a"] or 0, limits["b"] or 0
    # A bound of every score, rounded up; the whole range of a long where it is beyond.
    reach = F.aggregate("vec", F.lit(0.0), lambda s, v: s + F.abs(v) * scale + 1) * F.lit(top * scale + 1) * F.lit(1 + 1e-9) + 1
    wide, near = reach >= 9e18, F.least(reach, F.lit(9e18)).cast("long")
    s_lo, s_hi = F.when(wide, F.lit(-(2**63))).otherwise(-near), F.when(wide, F.lit(2**63 - 1)).otherwise(near)
    queries = vectors.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("v"))
    queries = queries.select("id", "v.dim", "v.vec").select("*", s_lo.alias("s_lo"), s_hi.alias("s_hi"), F.lit(first_id).cast("long").alias("i_lo"), F.lit(last_id).cast("long").alias("i_hi"), F.lit(max(k, 1)).cast("long").alias("need"))
    queries = stored(queries, "queries")
    asked, n_blocks, cells = queries.count(), rows.count(), partitions(spark)
    # With this grid both sides together are copied as little as may be.
    across = max(1, min(cells, n_blocks, round(math.sqrt(cells * limits["n"] / max(1, asked)))))
    most = max(1, cells // across)

    def meet(open_queries: DataFrame, down: int) -> DataFrame:
        """The blocks of queries and rows, sorted by cell: a share of the rows, and of its queries one of ``down`` parts."""
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        one = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
        known = "shares" in open_queries.columns
        given = open_queries.select("*", (F.explode("shares") if known else F.lit(0)).alias("share"))
        packed = given.mapInArrow(_blocks(query_block, _STATE, scale), _BLOCK + "".join(f", {c} binary" for c in _STATE))
        sides = (packed if known else packed.drop("share").select("*", each(across).alias("share"))).select("*", F.lit(0).alias("side"), one(down).alias("down"))
        sides = sides.unionByName(rows.select("*", one(across).alias("share"), F.lit(1).alias("side"), each(down).alias("down")), allowMissingColumns=True)
        sides = sides.withColumn("cell", F.col("down") * across + F.col("share")).drop("block", "down")
        return sides.repartitionById(down * across, "cell").sortWithinPartitions("cell", "side")

    def parts(pairs: int) -> int:
        """Of so many pairs of a query and a share, a cell holds no more queries than one of the first round."""
        return max(1, math.ceil(most * pairs / (across * asked)))

    pending, done, pairs, in_all = queries, None, asked * across, 0
    while True:
        counts = meet(pending, parts(pairs) if asked else 1).mapInArrow(_cells(scale, False), "query_id long, share long, bin long, low long, high long, n long, need long")
        best_first = Window.partitionBy("query_id").orderBy("bin")
        before = F.coalesce(F.sum("n").over(best_first.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.select("*", before.alias("before"), F.sum("n").over(best_first).alias("upto")).filter("before < need")
        hit = F.max(F.struct("bin", "before", "upto", "low", "high")).alias("hit")
        met = counts.groupBy(F.col("query_id").alias("id")).agg(hit, F.collect_set(F.col("share").cast("int")).alias("met"))
        after = pending.join(met.hint("merge"), "id", "left")  # an estimated size would decide on a broadcast
        by_score = F.col("s_lo") < F.col("s_hi")
        s_lo, s_hi = (F.when(by_score, F.col(f"hit.{end}")).otherwise(F.col(c)) for end, c in (("low", "s_lo"), ("high", "s_hi")))
        i_lo, i_hi = (F.when(by_score, F.col(c)).otherwise(F.col(f"hit.{end}")) for end, c in (("low", "i_lo"), ("high", "i_hi")))
        short = F.col("hit").isNull() | (F.col("hit.upto") < F.col("need"))  # fewer rows than wanted: all of the interval count
        new = {"s_lo": s_lo, "s_hi": s_hi, "i_lo": i_lo, "i_hi": i_hi, "need": F.col("need") - F.col("hit.before")}
        narrow = short | (F.col("hit.upto") - F.col("hit.before") <= SLACK + F.col("need")) | ((s_lo == s_hi) & (i_lo == i_hi))
        shares = F.col("shares" if "shares" in pending.columns else "met").alias("shares")
        step = after.select("id", "dim", "vec", *[F.when(short, F.col(c)).otherwise(x).alias(c) for c, x in new.items()], shares, narrow.alias("narrow"))
        step = stored(step, "selection")
        found = step.filter("narrow").drop("narrow")
        done = found if done is None else done.unionByName(found)
        pending = step.filter("not narrow").drop("narrow")
        left = dict(step.groupBy("narrow").agg(F.sum(F.size(F.coalesce("shares", F.array().cast("array<int>"))))).collect())
        in_all, pairs = in_all + left.get(True, 0), left.get(False)
        if pairs is None:
            break
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kept = meet(done, parts(in_all) if asked else 1).mapInArrow(_cells(scale, True), "query_id long, vec_id long, score long")
    return kept.select("query_id", F.row_number().over(ranked).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
