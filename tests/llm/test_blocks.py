import numpy as np
from pyspark.sql import functions as F

from siltstream.llm import minhash as M


def test_blocks_of_large_and_small_buckets_give_the_pairs_of_brute_force(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(-(2**62), 2**62, (40, 64))
    rows = []
    for key, size in ((1, 900), (2, 30), (3, 257)):
        for i in range(size):
            bits = base[draw.integers(40)].copy()
            bits[draw.integers(0, 64, draw.integers(0, 12))] ^= draw.integers(1, 2**40)
            rows.append((key, size, key * 10_000 + i, int(draw.integers(90, 140)), int(draw.integers(6)), bits.tolist()))
    members = spark.createDataFrame(rows, "key long, size long, rep long, n long, root long, bits array<long>")
    got = M.compare_members(M.deal_members(members).repartition(7), 75, 150).collect()
    want = set()
    planes = np.array([r[5] for r in rows]).view(np.uint64)
    for i, x in enumerate(rows):
        differ = planes ^ planes[i]
        bins = np.bitwise_count(differ[:, :32] | differ[:, 32:]).sum(axis=1)
        for j in np.flatnonzero(bins <= 150):
            y = rows[j]
            if x[0] == y[0] and x[2] < y[2] and x[4] != y[4] and min(x[3], y[3]) * 100 >= max(x[3], y[3]) * 75:
                want.add((x[2], y[2]))
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want and len(want) > 500


def test_a_block_without_members(spark):
    bits = [0] * 64
    members = spark.createDataFrame([(1, 2, 1, 100, 1, bits), (1, 2, 2, 100, 2, bits)], "key long, size long, rep long, n long, root long, bits array<long>")
    dealt = members.select("*", F.lit(3).alias("blocks"), F.lit(1).alias("block"))
    assert [tuple(r) for r in M.compare_members(dealt, 75, 10).collect()] == [(1, 2)]
