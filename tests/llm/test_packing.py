import itertools
import random

import numpy as np
import pytest

from lodemap.llm import packing as P


def cheapest(lengths, capacities):
    """Least cost of any packing, by trying all set partitions."""
    best = float("inf")

    def place(i, bins):
        nonlocal best
        if i == len(lengths):
            best = min(best, sum(P.cost(min(c for c in capacities if c >= b)) for b in bins))
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= max(capacities):
                bins[j] += lengths[i]
                place(i + 1, bins)
                bins[j] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def test_near_the_optimum():
    r = random.Random(6)
    for _ in range(60):
        lengths = sorted((r.randrange(1, 1025) for _ in range(r.randrange(1, 8))), reverse=True)
        _, used, size = P.pack_shard(np.array(lengths), (256, 512, 1024))
        assert sum(used) == sum(lengths)
        assert P.cost(size.astype(float)).sum() <= 1.25 * cheapest(lengths, (256, 512, 1024)) + 1e-9


def test_best_fit_takes_the_tightest_bin():
    bins, sizes = P.best_fit(np.array([900, 600, 400, 100]), (1000,))
    assert bins.tolist() == [0, 1, 1, 0] and sizes.tolist() == [1000, 1000]
    used, size = P.shrink(np.array([0, 1, 1]), np.array([700, 100, 150]), (256, 512, 1024))
    assert used.tolist() == [700, 250] and size.tolist() == [1024, 256]


@pytest.mark.parametrize("shard", [4_000_000, 3000])
def test_every_token_is_packed_once(monkeypatch, make, prose, odd_rows, shard):
    monkeypatch.setattr(P, "SHARD_TOKENS", shard)
    rows = odd_rows + [(100 + i, prose(i, 5 + i * 7)) for i in range(80)]
    bins = P.pack_documents(make(rows).repartition(3), (128, 256, 512)).collect()
    assert len({b.bin_id for b in bins}) == len(bins)
    got = []
    for b in bins:
        assert b.used == sum(b.lengths) <= b.capacity and b.n_pieces == len(b.doc_ids) == len(b.starts) == len(b.lengths)
        assert b.capacity == min(c for c in (128, 256, 512) if c >= b.used)
        got += list(zip(b.doc_ids, b.starts, b.lengths, strict=True))
    want = []
    for i, t in rows:
        n = len((t or "").encode().split()) + 1
        want += [(i, s, min(512, n - s)) for s in range(0, n, 512)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lengths_that_are_no_lengths(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, -5), (None, 4), (4, 10)], "doc_id long, length long")
    (b,) = P.pack(df, (8, 16)).collect()
    assert sorted(zip(map(str, b.doc_ids), b.lengths, strict=True)) == [("4", 10), ("None", 4)] and b.capacity == 16
    assert P.pack(df.limit(0)).count() == 0 and P.pack(df.filter("length < 1")).columns == [x.name for x in P._BIN]


def test_policies_never_hurt():
    r = random.Random(1)
    lengths = np.array(sorted((int(r.paretovariate(1)) * 40 % 8192 + 1 for _ in range(2000)), reverse=True))
    best = P.cost(P.pack_shard(lengths, P.CAPACITIES)[2].astype(float)).sum()
    for least in itertools.chain([0], P.CAPACITIES):
        bins, _ = P.best_fit(lengths, P.CAPACITIES, least)
        assert best <= P.cost(P.shrink(bins, lengths, P.CAPACITIES)[1].astype(float)).sum() + 1e-6
