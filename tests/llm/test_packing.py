import itertools
import random

import numpy as np
import pytest

from caddis.llm.packing import best_fit_decreasing, exact_complements, lower_bound, pack, packed_partition, packing_report

SCHEMA = "doc_id bigint, tokens int, row int, kind string, size int"


def least(sizes, capacity):
    """Containers needed, by trying every assignment of a few items."""
    for n in range(1, len(sizes) + 1):
        for way in itertools.product(range(n), repeat=len(sizes)):
            if all(sum(s for s, w in zip(sizes, way) if w == b) <= capacity for b in range(n)):
                return n
    return 0


def test_bound_never_exceeds_what_is_needed():
    rng = random.Random(6)
    tight = 0
    for _ in range(60):
        capacity = rng.randrange(5, 30)
        sizes = [rng.randrange(0, capacity + 1) for _ in range(rng.randrange(1, 6))]
        bound, real = lower_bound(np.array(sizes), np.ones(len(sizes), int), capacity), least(sizes, capacity)
        assert bound <= real
        tight += bound == real or sum(sizes) == 0
        bins, n = best_fit_decreasing(np.array(sizes), capacity)
        assert n >= real and max(np.bincount(bins, sizes)) <= capacity
        for bins, n in (exact_complements(np.array(sizes), capacity), packed_partition(np.array(sizes), capacity)[:2]):
            assert n >= real and max(np.bincount(bins, sizes)) <= capacity and len(bins) == len(sizes)
    assert tight > 40


def test_bound_sees_more_than_the_sum():
    assert lower_bound(np.array([6]), np.array([5]), 10) == 5  # of size over half, each needs its own
    assert lower_bound(np.array([34]), np.array([6]), 100) == 3


def test_every_item_is_packed_whole(spark):
    rng = random.Random(7)
    data = [(i % 50 if i < 200 else i, rng.choice([0, None, 1, 40, 99, 100, 101, 250, 1000, rng.randrange(120)]), 1, "x", 2) for i in range(600)]
    df = spark.createDataFrame(data, SCHEMA)
    packed = pack(df, {"s": 100, "m": 300}, partition_items=60).toPandas()
    for kind, capacity in (("s", 100), ("m", 300)):
        p = packed[packed.container_kind == kind]
        assert p.groupby("container_id")["size"].sum().max() <= capacity
        assert p["size"].sum() == sum(d[1] or 0 for d in data)
        assert (p.piece == 0).sum() == len(data)
        assert len(p) == sum(max(1, -(-(d[1] or 0) // capacity)) for d in data)
        assert (p["size"][p.pieces > 1][p.piece < p.pieces - 1] == capacity).all()
        need = -(-sum(d[1] or 0 for d in data) // capacity)
        assert p.container_id.nunique() <= 1.1 * need + 2
    report = packing_report(pack(df, {"s": 100})).collect()[0]
    assert report["containers"] >= report["bound"] and report["filled"] > 0.9


def test_empty_and_bad_capacity(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert pack(df, {"s": 100}).count() == 0
    with pytest.raises(ValueError):
        pack(df, {"s": 0})
    assert pack(spark.createDataFrame([(1, 0, 0, "", 0), (None, None, 0, "", 0)], SCHEMA), {"s": 5}).count() == 2


def test_packing_anew_saves_containers_within_one_partition():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 128, 6000)
    plain = best_fit_decreasing(sizes, 128)[1]
    bins, n, bound = packed_partition(sizes, 128)
    assert bound <= n < plain and np.bincount(bins, sizes).max() <= 128 and len(np.unique(bins)) == n


def test_exchange_between_partitions_saves_containers(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(i, rng.randrange(30, 70), 1, "x", 2) for i in range(900)], SCHEMA)
    used = [pack(df, {"s": 100}, partition_items=90, rounds=r).select("container_id").distinct().count() for r in (0, 2)]
    assert used[1] < used[0]
