"""Filling fixed-capacity containers with items, certified by dual-feasible-function bounds.

Items are packed best-fit decreasing in partitions of bounded size. Dual-feasible functions bound from below the number
of containers a partition needs; a partition that uses no more is certified and left alone. In the others, containers
with gaps are opened together with some full ones, and their items are packed anew, by best fit and by exact complements;
what still has gaps is exchanged between partitions and packed again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caddis.session import cut

#: Items packed in one task, rounds of exchange between tasks, and draws of containers packed anew within one.
PARTITION_ITEMS, ROUNDS, DRAWS = 40_000, 2, 1_000


def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Containers needed at least by ``counts`` items of distinct ``sizes`` (each 0 to capacity).

    The greatest over two families of dual-feasible functions: u_k, which rounds a size to multiples of 1/k, and the
    threshold functions f_t, which take a size above C - t whole, drop one below t, and keep the rest.
    """
    if not len(sizes):
        return 0
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    best = int(-(-(sizes * counts).sum() // capacity))
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        # in units of 1 / (k * C): a whole multiple of C keeps its size, any other is rounded down
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, int(-(-(value * counts).sum() // (k * capacity))))
    order = np.argsort(sizes)
    s, n = sizes[order], counts[order]
    weight, number = np.concatenate(([0], np.cumsum(s * n))), np.concatenate(([0], np.cumsum(n)))
    t = np.unique(s[(s > 0) & (2 * s <= capacity)])
    low, high = np.searchsorted(s, t, "left"), np.searchsorted(s, capacity - t, "right")
    whole = (number[-1] - number[high]) * capacity + weight[high] - weight[low]
    return max([best, *(-(-whole // capacity)).tolist()])


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers). Each item goes to the fullest container that still holds it."""
    order = np.argsort(-sizes, kind="stable").tolist()
    values = sizes.tolist()
    bins = [0] * len(values)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by room left
    rooms, n = 0, 0  # rooms: the bits of those that some container has
    for i in order:
        size = values[i]
        above = rooms >> size
        if above:
            room = size + ((above & -above).bit_length() - 1)
            b = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
            room -= size
        else:
            b, room = n, capacity - size
            n += 1
        open_at[room].append(b)
        rooms |= 1 << room
        bins[i] = b
    return np.array(bins, np.int64), n


def exact_complements(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(container of each item, number of containers). Each container gets the largest item left, and then what fills it
    exactly: one item, else the least even pair, else the largest item that fits."""
    items: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        items[sizes[i]].append(i)
    has = np.array([bool(x) for x in items])
    bins, n, left, top = [0] * len(sizes), 0, len(sizes) - len(items[0]), capacity
    has[0] = False

    def take(size: int) -> None:
        bins[items[size].pop()] = n
        has[size] = bool(items[size])

    while left:
        while not items[top]:
            top -= 1
        take(top)
        left, room = left - 1, capacity - top
        while room and left:
            fill = [room] if has[room] else []
            if not fill:
                half = (room + 1) // 2
                pairs = has[half:room] & has[room - half : 0 : -1]
                if room % 2 == 0 and len(pairs) and len(items[half]) < 2:
                    pairs[0] = False
                at = np.flatnonzero(pairs)
                if len(at):
                    fill = [half + int(at[-1]), room - half - int(at[-1])]
            if not fill:
                at = np.flatnonzero(has[:room])
                if not len(at):
                    break
                fill = [int(at[-1])]
            for size in fill:
                take(size)
                left, room = left - 1, room - size
        n += 1
    n = max(n, 1 if len(sizes) else 0)  # items of no size take no room
    return np.array(bins, np.int64), n


def packed_partition(sizes: np.ndarray, capacity: int, draws: int = DRAWS, seed: int = 1) -> tuple[np.ndarray, int, int]:
    """(container of each item, number of containers, lower bound) of a partition.

    Best-fit decreasing, and if its bound isn't met, exact complements; the better one is then opened ``draws`` times:
    some containers with gaps and some full ones are packed anew, which is kept if it needs fewer, or as many and leaves
    the gaps more together.
    """
    distinct, counts = np.unique(sizes, return_counts=True)
    bound = lower_bound(distinct, counts, capacity)
    bins, n = best_fit_decreasing(sizes, capacity)
    if n <= bound:
        return bins, n, bound
    other, m = exact_complements(sizes, capacity)
    if m < n:
        bins, n = other, m
    rng = np.random.default_rng(seed)
    for turn in range(draws):
        if n <= bound:
            break
        room = capacity - np.bincount(bins, sizes, n)
        gaps, full = np.flatnonzero(room > 0), np.flatnonzero(room == 0)
        some = min(len(gaps), int(rng.integers(2, 400)))
        pick = np.sort(np.concatenate([rng.choice(gaps, some, replace=False), rng.choice(full, min(len(full), int(rng.integers(0, 3 * some + 2))), replace=False)]))
        rows = np.flatnonzero(np.isin(bins, pick))
        anew, count = (exact_complements if turn % 2 else best_fit_decreasing)(sizes[rows], capacity)
        left = capacity - np.bincount(anew, sizes[rows], count)
        if count < len(pick) or (count == len(pick) and (left**2).sum() >= (room[pick] ** 2).sum()):
            bins[rows] = pick[anew]
            if count < len(pick):
                used, bins = np.unique(bins, return_inverse=True)
                n = len(used)
    return bins, n, bound


def _pack(items: DataFrame, salt: int, buckets: dict[str, int], capacities: dict[str, int]) -> DataFrame:
    """Items with their container within a bucket, its room left, and whether the bucket is certified."""

    def run(pdf):
        kind = pdf["kind"].iloc[0]
        capacity = capacities[kind]
        sizes = pdf["size"].to_numpy()
        bins, n, bound = packed_partition(sizes, capacity)
        used = np.bincount(bins, sizes, n)
        out = pdf[["kind", "row", "piece", "size"]].copy()
        out["bin"] = bins
        out["room"] = (capacity - used[bins]).astype(np.int64)
        out["bucket"] = pdf["bucket"]
        out["certified"] = n <= bound
        # the emptiest container is open in any case: partitions that each meet their bound may not meet that of all
        out["last"] = bins == (capacity - used).argmax()
        return out

    number = F.create_map(*[x for k, b in buckets.items() for x in (F.lit(k), F.lit(b))])[F.col("kind")]
    placed = items.withColumn("bucket", F.pmod(F.xxhash64("row", "piece", F.lit(salt)), number).cast("int"))
    return placed.groupBy("kind", "bucket").applyInPandas(run, "kind string, row bigint, piece int, size bigint, bin bigint, room bigint, bucket int, certified boolean, last boolean")


def pack(items: DataFrame, capacities: dict[str, int], key: str = "doc_id", size: str = "tokens", rounds: int = ROUNDS, partition_items: int = PARTITION_ITEMS) -> DataFrame:
    """(container_kind, container_id, key, piece, pieces, size, capacity): every item in a container of every kind.

    For each kind of container, all items are packed. An item larger than the capacity is cut into as many full pieces
    as it fills, each in a container of its own, and a remainder, packed like any other item; no other item is cut. An
    item of size 0 (or null size, taken as 0) is one piece that takes no room. Repeated items and repeated or null keys
    are packed row by row. Kinds of equal capacity are packed alike; a kind with a null or non-positive capacity must be
    left out by the caller, else ValueError. An empty table gives no rows.

    Rows are numbered once in a checkpoint and spread over buckets by a hash of that number, so no key can make a bucket
    large. Each round keeps full containers and certified buckets, but for the emptiest container of each, and exchanges the
    rest between fewer, newly drawn buckets; a kind's exchange is kept only if it saves containers. A kind in a single bucket has no other to exchange
    with: its containers are opened and packed anew within the bucket (``packed_partition``).
    """
    if any(not c or c <= 0 for c in capacities.values()):
        raise ValueError("capacities must be positive")
    rows = cut(items.select(F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("_size"), F.monotonically_increasing_id().alias("row")))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in capacities.items()])
    each = rows.select("row", "_size", F.explode(kinds).alias("k")).select("row", "_size", "k.kind", "k.capacity")
    full, rest = F.floor(F.col("_size") / F.col("capacity")), F.col("_size") % F.col("capacity")
    whole = each.where("_size >= capacity").select("kind", "row", F.explode(F.sequence(F.lit(0), (full - 1).cast("int"))).alias("piece"), F.col("capacity").alias("size"))
    whole = whole.select("kind", "row", "piece", "size", F.concat_ws("-", "kind", F.lit("w"), "row", "piece").alias("container_id"))
    loose = each.where("_size < capacity OR _size % capacity > 0").select("kind", "row", full.cast("int").alias("piece"), rest.alias("size"))
    counts = {r["kind"]: r["count"] for r in loose.groupBy("kind").count().collect()}  # one row per kind
    done: list[DataFrame] = []
    left, numbers = loose, counts
    best: DataFrame | None = None
    for turn in range(rounds + 1):
        buckets = {k: max(1, -(-n // partition_items)) for k, n in numbers.items()}
        if not buckets:
            break
        packed = cut(_pack(left, turn, buckets, capacities)).withColumn("turn", F.lit(turn))
        name = F.concat_ws("-", "kind", "turn", "bucket", "bin").alias("container_id")
        if best is not None:  # what was exchanged, before and after, by kind
            containers = lambda df: {r[0]: r[1] for r in df.groupBy("kind").agg(F.countDistinct("turn", "bucket", "bin")).collect()}
            was, now = containers(best), containers(packed)
            saved = [k for k in now if now[k] < was[k]]
            lost = [k for k in now if k not in saved]
            if lost:
                done.append(best.where(F.col("kind").isin(lost)).select("kind", "row", "piece", "size", name))
            if not saved:
                best = None
                break
            packed = packed.where(F.col("kind").isin(saved))
        open_ = (~F.col("certified") | F.col("last")) & (F.col("room") > 0)
        done.append(packed.where(~open_).select("kind", "row", "piece", "size", name))
        best = packed.where(open_)
        numbers = {r["kind"]: r["count"] for r in best.groupBy("kind").count().collect()}
        # an exchange needs two buckets to draw from; a single bucket would be packed the same again
        alone = [k for k in numbers if buckets[k] < 2]
        if alone:
            done.append(best.where(F.col("kind").isin(alone)).select("kind", "row", "piece", "size", name))
            best = best.where(~F.col("kind").isin(alone))
            numbers = {k: n for k, n in numbers.items() if k not in alone}
        if not numbers:
            best = None
            break
        left = best.select("kind", "row", "piece", "size")
    if best is not None:
        done.append(best.select("kind", "row", "piece", "size", F.concat_ws("-", "kind", "turn", "bucket", "bin").alias("container_id")))
    for part in done:
        whole = whole.unionByName(part)
    capacity = F.create_map(*[x for k, c in capacities.items() for x in (F.lit(k), F.lit(c))])[F.col("kind")]
    pieces = F.greatest(F.ceil(F.col("_size") / F.col("capacity")), F.lit(1)).cast("int")
    return (
        whole.join(rows, "row")
        .select(F.col("kind").alias("container_kind"), "container_id", F.col("_key").alias(key), "piece", F.col("size"), capacity.cast("int").alias("capacity"), "_size")
        .select("container_kind", "container_id", key, "piece", pieces.alias("pieces"), "size", "capacity")
    )


def packing_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers used, tokens held, the least number of containers the bounds allow, and the share filled.

    Sizes are counted by value first; at most capacity + 1 rows per kind reach the task that evaluates the bounds.
    """

    def run(pdf):
        import pandas as pd

        capacity = int(pdf["capacity"].iloc[0])
        bound = lower_bound(pdf["size"].to_numpy(), pdf["n"].to_numpy(), capacity)
        return pd.DataFrame({"container_kind": [pdf["container_kind"].iloc[0]], "bound": [bound]})

    sizes = packed.groupBy("container_kind", "capacity", "size").agg(F.count("*").alias("n"))
    bounds = sizes.groupBy("container_kind").applyInPandas(run, "container_kind string, bound bigint")
    used = packed.groupBy("container_kind", "container_id", "capacity").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"))
    total = used.groupBy("container_kind", "capacity").agg(F.count("*").alias("containers"), F.sum("size").alias("tokens"), F.max("size").alias("fullest"), F.sum("pieces").alias("pieces"))
    return total.join(bounds, "container_kind").select("container_kind", "capacity", "containers", "bound", "tokens", "pieces", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"), "fullest")
