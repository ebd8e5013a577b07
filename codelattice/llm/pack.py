"""Filling containers of a fixed capacity with items of varying size.

Method: multiway differencing after Karmarkar and Karp. A partial partition is the vector of the loads of k containers; the
two partial partitions with the greatest spread are merged, the fullest containers of the one with the emptiest of the other,
until one is left. That gives k nearly equal loads; if the greatest exceeds the capacity, k rises, and the least k that holds
is taken.

Scale: items are spread over blocks by a hash of their id, so many that a block fills about ``BLOCK`` containers and holds at
most about ``ITEMS`` items. Items of the same id and size are counted first and spread by ``COPIES``, so that null or repeated ids
don't meet in one block. Blocks are packed independently, so no task grows with the corpus; what rounding up wastes is less
than one container in ``BLOCK``. Only ids and sizes are shuffled, never texts.

Defined results
    * An item above the capacity is cut into full pieces, each a container of its own, and a rest that is packed like an item.
      No other item is cut.
    * Null and empty texts have size 0 and are packed (they take no space). Null ids are items like others.
    * Repeated rows are items of their own. An empty table gives no rows; capacities below one are refused.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, ITEMS, COPIES = 96, 20_000, 16


def difference(sizes: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The container (0 to k - 1) of each item by multiway differencing into ``k``, and the greatest load."""
    n = len(sizes)
    if k == 1 or n == 0:
        return np.zeros(n, np.int64), int(sizes.sum())
    lone = np.zeros(k, np.int64)
    loads: dict[int, np.ndarray] = {}
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []
    down = np.arange(k - 1, -1, -1)

    def load(i: int) -> np.ndarray:
        if i >= n:
            return loads.pop(i)
        v = lone.copy()
        v[0] = sizes[i]
        return v

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = load(a) + load(b)[down]  # loads are kept in falling order: the fullest meets the emptiest
        order = np.argsort(-both, kind="stable")
        both = both[order]
        node = n + len(merged)
        merged.append((a, b, order))
        loads[node] = both
        heapq.heappush(heap, (-int(both[0] - both[-1]), node))
    root = heap[0][1]
    greatest = int(load(root)[0])
    place = {root: np.arange(k)}
    at = np.zeros(n, np.int64)
    for node in range(n + len(merged) - 1, n - 1, -1):
        a, b, order = merged[node - n]
        mine, first, second = place.pop(node), np.empty(k, np.int64), np.empty(k, np.int64)
        first[order] = mine
        second[k - 1 - order] = mine
        for child, slots in ((a, first), (b, second)):
            if child < n:
                at[child] = slots[0]
            else:
                place[child] = slots
    return at, greatest


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, none above ``capacity``, as few as differencing finds. No size may exceed the capacity."""
    out = np.zeros(len(sizes), np.int64)
    some = np.flatnonzero(sizes > 0)  # items of size 0 take no space and go to the first container
    if not len(some):
        return out
    items = sizes[some].astype(np.int64)
    low = max(1, -(-int(items.sum()) // capacity))
    step, k, best = 1, low, None
    while best is None:
        at, greatest = difference(items, k)
        if greatest <= capacity:
            best = at
        else:
            low, k, step = k + 1, min(len(items), k + step), step * 2
    high = k
    while low < high:  # between the last k that failed and the first that held
        k = (low + high) // 2
        at, greatest = difference(items, k)
        if greatest <= capacity:
            best, high = at, k
        else:
            low = k + 1
    out[some] = best
    return out


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    """One block: its rests are packed, its full pieces get containers after those."""
    pdf = pdf.sort_values(["n_tokens", "_id"], ascending=[False, True], kind="stable")
    pdf = pdf.loc[pdf.index.repeat(pdf["copies"])].reset_index(drop=True)
    cap = int(pdf["capacity"].iloc[0])
    sizes = pdf["n_tokens"].to_numpy(np.int64)
    full = np.where(sizes > cap, sizes // cap, 0)
    rest = sizes - full * cap
    packs = (full == 0) | (rest > 0)
    at = np.full(len(pdf), -1, np.int64)
    at[packs] = fill(rest[packs], cap)
    used = int(at.max()) + 1
    i = np.repeat(np.arange(len(pdf)), full)
    piece = np.arange(len(i)) - np.repeat(np.cumsum(full) - full, full)
    j = np.flatnonzero(packs)
    rows = np.concatenate([j, i])
    return pd.DataFrame({
        "window_id": pdf["window_id"].to_numpy()[rows], "block": pdf["block"].to_numpy()[rows],
        "container": np.concatenate([at[j], used + np.arange(len(i))]), "id": pdf["id"].to_numpy()[rows],
        "piece": np.concatenate([full[j], piece]).astype(np.int32), "first_token": np.concatenate([full[j] * cap, piece * cap]),
        "n_tokens": np.concatenate([rest[j], np.full(len(i), cap)]),
    })


def pack(items: DataFrame, id_col: str, size_col: str, windows: DataFrame) -> DataFrame:
    """``(window_id, container, id_col, piece, first_token, n_tokens)`` for each of the (few) ``windows``.

    ``container`` is a string ``block-number``, unique within the window.
    """
    kind = items.schema[id_col].dataType.simpleString()
    sized = items.select(F.col(f"`{id_col}`").alias("id"), F.greatest(F.coalesce(F.col(f"`{size_col}`"), F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens"))
    caps = windows.select("window_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct().collect()  # a handful by definition
    total = sized.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).first()
    if any(c.capacity is None or c.capacity < 1 for c in caps):
        raise ValueError("a container needs a capacity of at least one")
    plan = [(c.window_id, c.capacity, max(1, round((total.t or 0) / (BLOCK * c.capacity)), -(-total.n // ITEMS))) for c in caps]
    if not plan:
        plan = [(None, 1, 1)]
        sized = sized.limit(0)
    each = F.explode(F.array(*(F.struct(F.lit(w).cast("int").alias("window_id"), F.lit(c).cast("bigint").alias("capacity"), F.lit(b).cast("bigint").alias("blocks")) for w, c, b in plan)))
    lots = sized.groupBy("id", "n_tokens").agg(F.count("*").alias("n")).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") - 1).cast("bigint"), F.lit(COPIES).cast("bigint"))))
    blocks = lots.withColumn("w", each).select(
        "w.window_id", "w.capacity", F.pmod(F.xxhash64("id", "w.window_id", "lot"), F.col("w.blocks")).alias("block"), "id", "n_tokens", F.xxhash64("id").alias("_id"),
        F.least(F.col("n") - F.col("lot"), F.lit(COPIES)).alias("copies"),
    )
    out = f"window_id int, block bigint, container bigint, id {kind}, piece int, first_token bigint, n_tokens bigint"
    packed = blocks.groupBy("window_id", "block").applyInPandas(_packed, out)
    return packed.select("window_id", F.concat_ws("-", "block", "container").alias("container"), F.col("id").alias(id_col), "piece", "first_token", "n_tokens")
