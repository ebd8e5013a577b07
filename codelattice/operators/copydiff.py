"""Differences between two copies of a data set.

Both copies are cut at the same split points into key ranges, each range is sorted by key and side, and one pass over the
sorted range merges the two sides: a key present on one side only is reported as missing, a key present on both has its
fields compared one by one.

Scale
    * Split points come from one column-pruned quantile sketch over the keys of both copies; at most one number a partition
      reaches the driver.
    * Before the shuffle each Arrow batch keeps only the newest row of a key, so that a key that holds a third of all rows
      shrinks to one row a batch.
    * The merge holds one batch and at most two rows carried over; a range may be of any length.

Defined results
    * Rows whose key is null are left out.
    * The newest row of a key (by ``newest``, nulls oldest, ties decided by ``ties`` and then by the compared fields) stands
      for the key. Repeated rows therefore count once.
    * A null differs from any value and not from a null. Empty tables give the other side's keys as missing.
    * Further columns, also of clashing names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.session import shuffle_width


@dataclass(frozen=True)
class Compared:
    """A field to compare: its name in the report, and its column or expression on either side.

    ``same`` maps a value to the form in which two spellings of it are equal; it is called only for values that differ.
    """

    name: str
    left: str | Column
    right: str | Column
    same: Callable[[object], object] | None = None


def _column(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def split_points(keys: DataFrame, key: str, parts: int) -> list:
    """At most ``parts - 1`` ascending keys that cut ``keys`` into ranges of about equal size."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    kind = keys.schema[key].dataType
    if isinstance(kind, T.NumericType | T.DateType | T.TimestampType):
        got = keys.agg(F.percentile_approx(key, at, max(10_000, 20 * parts)).alias("q")).first().q or []
    else:  # ordered, but without a sketch: a sample of a bounded size
        n = keys.count()
        some = keys.sample(min(1.0, 40.0 * parts / max(1, n)), seed=7).select(key).dropna().limit(200 * parts)
        some = sorted(r[0] for r in some.collect())
        got = [some[int(q * len(some))] for q in at] if some else []
    return sorted({x for x in got if x is not None})


def _order(batch: pa.Table, names: Sequence[str]) -> np.ndarray:
    """Rows by key and side, the newest first."""
    keys = [("key", "ascending"), ("side", "ascending"), *((n, "descending") for n in names)]
    return pc.sort_indices(batch, sort_keys=keys, null_placement="at_end").to_numpy()


def _first_of_runs(key: pa.ChunkedArray, side: pa.ChunkedArray) -> np.ndarray:
    k, s = key.combine_chunks() if isinstance(key, pa.ChunkedArray) else key, side.combine_chunks() if isinstance(side, pa.ChunkedArray) else side
    n = len(k)
    first = np.ones(n, bool)
    if n > 1:
        differs = pc.or_(pc.not_equal(k.slice(1), k.slice(0, n - 1)), pc.not_equal(s.slice(1), s.slice(0, n - 1)))
        first[1:] = differs.to_numpy(zero_copy_only=False)
    return first


def _newest_in_batch(order: Sequence[str], splits: list) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array(splits) if splits else None
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            t = t.take(pa.array(_order(t, order)))
            t = t.filter(pa.array(_first_of_runs(t["key"], t["side"])))
            if cuts is None:
                part = np.zeros(t.num_rows, np.int32)
            else:
                part = np.searchsorted(cuts, t["key"].to_numpy(), side="left").astype(np.int32)
            yield from t.append_column("part", pa.array(part, pa.int32())).combine_chunks().to_batches()

    return run


def _unequal(left: pa.Array, right: pa.Array, same: Callable | None) -> np.ndarray:
    """Where two columns differ, nulls being equal to nulls only."""
    raw = pc.fill_null(pc.not_equal(left, right), False).to_numpy(zero_copy_only=False)
    raw = raw | (pc.is_null(left).to_numpy(zero_copy_only=False) != pc.is_null(right).to_numpy(zero_copy_only=False))
    if same is not None and raw.any():
        at = np.flatnonzero(raw)
        pick = pa.array(at)
        raw[at] = [same(a) != same(b) for a, b in zip(left.take(pick).to_pylist(), right.take(pick).to_pylist(), strict=True)]
    return raw


def _merge(fields: Sequence[tuple[str, Callable | None]], missing: tuple[str, str], values: bool) -> Callable:
    """A pass over one sorted range: the run of a key on the left and that on the right meet, or one of them stands alone."""

    def report(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, side = t["key"].combine_chunks(), t["side"].combine_chunks().to_numpy()
        n = len(side)
        if not n:
            return
        same_as_next = np.zeros(n, bool)
        if n > 1:
            same_as_next[:-1] = pc.equal(key.slice(0, n - 1), key.slice(1)).to_numpy(zero_copy_only=False)
        same_as_last = np.concatenate([[False], same_as_next[:-1]])
        lone = ~same_as_next & ~same_as_last
        text = lambda name, at: pc.cast(t[name].take(pa.array(at)), pa.string()).combine_chunks()

        def rows(at: np.ndarray, what: str, left: pa.Array | None, right: pa.Array | None) -> pa.RecordBatch:
            cols = {"key": key.take(pa.array(at)), "difference": pa.array([what] * len(at), pa.string())}
            if values:
                none = pa.nulls(len(at), pa.string())
                cols |= {"left_value": none if left is None else left, "right_value": none if right is None else right}
            return pa.RecordBatch.from_pydict(cols)

        for s, what in ((0, missing[1]), (1, missing[0])):
            if len(at := np.flatnonzero(lone & (side == s))):
                yield rows(at, what, None, None)
        both = np.flatnonzero(same_as_next)
        if len(both):
            a, b = t.take(pa.array(both)), t.take(pa.array(both + 1))
            for i, (name, same) in enumerate(fields):
                hit = np.flatnonzero(_unequal(a[f"v{i}"].combine_chunks(), b[f"v{i}"].combine_chunks(), same))
                if len(hit):
                    yield rows(both[hit], name, text(f"v{i}", both[hit]) if values else None, text(f"v{i}", both[hit] + 1) if values else None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            if rest is not None:
                t = pa.concat_tables([rest, t])
            if not t.num_rows:
                continue
            t = t.filter(pa.array(_first_of_runs(t["key"], t["side"])))  # the range is sorted: the first of a run is the newest
            last = t["key"][t.num_rows - 1]
            held = 2 if t.num_rows > 1 and t["key"][t.num_rows - 2] == last else 1
            rest = t.slice(t.num_rows - held)
            yield from report(t.slice(0, t.num_rows - held))
        if rest is not None:
            yield from report(rest)

    return run


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    key: str,
    fields: Sequence[Compared],
    newest: Sequence[str] = (),
    missing: tuple[str, str] = ("missing_left", "missing_right"),
    values: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Rows ``(key, difference[, left_value, right_value])``, one for each missing key and each unequal field.

    ``newest`` names the columns, on both sides, by which the row that stands for a key is the greatest.
    """
    spark = left.sparkSession
    parts = partitions or shuffle_width(spark)
    order = [f"o{i}" for i in range(len(newest))] + [f"v{i}" for i in range(len(fields))]

    def shaped(df: DataFrame, side: int) -> DataFrame:
        return df.select(
            _column(key).alias("key"), F.lit(side).cast("tinyint").alias("side"),
            *(_column(c).alias(f"o{i}") for i, c in enumerate(newest)),
            *(_column(f.right if side else f.left).alias(f"v{i}") for i, f in enumerate(fields)),
        ).where(F.col("key").isNotNull())

    both = shaped(left, 0).unionByName(shaped(right, 1))
    splits = split_points(left.select(_column(key).alias("key")).unionByName(right.select(_column(key).alias("key"))), "key", parts)
    cut = both.mapInArrow(_newest_in_batch(order, splits), T.StructType([*both.schema.fields, T.StructField("part", T.IntegerType())]))
    ranges = cut.repartitionById(len(splits) + 1, F.col("part")).drop("part")
    ranges = ranges.sortWithinPartitions("key", "side", *(F.col(c).desc_nulls_last() for c in order))
    out = [T.StructField("key", both.schema["key"].dataType), T.StructField("difference", T.StringType())]
    out += [T.StructField(c, T.StringType()) for c in ("left_value", "right_value")] * values
    merge = _merge([(f.name, f.same) for f in fields], missing, values)
    return ranges.mapInArrow(merge, T.StructType(out)).withColumnRenamed("key", key)
