import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelattice.llm import pack


def test_differencing_balances():
    at, most = pack.difference(np.array([8, 7, 6, 5, 4]), 2)
    assert sorted(at.tolist()) == [0, 0, 0, 1, 1] and most == 16  # 8+6 against 7+5+4
    rnd = random.Random(1)
    sizes = np.array([rnd.randrange(1, 500) for _ in range(400)])
    at, most = pack.difference(sizes, 10)
    loads = np.bincount(at, sizes, 10)
    assert most == loads.max() and loads.max() - loads.min() <= 3


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=60), st.integers(60, 130))
def test_fill_holds_the_capacity(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    at = pack.fill(sizes, capacity)
    loads = np.bincount(at, sizes) if len(sizes) else np.zeros(1)
    assert loads.max() <= capacity
    assert len(loads) <= 2 * -(-int(sizes.sum()) // capacity) + 1


def test_frame(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([0, 1, 5, 90, 99, 100, 101, 250, 1000])) for i in range(3000)] + [(None, 7), (5, 40), (5, 40), (9999, None)]
    items = spark.createDataFrame(rows, "doc_id bigint, n int")
    windows = spark.createDataFrame([(1, "a", 100), (2, "b", 1000), (2, "b", 1000)], "window_id int, purpose string, capacity_tokens int")
    got = pack.pack(items, "doc_id", "n", windows).cache()
    per = got.groupBy("window_id", "container").agg(F.sum("n_tokens").alias("t"))
    assert {r.window_id: r.m for r in per.groupBy("window_id").agg(F.max("t").alias("m")).collect()} == {1: 100, 2: 1000}
    total = sum(n or 0 for _, n in rows)
    assert [r.t for r in got.groupBy("window_id").agg(F.sum("n_tokens").alias("t")).collect()] == [total, total]
    w1 = got.where("window_id = 1")
    cut = w1.groupBy("doc_id").agg(F.countDistinct("piece").alias("pieces"), F.sum("n_tokens").alias("t")).where("doc_id < 3000 AND doc_id <> 5")
    sizes = dict(rows[:3000])
    for r in cut.collect():
        assert r.t == sizes[r.doc_id] and r.pieces == max(1, -(-sizes[r.doc_id] // 100))
    used = per.groupBy("window_id").count().collect()
    assert all(r["count"] <= 1.06 * total / {1: 100, 2: 1000}[r.window_id] + 4 for r in used if r.window_id == 2)


def test_edges(spark):
    windows = spark.createDataFrame([(1, 10)], "window_id int, capacity_tokens int")
    assert pack.pack(spark.createDataFrame([], "id string, n int"), "id", "n", windows).count() == 0
    assert pack.pack(spark.createDataFrame([("a", 25)], "id string, n int"), "id", "n", windows).count() == 3
    with pytest.raises(ValueError):
        pack.pack(spark.createDataFrame([("a", 2)], "id string, n int"), "id", "n", windows.withColumn("capacity_tokens", F.lit(0)))
    assert pack.pack(spark.createDataFrame([("a", 2)], "id string, n int"), "id", "n", windows.limit(0)).count() == 0


def test_repeated_and_null_ids_spread(spark):
    """A third of all rows under one id, and as many under none: no block holds more than its share."""
    items = spark.range(60_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS doc_id", "100 AS n")
    windows = spark.createDataFrame([(1, 1000)], "window_id int, capacity_tokens int")
    got = pack.pack(items, "doc_id", "n", windows).cache()
    assert got.count() == 60_000 and got.where("doc_id = 7").count() == 20_000 and got.where("doc_id IS NULL").count() == 20_000
    blocks = got.groupBy(F.substring_index("container", "-", 1).alias("block")).count()
    top = blocks.agg(F.max("count"), F.count("*")).first()
    assert top[1] > 40 and top[0] < 3 * 60_000 / top[1]
    assert got.groupBy("container").agg(F.sum("n_tokens").alias("t")).agg(F.max("t")).first()[0] <= 1000
