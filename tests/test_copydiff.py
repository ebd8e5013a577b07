import random

from hypothesis import given, settings
from hypothesis import strategies as st

from codelattice.functions.callee import canonical_callee
from codelattice.operators.copydiff import Compared, diff_copies

SCHEMA = "k bigint, name string, line int, at int, extra string"
FIELDS = (Compared("name", "name", "name", canonical_callee), Compared("line", "line", "line"))


def run(spark, left, right, **more):
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    return sorted(tuple(r) for r in diff_copies(a, b, "k", FIELDS, newest=("at",), **more).collect())


def brute(left, right):
    def newest(rows):
        out = {}
        for r in rows:
            if r[0] is not None:
                low = (-(2**31),) if r[3] is None else (r[3],)
                key = (low, r[1] is not None, r[1] or "", r[2] is not None, r[2] or 0)
                if r[0] not in out or key > out[r[0]][0]:
                    out[r[0]] = (key, r)
        return {k: v[1] for k, v in out.items()}

    a, b = newest(left), newest(right)
    out = [(k, "missing_right") for k in a.keys() - b.keys()] + [(k, "missing_left") for k in b.keys() - a.keys()]
    for k in a.keys() & b.keys():
        if canonical_callee(a[k][1]) != canonical_callee(b[k][1]):
            out.append((k, "name"))
        if a[k][2] != b[k][2]:
            out.append((k, "line"))
    return sorted(out)


def test_every_case(spark):
    left = [(1, "a.B.c", 1, 1, "x"), (1, "a.B.c", 2, 2, "x"), (2, "(*a.B).c", 1, 1, None), (3, "a.f[int]", None, 1, "x"), (4, None, 4, 1, "x"), (None, "z", 1, 1, "x"), (5, "v/vendor/a.f", 1, 1, "x"), (8, "q", 1, 1, "x"), (8, "q", 1, 1, "x")]
    right = [(1, "a.B.c", 1, 1, "x"), (2, " a.B.c\t", 1, 1, "x"), (3, "a.f", 3, 1, "x"), (4, "", 4, 1, "x"), (5, "a.f", 1, 1, "x"), (6, "new", 1, 1, "x"), (None, "y", 1, 1, "x")]
    assert run(spark, left, right) == [(1, "line"), (3, "line"), (6, "missing_left"), (8, "missing_right")]


def test_values_are_reported(spark):
    assert run(spark, [(1, "a", 1, 1, "")], [(1, "b", None, 1, "")], values=True) == [(1, "line", "1", None), (1, "name", "a", "b")]


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [(1, "a", 1, 1, "")], []) == [(1, "missing_right")]
    assert run(spark, [], [(1, "a", 1, 1, "")]) == [(1, "missing_left")]


def test_a_hot_key_and_many_partitions(spark):
    rnd = random.Random(3)
    rows = lambda n: [(7 if rnd.random() < 0.4 else rnd.randrange(300), rnd.choice(["a.b", "a.c", None, ""]), rnd.choice([1, 2, None]), rnd.randrange(20), "e" * rnd.randrange(3)) for _ in range(n)]
    left, right = rows(1500), rows(1200)
    assert run(spark, left, right, partitions=13) == brute(left, right)


def test_string_keys(spark):
    a = spark.createDataFrame([(f"k{i}", i) for i in range(200)], "k string, v int")
    b = spark.createDataFrame([(f"k{i}", i + (i % 50 == 0)) for i in range(5, 205)], "k string, v int")
    got = {tuple(r) for r in diff_copies(a, b, "k", (Compared("v", "v", "v"),), partitions=5).collect()}
    assert got == {(f"k{i}", "missing_right") for i in range(5)} | {(f"k{i}", "missing_left") for i in range(200, 205)} | {(f"k{i}", "v") for i in (50, 100, 150)}


_row = st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.sampled_from([None, "", "a.b", "*a.b", "c"]), st.sampled_from([None, 1, 2]), st.sampled_from([None, 1, 2]), st.just("x"))


@settings(max_examples=8, deadline=None)
@given(st.lists(_row, max_size=12), st.lists(_row, max_size=12))
def test_against_brute_force(spark, left, right):
    assert run(spark, left, right) == brute(left, right)


def test_canonical_callee():
    for x in ("(*a/b.T).m", "*a/b.T.m", "a/b.(*T).m", "a/b.T[int].m", "a/b.T[map[string]int].m", " a/b.T.m\t", "x/y/vendor/a/b.T.m", "(a/b.T).m"):
        assert canonical_callee(x) == "a/b.T.m"
    assert canonical_callee(None) == canonical_callee("  ") == ""
    assert canonical_callee("a/b.T.M") != canonical_callee("a/b.T.m") and canonical_callee("m") != canonical_callee("a/b.T.m")
