"""Property tests (hypothesis): operators against their plain definitions."""

import math

from hypothesis import given, settings, HealthCheck
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tokenmill.operators import examples, order

_SETTINGS = dict(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))


@settings(**_SETTINGS)
@given(st.integers(1, 12), st.lists(st.lists(st.integers(0, 50), max_size=40), min_size=1, max_size=8))
def test_shift_pair_definition(spark, seq_len, lists):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lists)], "doc_id long, ids array<int>")
    got = {r.doc_id: (list(r.x), list(r.y)) for r in examples.shift_pair(df, seq_len, 3).collect()}
    for i, ids in enumerate(lists):
        t = ids + [3] * (seq_len - len(ids) + 1) if len(ids) <= seq_len else ids
        assert got[i] == (t[:seq_len], t[1:seq_len + 1])


@settings(**_SETTINGS)
@given(st.integers(0, 3000), st.integers(0, 10 ** 6))
def test_exact_split_sizes_and_disjoint(spark, n, seed):
    df = spark.range(n).withColumnRenamed("id", "k")
    rows = order.exact_split(df, ["k"], seed=seed).collect()
    assert len({r.k for r in rows}) == n == len(rows)
    n_hold = math.ceil(0.15 * n)
    n_test = math.ceil(0.25 * n_hold)
    c = {s: sum(1 for r in rows if r.split == s) for s in ("train", "val", "test")}
    assert c == {"train": n - n_hold, "val": n_hold - n_test, "test": n_test}


@settings(**_SETTINGS)
@given(st.integers(1, 200), st.integers(1, 16))
def test_rank_shards_cover_and_balance(spark, n, world):
    g = order.global_index(spark.range(n).withColumnRenamed("id", "k"), ["k"], seed=1, with_total="n")
    rows = order.rank_shards(g, world).collect()
    per_rank = {}
    for r in rows:
        per_rank.setdefault(r.rank, []).append(r.idx)
    assert set(per_rank) == set(range(world))
    assert {len(v) for v in per_rank.values()} == {math.ceil(n / world)}
    assert {i for v in per_rank.values() for i in v} == set(range(n))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.floats(-1e6, 1e6, allow_nan=False), st.integers(-100000, 100000).map(lambda i: i / 1000),
                          st.sampled_from([0.005, 0.125, 1.005, 1.015, 2.675, -1.015, 2.0 ** 53, 1e20])),
                min_size=1, max_size=300))
def test_fixed2_matches_python_formatting(spark, values):
    from tokenmill.operators.runlog import with_fixed2
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, v double")
    got = {r.i: r.s for r in with_fixed2(df, "v", "s").collect()}
    assert [got[i] for i in range(len(values))] == [f"{float(v):.2f}" for v in values]


def test_fixed2_keeps_the_sign_of_zero(spark):
    from tokenmill.operators.runlog import with_fixed2
    values = [-0.0, 0.0, -0.001, -0.004, 0.001, -1.0, float("-inf"), float("inf"), float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "i long, v double")
    got = {r.i: r.s for r in with_fixed2(df, "v", "s").collect()}
    assert [got[i] for i in range(len(values))] == [f"{v:.2f}" for v in values]
