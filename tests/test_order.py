import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tokenmill.operators import order


def _md5(s):
    return hashlib.md5(s.encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 2, 7, 20, 1000])
def test_exact_split_sizes(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    got = {r.split: r.c for r in order.exact_split(df, ["k"], seed=42).groupBy("split").agg(F.count("*").alias("c")).collect()}
    n_hold = math.ceil(0.15 * n)
    n_test = math.ceil(0.25 * n_hold)
    want = {"train": n - n_hold, "val": n_hold - n_test, "test": n_test}
    assert {k: got.get(k, 0) for k in want} == want
    if n == 1000:
        assert want == {"train": 850, "val": 112, "test": 38}


def test_global_index_matches_sorted_hash(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    got = {r.k: r.idx for r in order.global_index(df, ["k"], seed=7, bucket_hex=2).collect()}
    want = sorted(range(500), key=lambda k: (_md5(f"7:{k}"), k))
    assert [got[k] for k in want] == list(range(500))


def test_global_index_unseeded_is_key_order(spark):
    df = spark.createDataFrame([(k,) for k in [5, 3, 9, 100, -2, 7]], "k long")
    got = sorted((r.idx, r.k) for r in order.global_index(df, ["k"]).collect())
    assert [k for _, k in got] == [-2, 3, 5, 7, 9, 100]


def test_epoch_shuffle_is_a_permutation_per_epoch(spark):
    df = spark.range(50).withColumnRenamed("id", "k")
    rows = order.epoch_shuffle(df, ["k"], epochs=3, seed=1).collect()
    for e in range(3):
        pos = sorted(r.pos for r in rows if r.epoch == e)
        assert pos == list(range(50))
    orders = [tuple(r.k for r in sorted((r for r in rows if r.epoch == e), key=lambda r: r.pos)) for e in range(3)]
    assert len(set(orders)) == 3


def test_rank_shards_wraps_to_equal_counts(spark):
    df = spark.createDataFrame([(i, i, 10) for i in range(10)], "k long, idx long, n long")
    rows = order.rank_shards(df, 4).collect()
    by_rank = {r: [x.idx for x in sorted((x for x in rows if x.rank == r), key=lambda x: x.rank_pos)] for r in range(4)}
    assert by_rank == {0: [0, 4, 8], 1: [1, 5, 9], 2: [2, 6, 0], 3: [3, 7, 1]}


def test_assign_batches_short_last_batch(spark):
    df = spark.range(70).withColumnRenamed("id", "pos")
    rows = order.assign_batches(df, 32).groupBy("batch_id").count().collect()
    assert sorted((r.batch_id, r["count"]) for r in rows) == [(0, 32), (1, 32), (2, 6)]


@pytest.mark.parametrize("bucket_hex", [1, 3])
@pytest.mark.parametrize("n", [0, 1, 40, 300, 500])
def test_sample_lines_is_the_front_of_the_seeded_order(spark, n, bucket_hex):
    df = spark.range(300).withColumnRenamed("id", "k")
    got = {r.k: r.idx for r in order.sample_lines(df, ["k"], n, seed=3, bucket_hex=bucket_hex).collect()}
    want = sorted(range(300), key=lambda k: (_md5(f"3:{k}"), k))[:n]
    assert got == {k: i for i, k in enumerate(want)}


def test_exact_split_membership_and_no_row_shuffle(spark):
    df = spark.range(400).select(F.col("id").alias("k"), F.array_repeat("id", 5).alias("ids"))
    split = order.exact_split(df, ["k"], seed=9)
    want = sorted(range(400), key=lambda k: (_md5(f"9:{k}"), k))
    name = {k: "train" if i < 340 else "val" if i < 385 else "test" for i, k in enumerate(want)}
    assert {r.k: r.split for r in split.collect()} == name
    # the token lists are only projected: every exchange belongs to the key subqueries
    rows = split._jdf.queryExecution().optimizedPlan().toString().split("scalar-subquery")[0]
    assert "Join" not in rows and "Window" not in rows and "Aggregate" not in rows


def test_split_counts_of_an_empty_table(spark):
    from tokenmill.operators import profile
    df = spark.createDataFrame([], "split string")
    assert [tuple(r) for r in profile.split_counts(df).collect()] == [("all", 0)]


def test_key_order_with_a_hot_first_key(spark):
    # a third of the rows share the first key; the second key is a string
    rows = [(1 if i % 3 == 0 else i, f"p{i * 7919 % 10007:05d}") for i in range(3000)]
    df = spark.createDataFrame(rows, "score long, piece string")
    got = {(r.score, r.piece): r.idx for r in order.global_index(df, ["score", "piece"]).collect()}
    want = sorted(rows)
    assert [got[k] for k in want] == list(range(len(rows)))


def test_buckets_grow_with_the_rows(spark):
    df = spark.createDataFrame([(0,), (1,), (4096,), (4097,), (10 ** 12,)], "n long")
    assert [r.d for r in df.select(order.bucket_digits(F.col("n"), 1).alias("d")).collect()] == [3, 3, 3, 4, 8]
    assert [r.d for r in df.select(order.bucket_digits(F.col("n")).alias("d")).collect()] == [3, 3, 3, 3, 5]
    rows = spark.range(9000).withColumnRenamed("id", "k").withColumn("g", F.col("k") % 2)
    fine = order.global_index(rows, ["k"], seed=7, by=["g"], bucket_rows=1)
    assert fine.exceptAll(order.global_index(rows, ["k"], seed=7, by=["g"], bucket_hex=1)).isEmpty()
    assert order.global_index(rows.limit(0), ["k"], seed=7).isEmpty()
