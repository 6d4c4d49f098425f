"""Order without a global window.

A bare ``row_number() over (order by …)`` runs in one task. Here the
order is cut into pieces that preserve it — a prefix of the md5 sort key
(seeded orders) or range partitions of the composite key (key orders) —
only the per-piece counts (≤ a few thousand rows) are summed on one
partition, and the numbering inside each piece runs in parallel.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions.exprs import md5_key
from tokenmill.session import cut_lineage

_IDX = "idx"


#: Rows of a seeded order that one window group ranks, on average.
BUCKET_ROWS = 1_000_000


def bucket_digits(rows, bucket_rows: int = BUCKET_ROWS):
    """Hex digits of the hash for buckets of at most ``bucket_rows`` expected
    rows: 3 (4,096 buckets) or as many more as it takes."""
    out = F.lit(3)
    for k in range(4, 9):
        out = F.when(F.coalesce(rows, F.lit(0)) > F.lit(bucket_rows * 16 ** (k - 1)), F.lit(k)).otherwise(out)
    return out


def _offsets(counts: DataFrame, by: list[str]) -> DataFrame:
    """Exclusive prefix sums of bucket counts (+ group totals)."""
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    wt = Window.partitionBy(*by)
    return (counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
            .withColumn("_total", F.sum("_n").over(wt)).drop("_n"))


def global_index(df: DataFrame, keys: list[str], seed=None, by: list[str] | None = None,
                 idx_col: str = _IDX, bucket_hex: int | None = None, with_total: str | None = None,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Dense ``0…n-1`` position under a stated total order.

    ``seed`` given → order by ``(md5(seed[:by]:keys), keys)`` (a seeded shuffle);
    ``seed`` None → order by ``keys`` (a total order; any orderable types).
    ``by`` restarts the numbering per group (e.g. per epoch).

    A seeded order is ranked in buckets of about ``bucket_rows`` rows, whatever
    the table's size: the largest group's rows, counted in the same plan, give the number
    of hash digits that make a bucket (``bucket_hex`` sets it instead).
    """
    by = list(by or [])
    if seed is None:
        return _range_index(df, keys, by, idx_col, with_total)
    h = md5_key(seed, *by, *keys)
    digits = F.lit(bucket_hex) if bucket_hex else bucket_digits(
        df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).scalar(), bucket_rows)
    d = df.withColumn("_h", h).withColumn("_b", F.conv(F.substr("_h", F.lit(1), digits), 16, 10).cast("long"))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offs = _offsets(counts, by)
    # Offsets are one row per (group, bucket). The planner broadcasts them if
    # they are small; else the join shuffles on the keys the window needs anyway.
    w = Window.partitionBy(*by, "_b").orderBy("_h", *keys)
    out = (d.join(offs, on=[*by, "_b"], how="inner")
           .withColumn(idx_col, (F.row_number().over(w) - 1 + F.col("_off")).cast("long")))
    if with_total:
        out = out.withColumnRenamed("_total", with_total)
    return out.drop("_h", "_b", "_off", "_total")


def _range_index(df: DataFrame, keys: list[str], by: list[str], idx_col: str,
                 with_total: str | None) -> DataFrame:
    """Key order: range partitions on the whole composite key (sampled bounds
    split tie groups of the first key, so no bucket turns hot), sorted inside;
    a row's position is its place in its partition, plus the counts of the
    partitions before it.

    Positions depend on the row order inside each range partition, so the
    numbered rows are materialised once (reliable checkpoint): a recomputed
    range exchange could sample other bounds.
    """
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [*by, *keys]
    d = cut_lineage(df.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
                    .withColumn("_m", F.monotonically_increasing_id()))
    d = (d.withColumn("_b", F.shiftright("_m", 33))
         .withColumn("_r", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_r0"))
    # one row per (group, partition); broadcast by the planner if small
    offs = _offsets(counts, by)
    out = (d.join(offs, on=[*by, "_b"], how="inner")
           .withColumn(idx_col, (F.col("_off") + F.col("_r") - F.col("_r0")).cast("long")))
    if with_total:
        out = out.withColumnRenamed("_total", with_total)
    return out.drop("_m", "_b", "_r", "_r0", "_off", "_total")


def split_sizes(n: int, hold_out: float = 0.15, test_of_hold: float = 0.25) -> tuple[int, int, int]:
    """Two-stage split sizes: ``n_hold = ceil(0.15 n)``, ``test = ceil(0.25 n_hold)``."""
    n_hold = math.ceil(hold_out * n) if n else 0
    n_test = math.ceil(test_of_hold * n_hold) if n_hold else 0
    return n - n_hold, n_hold - n_test, n_test


def exact_split(df: DataFrame, keys: list[str], seed=42, hold_out: float = 0.15,
                test_of_hold: float = 0.25, split_col: str = "split") -> DataFrame:
    """Seeded split with exact sizes (85 / 11.25 / 3.75 by default).

    Positions ``[0, n_train)`` → train, then val, then test, under the
    seeded order of E1. Sizes are computed from the total in double
    arithmetic, on the executors (no driver round trip).

    No row moves: keys are counted per bucket of the order, only the two
    buckets that hold the first val and the first test row are ranked, and
    every row is compared with these two rows in a projection. ``keys``
    must be unique; rows of equal keys stay in one split.
    """
    key = F.struct(md5_key(seed, *keys).alias("_h"), *keys)
    d = df.select(key.alias("_k")).withColumn("_b", F.conv(F.substring("_k._h", 1, 3), 16, 10).cast("int"))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.count(F.lit(1)).alias("_size"))
    n = F.col("_total").cast("double")
    n_hold = F.ceil(F.lit(hold_out) * n)
    n_test = F.when(n_hold > 0, F.ceil(F.lit(test_of_hold) * n_hold)).otherwise(F.lit(0))
    buckets = (_offsets(counts, [])
               .withColumn("_val", F.col("_total") - n_hold).withColumn("_test", F.col("_total") - n_test))
    inside = lambda c: (F.col("_off") <= F.col(c)) & (F.col(c) < F.col("_off") + F.col("_size"))
    cut = buckets.filter(inside("_val") | inside("_test")).select("_b", "_off", "_val", "_test")
    w = Window.partitionBy("_b").orderBy("_k")
    # at most two buckets of the order are left
    near = d.join(F.broadcast(cut), "_b").withColumn("_idx", F.row_number().over(w) - 1 + F.col("_off"))
    val, test = (near.filter(F.col("_idx") == F.col(c)).select("_k").scalar() for c in ("_val", "_test"))
    return df.withColumn(split_col, F.when(test.isNotNull() & (key >= test), F.lit("test"))
                         .when(val.isNotNull() & (key >= val), F.lit("val")).otherwise(F.lit("train")))


def epoch_shuffle(df: DataFrame, keys: list[str], epochs: int, seed=42, shuffle: bool = True,
                  epoch_col: str = "epoch", idx_col: str = "pos") -> DataFrame:
    """One order per epoch (train: new seeded order; val: key order)."""
    d = df.withColumn(epoch_col, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if shuffle:
        return global_index(d, keys, seed=seed, by=[epoch_col], idx_col=idx_col)
    base = global_index(df, keys, seed=None, idx_col=idx_col)
    return base.withColumn(epoch_col, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def assign_batches(df: DataFrame, batch_size: int, idx_col: str = "pos",
                   batch_col: str = "batch_id", slot_col: str = "slot") -> DataFrame:
    """``batch = idx div B``, ``slot = idx mod B``; short last batch kept."""
    return (df.withColumn(batch_col, F.floor(F.col(idx_col) / batch_size).cast("long"))
            .withColumn(slot_col, (F.col(idx_col) % batch_size).cast("long")))


def rank_shards(df: DataFrame, world_size: int, idx_col: str = "idx", total_col: str = "n",
                rank_col: str = "rank") -> DataFrame:
    """E5: strided shard plan over ``world_size`` workers, padded by wrapping
    to the front so every rank gets ``ceil(n / W)`` positions.

    Needs ``idx`` (0…n-1) and the total ``n`` per row (see ``global_index``
    ``with_total``). Each row expands to its positions ``idx + k·n`` below
    ``ceil(n/W)·W`` — a generator, no join.
    """
    W = world_size
    n = F.col(total_col)
    total = F.ceil(n / F.lit(W)) * W
    reps = F.ceil(total / n).cast("int")
    d = df.withColumn("_k", F.explode(F.sequence(F.lit(0), reps - 1)))
    d = d.withColumn("global_pos", (F.col(idx_col) + F.col("_k") * n).cast("long")).filter(F.col("global_pos") < total)
    return (d.withColumn(rank_col, (F.col("global_pos") % W).cast("int"))
            .withColumn("rank_pos", F.floor(F.col("global_pos") / W).cast("long"))
            .drop("_k"))


def sample_lines(df: DataFrame, keys: list[str], n: int, seed=42, idx_col: str = "idx",
                 bucket_hex: int = 3) -> DataFrame:
    """Shuffle and keep at most ``n`` rows.

    Rows are counted per bucket of the seeded order; only the buckets that
    start before position ``n`` are kept, ranked and cut, which is ``n`` rows
    and at most one bucket more.
    """
    d = df.withColumn("_h", md5_key(seed, *keys)) \
        .withColumn("_b", F.conv(F.substring("_h", 1, bucket_hex), 16, 10).cast("int"))
    offs = _offsets(d.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")), [])
    last = offs.filter(F.col("_off") < n).agg(F.max("_b").alias("_b")).scalar()
    few = d.filter(F.col("_b") <= last)
    w = Window.partitionBy("_b").orderBy("_h", *keys)
    return (few.join(offs, "_b").withColumn(idx_col, (F.row_number().over(w) - 1 + F.col("_off")).cast("long"))
            .filter(F.col(idx_col) < n).drop("_h", "_b", "_off", "_total"))
