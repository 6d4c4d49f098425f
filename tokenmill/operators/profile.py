"""Corpus profiles and run-metric aggregation.

All statistics are single-pass aggregates with map-side partial
aggregation; exact percentiles use Spark's ``percentile`` whose buffer
holds one counter per distinct value (lengths), not one entry per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.session import cut_lineage


def row_count(df: DataFrame) -> DataFrame:
    """D1."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def split_counts(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split plus an ``all`` row, from one pass (grouping sets);
    an empty table has the ``all`` row alone."""
    got = df.rollup(split_col).agg(F.count(F.lit(1)).alias("n_rows"), F.grouping(split_col).alias("_g"))
    got = got.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col(split_col)).alias(split_col), "n_rows")
    none = df.sparkSession.range(1).select(F.lit("all").alias(split_col), F.lit(0).cast("long").alias("n_rows"))
    return got.unionByName(none).groupBy(split_col).agg(F.sum("n_rows").alias("n_rows"))


def corpus_footprint(df: DataFrame, text: str | None = "text", ids: str | None = "ids") -> DataFrame:
    """D3: bytes held (UTF-8 text bytes, 4 bytes per id) and whole GiB."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if text:
        aggs.append(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("text_bytes"))
    if ids:
        aggs.append(F.coalesce(F.sum(F.size(ids) * 4), F.lit(0)).cast("long").alias("id_bytes"))
    out = df.agg(*aggs)
    for c in ("text_bytes", "id_bytes"):
        if c in out.columns:
            out = out.withColumn(c.replace("_bytes", "_gib"), (F.col(c) / F.pow(F.lit(2.0), 30)).cast("long"))
    return out


def lengths(df: DataFrame, ids: str = "ids", filter: bool = True, min_length: int = 0,
            max_length: int = 2000, out: str = "len") -> DataFrame:
    """Sequence lengths, optionally kept to ``[min_length, max_length]``."""
    d = df.withColumn(out, F.size(ids).cast("long"))
    if filter:
        d = d.filter(F.col(out).between(min_length, max_length))
    return d


def length_counts(len_df: DataFrame, col: str = "len") -> DataFrame:
    """``(len, c)``: one partial + final aggregation; its size is bounded by
    the number of distinct lengths, not by rows. It is checkpointed to the
    shared folder, so the data is scanned once and every statistic (scalar
    subqueries included) reads only this small table."""
    return cut_lineage(len_df.groupBy(F.col(col).alias("len")).agg(F.count(F.lit(1)).alias("c")))


def _fences(counts: DataFrame):
    q1 = counts.select(F.percentile("len", 0.25, F.col("c"))).scalar()
    q3 = counts.select(F.percentile("len", 0.75, F.col("c"))).scalar()
    return q1, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)


def length_summary(len_df: DataFrame, col: str = "len") -> DataFrame:
    """D4 + D7: range, rounded mean, median, rounded sample std, quartiles,
    IQR, outlier count and the mean ± 1, 2 std bands — in one row.

    Python's ``round`` is half-even, hence ``bround``. Everything is computed
    from the length → count table: exact percentiles with frequencies, the
    sample variance around the (scalar) mean.
    """
    counts = length_counts(len_df, col)
    n = F.sum("c")
    mean_raw = counts.select(F.sum(F.col("len") * F.col("c")) / F.sum("c")).scalar()
    q1, q3, lo, hi = _fences(counts)
    v = F.col("len")
    res = counts.agg(
        n.alias("n"),
        (F.max(v) - F.min(v)).cast("long").alias("range"),
        F.bround(F.sum(v * F.col("c")) / n, 0).cast("double").alias("mean"),
        F.percentile(v, 0.5, F.col("c")).cast("double").alias("median"),
        F.bround(F.sqrt(F.sum(F.col("c") * F.pow(v - mean_raw, 2)) / (n - 1)), 0).cast("double").alias("std"),
        F.sum(F.when((v < lo) | (v > hi), F.col("c")).otherwise(0)).alias("n_outliers"),
    ).withColumn("q1", q1.cast("double")).withColumn("q3", q3.cast("double"))
    res = res.withColumn("iqr", F.col("q3") - F.col("q1"))
    for k in (1, 2):
        res = (res.withColumn(f"band_lo{k}", F.col("mean") - k * F.col("std"))
               .withColumn(f"band_hi{k}", F.col("mean") + k * F.col("std")))
    return res


def length_outliers(len_df: DataFrame, col: str = "len") -> DataFrame:
    """Rows strictly outside ``[Q1 − 1.5·IQR, Q3 + 1.5·IQR]``."""
    v = F.col(col)
    _, _, lo, hi = _fences(length_counts(len_df, col))
    return len_df.filter((v < lo) | (v > hi))


def length_histogram(len_df: DataFrame, col: str = "len", bins: int = 100) -> DataFrame:
    """``bins`` equal-width bins over ``[min, max]``, last bin closed,
    empty bins present; ``min = max`` puts every row in the middle bin of a
    unit-wide range (as numpy does). Computed from the length → count table.
    """
    spark = len_df.sparkSession
    counts = length_counts(len_df, col)
    v = F.col("len").cast("double")
    mn = counts.select(F.min(v)).scalar()
    mx = counts.select(F.max(v)).scalar()
    nb = F.lit(float(bins))
    same = mx == mn
    b = F.when(same, F.lit(bins // 2)).otherwise(F.least(F.floor((v - mn) * nb / (mx - mn)), F.lit(bins - 1)))
    per_bin = counts.groupBy(b.cast("long").alias("bin")).agg(F.sum("c").alias("n"))
    bin_c = F.col("bin")
    lo_edge = F.when(same, mn - 0.5 + bin_c / nb).otherwise(mn + bin_c * (mx - mn) / nb)
    hi_edge = F.when(same, mn - 0.5 + (bin_c + 1) / nb).otherwise(mn + (bin_c + 1) * (mx - mn) / nb)
    grid = spark.range(bins).withColumnRenamed("id", "bin").filter(mn.isNotNull())
    return (grid.join(per_bin, on="bin", how="left")
            .select("bin", lo_edge.alias("lo"), hi_edge.alias("hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def epoch_metrics(log: DataFrame, metrics: list[str], by=("run", "epoch"),
                  weight: str | None = None) -> DataFrame:
    """Per-epoch (weighted) mean of each logged step metric."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    aggs = [(F.sum(F.col(m).cast("double") * w) / F.sum(F.when(F.col(m).isNotNull(), w))).alias(m)
            for m in metrics]
    return log.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("n_steps"))
