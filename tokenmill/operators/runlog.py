"""Run-log analysis (K1–K5) over a metric table ``(run, epoch, val_loss …)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lr_schedule(epochs: DataFrame, lr: float = 1e-4, gamma: float = 0.85, epoch: str = "epoch") -> DataFrame:
    """K1: step decay every epoch, ``lr · gamma^epoch``."""
    return epochs.withColumn("lr", F.lit(lr) * F.pow(F.lit(gamma), F.col(epoch).cast("double")))


def best_checkpoints(log: DataFrame, k: int = 3, run: str = "run", epoch: str = "epoch",
                     monitor: str = "val_loss") -> DataFrame:
    """K2: the ``k`` lowest ``monitor`` values per run, ties to the earlier epoch.

    ``row_number() ≤ k`` plans a per-partition group limit before the sort.
    """
    w = Window.partitionBy(run).orderBy(F.col(monitor).asc(), F.col(epoch).asc())
    return log.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def early_stop_epoch(log: DataFrame, patience: int = 5, run: str = "run", epoch: str = "epoch",
                     monitor: str = "val_loss") -> DataFrame:
    """K3: first epoch where ``patience`` checks in a row brought no strictly
    lower ``monitor``; NULL when training ran to the end.

    Counts checks (rows), not epoch values, so skipped epochs are fine.
    """
    w = Window.partitionBy(run).orderBy(epoch)
    prev_best = F.min(monitor).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = (log.withColumn("_chk", F.row_number().over(w))
         .withColumn("_improved", prev_best.isNull() | (F.col(monitor) < prev_best)))
    d = d.withColumn("_last_imp", F.max(F.when(F.col("_improved"), F.col("_chk"))).over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_wait", F.col("_chk") - F.col("_last_imp"))
    stops = d.groupBy(run).agg(
        F.min(F.when(F.col("_wait") >= patience, F.col(epoch))).alias("stop_epoch"),
        F.count(F.lit(1)).alias("n_checks"))
    return stops


def with_fixed2(df: DataFrame, col: str, out: str) -> DataFrame:
    """``out = f"{col:.2f}"`` as Python (and C) print it: the exact binary
    value rounded half to even. Spark's ``format_string`` rounds the
    shortest decimal form half-up, which differs on ties such as 1.015.

    Exact 64-bit integer arithmetic, no Python: ``|v| = M / 2**k`` with an
    integer mantissa ``M`` in ``[2**52, 2**53)``; cents are ``(100·M) div 2**k``
    and twice the remainder against ``2**k`` settles the rounding.
    """
    v = F.col(col).cast("double")
    a = F.abs(v)
    normal = (a >= F.lit(2.0 ** -8)) & (a < F.lit(2.0 ** 53))  # else: 0 cents, or already whole
    d = df.withColumn("_a", F.when(normal, a).otherwise(F.lit(1.0)))
    d = d.withColumn("_k0", (F.lit(52) - F.floor(F.log2("_a"))).cast("int"))
    scaled = F.col("_a") * F.pow(F.lit(2.0), F.col("_k0"))
    # log2 can be off by one next to a power of two: put M in [2^52, 2^53)
    d = d.withColumn("_k", F.when(scaled >= F.lit(2.0 ** 53), F.col("_k0") - 1)
                     .when(scaled < F.lit(2.0 ** 52), F.col("_k0") + 1).otherwise(F.col("_k0")))
    d = (d.withColumn("_m", (F.col("_a") * F.pow(F.lit(2.0), F.col("_k"))).cast("long"))
         .withColumn("_p", F.expr("shiftleft(1L, _k)")))
    d = d.withColumn("_q", F.expr("(_m * 100) div _p")).withColumn("_r", F.expr("_m * 100 - _q * _p"))
    half = (F.when(F.col("_r") * 2 > F.col("_p"), 1).when(F.col("_r") * 2 < F.col("_p"), 0)
            .otherwise(F.col("_q") % 2))
    cents = F.when(a < F.lit(2.0 ** -8), F.lit(0).cast("long")).otherwise(F.col("_q") + half)
    sign = F.when(v.cast("string").startswith("-"), F.lit("-")).otherwise(F.lit(""))   # -0.0 too
    small = F.concat(sign, (cents / 100).cast("long").cast("string"), F.lit("."),
                     F.lpad((cents % 100).cast("string"), 2, "0"))
    text = (F.when(F.isnan(v), F.lit("nan"))
            .when(a == F.lit(float("inf")), F.concat(sign, F.lit("inf")))
            .when(a >= F.lit(2.0 ** 53), F.format_string("%.2f", v))  # whole numbers: exact either way
            .otherwise(small))
    return d.withColumn(out, text).drop("_a", "_k0", "_k", "_m", "_p", "_q", "_r")


def checkpoint_name(df: DataFrame, epoch: str = "epoch", monitor: str = "val_loss",
                    prefix: str = "model") -> DataFrame:
    """K4: ``model-epoch=<e>-val_loss=<v:.2f>`` (Python's float formatting)."""
    d = with_fixed2(df, monitor, "_v2")
    return d.withColumn("ckpt_name", F.concat(F.lit(f"{prefix}-epoch="), F.col(epoch).cast("string"),
                                              F.lit(f"-{monitor}="), F.col("_v2"))).drop("_v2")


def checkpoint_path(df: DataFrame, folder: str, epoch: str = "epoch", prefix: str = "model") -> DataFrame:
    """K4, second form: ``<folder>-<model>/<model>-<epoch>.pt``."""
    return df.withColumn("ckpt_path", F.concat(F.lit(f"{folder}-{prefix}/{prefix}-"), F.col(epoch).cast("string"),
                                               F.lit(".pt")))


def run_stamp(df: DataFrame, ts: str = "ts", out: str = "stamp") -> DataFrame:
    """K5: ``%Y-%m-%d-%I:%M:%S_%p``."""
    return df.withColumn(out, F.date_format(F.col(ts), "yyyy-MM-dd-hh:mm:ss_a"))
