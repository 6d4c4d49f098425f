"""Scoring over logits.

Input rows hold ``logits ARRAY<DOUBLE>`` (one position) and a ``target``.
Per-row math uses higher-order array functions (no explode, no shuffle);
only the batch means group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def _per_element(l, scalar, fn):
    """Apply ``fn(v, scalar)`` to every element with ``scalar`` evaluated once
    per row (a scalar referenced inside a lambda is re-evaluated per element)."""
    return F.zip_with(l, F.array_repeat(scalar, F.size(l)), fn)


def _sum(arr) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def logsumexp(logits) -> Column:
    l = _c(logits)
    m = F.array_max(l)
    return m + F.log(_sum(_per_element(l, m, lambda v, mm: F.exp(v - mm))))


def softmax(logits, temperature: float = 1.0) -> Column:
    """``softmax(l / T)``, max-shifted; O(V) per row."""
    l = _c(logits)
    t = float(temperature)
    e = _per_element(l, F.array_max(l), lambda v, mm: F.exp((v - mm) / t))
    return _per_element(e, _sum(e), lambda x, z: x / z)


def token_loss(logits, target) -> Column:
    """Cross-entropy of one position: ``logsumexp − logit[target]``."""
    return logsumexp(logits) - F.element_at(_c(logits), _c(target) + 1)


def cross_entropy(df: DataFrame, by=("batch_id",), pad_id: int | None = None,
                  logits: str = "logits", target: str = "target") -> DataFrame:
    """Mean loss over targets ≠ pad per group; all-pad → NaN."""
    keep = F.col(target) != pad_id if pad_id is not None else F.lit(True)
    loss = F.when(keep, token_loss(logits, target))
    return df.groupBy(*by).agg(
        F.coalesce(F.avg(loss), F.lit(float("nan"))).alias("loss"),
        F.count(loss).alias("n_targets"))


def perplexity(batch_loss: DataFrame, by=(), loss: str = "loss") -> DataFrame:
    """Per-batch ``exp(loss)``; the epoch value is the mean of batch
    perplexities (not exp of the mean loss)."""
    d = batch_loss.withColumn("perplexity", F.exp(loss))
    return d.groupBy(*by).agg(F.avg(loss).alias("val_loss"), F.avg("perplexity").alias("val_perplexity"),
                              F.count(F.lit(1)).alias("n_batches"))


def argmax(logits) -> Column:
    """Arg-max id (lowest id wins ties)."""
    l = _c(logits)
    return (F.array_position(l, F.array_max(l)) - 1).cast("int")


def scaled_loss(loss, accumulation_steps: int) -> Column:
    """I4: the train loss as logged, divided by the accumulation steps."""
    return _c(loss) / F.lit(float(accumulation_steps))


def prediction_lines(decoded: DataFrame, epoch, text: str = "text") -> DataFrame:
    """``"<epoch>: <text>"``; ``epoch`` is a number or a Column."""
    e = epoch.cast("string") if isinstance(epoch, Column) else F.lit(str(epoch))
    return decoded.withColumn("line", F.concat(e, F.lit(": "), F.col(text)))
