"""Training-example builder (G1–G5): fixed-length next-token pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.exprs import once, pack_ids, pad_or_cut_expr, unpack_ids


def pad_or_cut(df: DataFrame, seq_len: int, pad_id: int, ids: str = "ids",
               out: str = "padded") -> DataFrame:
    """G1: length ``seq_len + 1`` per row (pad at the end or cut the tail)."""
    return df.withColumn(out, pad_or_cut_expr(ids, seq_len, pad_id))


def shift_pair(df: DataFrame, seq_len: int, pad_id: int, ids: str = "ids",
               x: str = "x", y: str = "y", keep_ids: bool = False) -> DataFrame:
    """G1 + G2: ``x = p[0:S]``, ``y = p[1:S+1]``; both length S."""
    p = pad_or_cut_expr(ids, seq_len, pad_id)
    d = df.withColumn("_p", p).withColumn(x, F.slice("_p", 1, seq_len)).withColumn(y, F.slice("_p", 2, seq_len))
    d = d.drop("_p")
    return d if keep_ids else d.drop(ids)


def loss_tokens(df: DataFrame, seq_len: int, pad_id: int, ids: str = "ids", y: str = "y") -> DataFrame:
    """Targets that count (≠ pad), padding share, tokens cut off."""
    n_tgt = F.size(F.filter(F.col(y), lambda t: t != pad_id))
    return (df.withColumn("n_targets", n_tgt.cast("long"))
            .withColumn("pad_share", (F.lit(seq_len) - F.col("n_targets")) / F.lit(float(seq_len)))
            .withColumn("n_cut", F.greatest(F.lit(0), F.size(ids) - F.lit(seq_len + 1)).cast("long")))


def check_examples(pairs: DataFrame, seq_len: int, x: str = "x", y: str = "y") -> DataFrame:
    """Every pair has length S, on all rows."""
    bad = (F.size(x) != seq_len) | (F.size(y) != seq_len)
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"),
                     F.count(F.when(bad, 1)).alias("n_bad"),
                     F.count(F.when(F.slice(x, 2, seq_len - 1) != F.slice(y, 1, seq_len - 1), 1))
                     .alias("n_misaligned"))


def build_batches(pairs: DataFrame, by=("epoch", "batch_id"), slot: str = "slot",
                  cols=("doc_id", "x", "y"), made=None) -> DataFrame:
    """Pairs grouped per batch in slot order.

    A batch holds at most ``batch_size`` pairs, so the collected group is
    bounded by construction. ``made`` maps columns to functions that make
    their values from the moved ones behind the exchange.
    """
    st = F.struct(F.col(slot), *[F.col(c) for c in cols])
    items = F.collect_list(st)
    if made:
        items = F.transform(items, lambda t: F.struct(t[slot].alias(slot), *[
            (made[c](t[c]) if c in made else t[c]).alias(c) for c in cols]))
    return (pairs.groupBy(*by).agg(F.array_sort(items).alias("_items"))
            .select(*by, *[F.col("_items")[c].alias(c) for c in cols],
                    F.size("_items").cast("long").alias("n_pairs")))


def epoch_batches(df: DataFrame, keys: list[str], epochs: int, batch_size: int, seq_len: int, pad_id: int,
                  seed=42, ids: str = "ids") -> DataFrame:
    """E3 → E4 → G1/G2 → G5 as one plan that moves little data.

    At most ``seq_len + 1`` ids are taken per row, whatever the document
    length, packed as bytes or shorts if they fit, the per-epoch order is computed on the keys
    alone, and the two meet in one join on the key: token lists are never replicated per
    epoch before the join. They are unpacked and padded, and ``x`` and ``y``
    sliced, behind the last exchange.
    """
    from tokenmill.operators.order import assign_batches, epoch_shuffle
    kind = df.schema[ids].dataType
    packed = df.select(*keys, pack_ids(F.slice(ids, 1, seq_len + 1)).alias("_p"))
    plan = assign_batches(epoch_shuffle(df.select(*keys), keys, epochs, seed=seed), batch_size)
    got = build_batches(plan.join(packed, on=keys, how="inner"), cols=(*keys, "_p"),
                        made={"_p": lambda p: once(unpack_ids(p, kind), lambda v: pad_or_cut_expr(v, seq_len, pad_id))})
    return got.select("epoch", "batch_id", *keys, F.transform("_p", lambda p: F.slice(p, 1, seq_len)).alias("x"),
                      F.transform("_p", lambda p: F.slice(p, 2, seq_len)).alias("y"), "n_pairs")
