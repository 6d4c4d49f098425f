"""Vocabulary tables (F2, F3, F5–F8, F12) and the character vocabulary.

A vocabulary is a table ``vocab(id INT, piece STRING, score DOUBLE, kind
STRING)`` with ids ``0…n-1``; ``kind`` is one of unk / bos / eos / pad /
normal / user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenmill.functions.exprs import SPACE_MARK
from tokenmill.operators.order import global_index
from tokenmill.session import cut_lineage

# Largest top-k kept as a per-task heap (TakeOrderedAndProject).
TOP_K_IN_MEMORY = 100_000

# Special pieces and their ids when padding is trained in
# (unk 0, bos 1, eos 2, pad 3); without padding pad is off (-1).
SPECIALS = [("unk", "<unk>"), ("bos", "<s>"), ("eos", "</s>"), ("pad", "<pad>")]
VOCAB_SCHEMA = "id int, piece string, score double, kind string"


def word_counts(norm_df: DataFrame, norm: str = "norm") -> DataFrame:
    """frequency of each ``▁word`` (partial + final aggregation)."""
    words = norm_df.select(F.explode(F.split(F.col(norm), SPACE_MARK)).alias("w")).filter(F.col("w") != "")
    return (words.select(F.concat(F.lit(SPACE_MARK), "w").alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("freq")))


def seed_pieces(wc: DataFrame, top_k: int = 1_000_000, max_piece_len: int = 16,
                min_freq: int = 2) -> DataFrame:
    """every character, plus substrings of 2…``max_piece_len`` characters
    of the word types (``▁`` only at the start) seen at least ``min_freq``
    times, scored ``freq × length``; the best ``top_k`` are kept.

    Work is over word *types* (weighted by frequency), and each executor
    pre-aggregates substrings before the shuffle.
    """
    L = F.length("word")
    starts = wc.select("word", "freq", F.explode(F.sequence(F.lit(1), L)).alias("s"))
    subs = starts.select(F.explode(F.sequence(F.lit(1), F.least(F.lit(max_piece_len), F.length("word") - F.col("s") + 1)))
                         .alias("n"), "word", "freq", "s")
    # a word type is "▁" + text without "▁", so "▁" can only open a piece
    subs = subs.select(F.substring("word", F.col("s"), F.col("n")).alias("piece"), "freq")
    agg = subs.groupBy("piece").agg(F.sum("freq").alias("freq")).withColumn("n_chars", F.length("piece"))
    agg = agg.filter((F.col("n_chars") == 1) | (F.col("freq") >= min_freq))
    agg = agg.withColumn("score", (F.col("freq") * F.col("n_chars")).cast("long"))
    if top_k > TOP_K_IN_MEMORY:
        # the large-cut ranking reads its input three times: materialise the
        # candidates once in the shared folder
        agg = cut_lineage(agg)
    chars = agg.filter(F.col("n_chars") == 1)
    multi = agg.filter(F.col("n_chars") > 1)
    if top_k <= TOP_K_IN_MEMORY:
        multi = multi.orderBy(F.desc("score"), "piece").limit(top_k)
    else:
        # a large cut: bucketed, spillable ranking instead of a per-task heap
        ranked = global_index(multi.withColumn("_neg", -F.col("score")), ["_neg", "piece"], seed=None, idx_col="_r")
        multi = ranked.filter(F.col("_r") < top_k).drop("_neg", "_r")
    return chars.unionByName(multi).select("piece", "freq", F.col("n_chars").cast("long").alias("n_chars"), "score")


def char_pieces(norm_df: DataFrame, norm: str = "norm") -> DataFrame:
    """Distinct characters of the normalised text: distinct within each row
    first, so a text gives out no more rows than it has different characters."""
    return (norm_df.select(F.explode(F.array_distinct(F.split(F.col(norm), ""))).alias("piece"))
            .filter(F.col("piece") != "").distinct())


def layout_vocab(pieces: DataFrame, score: str | None = "score", with_pad: bool = True,
                 first_id: int | None = None) -> DataFrame:
    """specials first (unk 0, bos 1, eos 2, pad 3 when padding is on),
    then pieces by score descending, ties by piece.

    The ordering window runs over the piece table only (≤ vocab size rows).
    """
    spark = pieces.sparkSession
    specials = SPECIALS if with_pad else SPECIALS[:3]
    base = len(specials) if first_id is None else first_id
    sc = F.col(score).cast("double") if score else F.lit(0.0)
    w = Window.orderBy(F.desc("_s"), "piece")
    body = (pieces.select("piece", sc.alias("_s"))
            .withColumn("id", (F.row_number().over(w) - 1 + base).cast("int"))
            .select("id", "piece", F.col("_s").alias("score"), F.lit("normal").alias("kind")))
    head = spark.createDataFrame([(i, p, 0.0, k) for i, (k, p) in enumerate(specials)], VOCAB_SCHEMA)
    return head.unionByName(body)


def char_vocab(norm_df: DataFrame, norm: str = "norm") -> DataFrame:
    """CHARVOCAB: the distinct characters, by character, ids from 4, equal
    scores — so the best segmentation is one piece per character."""
    return layout_vocab(char_pieces(norm_df, norm), score=None)


def tokenizer_info(vocab: DataFrame) -> DataFrame:
    """size, bos / eos / pad / unk ids (-1 when off) and a consistency flag
    (ids are exactly 0…n-1)."""
    def sid(k):
        return F.coalesce(F.max(F.when(F.col("kind") == k, F.col("id"))), F.lit(-1)).cast("int")
    info = vocab.agg(F.count(F.lit(1)).cast("long").alias("vocab_size"),
                     sid("unk").alias("unk_id"), sid("bos").alias("bos_id"),
                     sid("eos").alias("eos_id"), sid("pad").alias("pad_id"),
                     F.min("id").alias("_mn"), F.max("id").alias("_mx"),
                     F.countDistinct("id").alias("_nd"))
    ok = (F.col("_mn") == 0) & (F.col("_mx") == F.col("vocab_size") - 1) & (F.col("_nd") == F.col("vocab_size"))
    return info.withColumn("consistent", ok).drop("_mn", "_mx", "_nd")


def add_tokens(vocab: DataFrame, new_tokens: DataFrame | list[str], token_col: str = "piece") -> DataFrame:
    """append pieces not already present, score 0, next ids, in input order.

    Idempotent: pieces already in the vocabulary are skipped (left anti join).
    """
    spark = vocab.sparkSession
    if isinstance(new_tokens, list):
        new_tokens = spark.createDataFrame([(i, t) for i, t in enumerate(new_tokens)], "ord long, piece string")
    elif "ord" not in new_tokens.columns:
        new_tokens = new_tokens.select(F.col(token_col).alias("piece"), F.monotonically_increasing_id().alias("ord"))
    first = new_tokens.groupBy("piece").agg(F.min("ord").alias("ord"))
    fresh = first.join(vocab.select("piece"), on="piece", how="left_anti")
    top = vocab.select(F.max("id")).scalar()
    w = Window.orderBy("ord")  # over the new tokens only
    added = fresh.select((top + F.row_number().over(w)).cast("int").alias("id"), "piece",
                         F.lit(0.0).alias("score"), F.lit("user").alias("kind"))
    return vocab.unionByName(added)


def check_added(old: DataFrame, new: DataFrame, tokens: list[str]) -> DataFrame:
    """F8: new size = old size + number added; the id of each requested piece."""
    spark = new.sparkSession
    req = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "ord long, piece string")
    old_size = old.select(F.count(F.lit(1))).scalar()
    new_size = new.select(F.count(F.lit(1))).scalar()
    n_added = new.join(old.select("id"), on="id", how="left_anti").select(F.count(F.lit(1))).scalar()
    looked = req.join(new.select("piece", "id"), on="piece", how="left")
    return looked.select("ord", "piece", F.coalesce("id", F.lit(-1)).cast("int").alias("id"),
                         old_size.alias("old_size"), new_size.alias("new_size"), n_added.alias("n_added"),
                         (new_size == old_size + n_added).alias("size_ok"))


def lookup_piece(df: DataFrame, vocab: DataFrame, piece: str = "piece") -> DataFrame:
    """piece → id (unknown → the unk id)."""
    unk = vocab.filter(F.col("kind") == "unk").select(F.col("id").alias("_unk"))
    v = vocab.filter(~F.col("kind").isin("unk", "bos", "eos", "pad")).select(F.col("piece").alias(piece), F.col("id").alias("_id"))
    return (df.join(v, on=piece, how="left")
            .withColumn("id", F.coalesce("_id", unk.select(F.max("_unk")).scalar()).cast("int")).drop("_id"))


def lookup_id(df: DataFrame, vocab: DataFrame, id_col: str = "id") -> DataFrame:
    """id → piece."""
    return df.join(vocab.select(F.col("id").alias(id_col), "piece"), on=id_col, how="left")
