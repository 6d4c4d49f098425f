"""Inputs the reference's jobs expect, derived from the driver tables.

Each fixture is a lazy DataFrame over the parquet tables in ``sf_dir``, so
its work grows with them. The DuckDB twins live in ``oracle.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.functions.exprs import words_of
from tokenmill.operators.codec import normalise_text
from tokenmill.operators.vocab import char_vocab, layout_vocab, seed_pieces, word_counts
from tokenmill.session import cut_lineage, table_path

# Fixed values (small parameters of the reference configuration).
SEQ_LEN = 1024
BATCH_SIZE = 32
SEED = 42
WORLD_SIZE = 8
PATIENCE = 5
TOP_K_CKPT = 3
TOP_P = 0.95
REPETITION_PENALTY = 9.0
EPOCHS = 10
MAX_GEN_LEN = 20
LR = 1e-4
GAMMA = 0.85
PAD_ID = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def text(spark, sf_dir) -> DataFrame:
    """TEXT: ``documents(doc_id, text)``."""
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def triples(spark, sf_dir) -> DataFrame:
    """TRIPLES: one instruction triple per user turn: the turn-0 system text,
    the user text and the next assistant text of the conversation (``''`` if
    there is none before the next user turn); ``id = conv_id-turn``."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    nxt = lambda col: F.first(F.when(F.col("role").isin("user", "assistant"), F.col(col)), ignorenulls=True).over(
        w.rowsBetween(1, Window.unboundedFollowing))
    d = c.withColumns({"_role": nxt("role"), "_text": nxt("text"),
                       "_sys": F.max(F.when((F.col("turn") == 0) & (F.col("role") == "system"), F.col("text")))
                       .over(Window.partitionBy("conv_id"))}).filter("role = 'user'")
    return d.select(F.concat_ws("-", "conv_id", "turn").alias("id"), "conv_id",
                    F.coalesce("_sys", F.lit("")).alias("system_prompt"), F.col("text").alias("question"),
                    F.when(F.col("_role") == "assistant", F.col("_text")).otherwise("").alias("response"))


def corpus_a(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("doc_id") % 2 == 0).select("doc_id", "text", "lang")


def corpus_b(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(F.col("doc_id") % 2 == 1).select("doc_id", "text", "source")


def presplit(spark, sf_dir) -> dict[str, DataFrame]:
    """PRESPLIT: three named raw inputs."""
    d = text(spark, sf_dir)
    m = F.col("doc_id") % 10
    return {"train": d.filter(m >= 2), "val": d.filter(m == 1), "test": d.filter(m == 0)}


def ids_expr(col: str = "text"):
    """IDS rule: code point + 4, bos (1) in front, eos (2) behind."""
    chars = F.when(F.col(col) == "", F.array().cast("array<int>")).otherwise(
        F.transform(F.split(F.col(col), ""), lambda c: F.ascii(c) + 4))
    return F.concat(F.array(F.lit(1)), chars, F.array(F.lit(2)))


def ids(spark, sf_dir) -> DataFrame:
    """IDS: ``(doc_id, text, ids)``."""
    return text(spark, sf_dir).withColumn("ids", ids_expr())


def splits(scan: DataFrame) -> int | None:
    """Partitions to deal a scan's rows out to before Python, or None if the
    files have a split per core already (as all but test tables do). Plans
    the scan alone, so it starts no job."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return 2 * cores if scan.rdd.getNumPartitions() < cores else None


def norm(spark, sf_dir) -> DataFrame:
    d = text(spark, sf_dir)
    n = splits(d)
    return normalise_text(d.repartition(n) if n else d, "text", "norm")


def charvocab(spark, sf_dir) -> DataFrame:
    """CHARVOCAB: distinct characters of the normalised documents."""
    return char_vocab(norm(spark, sf_dir), "norm")


def piecevocab(spark, sf_dir, top_k: int = 2000) -> DataFrame:
    """PIECEVOCAB: all characters and the best ``top_k`` longer seed pieces,
    scored ``ln(freq / total)`` to six places; written once, since encoding
    and decoding both read it."""
    p = cut_lineage(seed_pieces(word_counts(norm(spark, sf_dir)), top_k=top_k))
    total = p.agg(F.sum("freq").cast("double").alias("t")).scalar()
    return cut_lineage(layout_vocab(p.select("piece", F.round(F.log(F.col("freq") / total), 6).alias("score"))))


def words(spark, sf_dir) -> DataFrame:
    """WORDS: distinct words of the benchmark texts."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.explode(words_of("text")).alias("word")).distinct()


def stop(spark, sf_dir, n: int = 50) -> DataFrame:
    """STOP: the ``n`` most frequent English words (ties by word)."""
    d = table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    c = d.select(F.explode(words_of("text")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.desc("n"), "word").limit(n).select("word")


def prompts(spark, sf_dir) -> DataFrame:
    """PROMPTS: every user turn as one line, in batches of four conversations."""
    c = table(spark, sf_dir, "conversations").filter(F.col("role") == "user")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("prompt_id"),
                    F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"),
                    F.expr("conv_id div 4").alias("batch_id"))


def logits(spark, sf_dir) -> DataFrame:
    """LOGITS: ``(vec_id, logits, target, batch_id)``."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("logits"),
                    F.col("label").alias("target"), F.expr("vec_id div 32").alias("batch_id"))


def context_ids():
    """CONTEXT: ids already in the row, for the repetition penalty."""
    return F.array((F.col("vec_id") % 64).cast("int"), F.col("target").cast("int"),
                   ((F.col("vec_id") * 7) % 64).cast("int"))


def runlog_steps(spark, sf_dir) -> DataFrame:
    """Step-level metric log from ``events``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"),
                    F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("epoch"),
                    F.col("event_id").alias("step"), F.col("value").alias("val_loss"),
                    F.col("value").alias("train_loss"))


def runlog(spark, sf_dir) -> DataFrame:
    """RUNLOG: one row per ``(run, epoch)`` after the mean."""
    s = runlog_steps(spark, sf_dir)
    return s.groupBy("run", "epoch").agg(F.avg("val_loss").alias("val_loss"))
