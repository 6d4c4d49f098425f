"""Vocabulary gate (H1–H3, H5, H6): check prompts against a word list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.functions.exprs import words_of


def split_words(df: DataFrame, text: str = "text", out: str = "words") -> DataFrame:
    """H1: lower-cased ``[\\p{L}\\p{N}]+`` words of each prompt, in order."""
    return df.withColumn(out, words_of(text))


def out_of_vocab(words_df: DataFrame, word_list: DataFrame, key: str, words: str = "words",
                 word: str = "word") -> DataFrame:
    """H2: per prompt, the sorted distinct words missing from the list.

    Explode → distinct → left anti join with the list (broadcast by the
    planner when the list is small, shuffled otherwise) → one sorted set per
    prompt (bounded by that prompt's own words).
    """
    ex = words_df.select(key, F.explode(words).alias(word)).distinct()
    miss = ex.join(word_list.select(word).distinct(), on=word, how="left_anti")
    return miss.groupBy(key).agg(F.array_sort(F.collect_set(word)).alias("missing"))


def flag_prompts(prompts: DataFrame, word_list: DataFrame, key: str, text: str = "text") -> DataFrame:
    """H3: ``clear`` (no word missing) or ``flagged``, with the missing words."""
    w = split_words(prompts.select(key, text), text)
    oov = out_of_vocab(w, word_list, key)
    return (prompts.select(key).join(oov, on=key, how="left")
            .withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
            .withColumn("n_missing", F.size("missing").cast("long"))
            .withColumn("status", F.when(F.col("n_missing") == 0, F.lit("clear")).otherwise(F.lit("flagged"))))


def stopword_coverage(stop: DataFrame, word_list: DataFrame, word: str = "word") -> DataFrame:
    """H5: how many stop words the list lacks, and which (sorted).

    The stop list is an input of bounded size; the missing set is gathered
    once, from at most that many rows.
    """
    s = stop.select(word).distinct()
    miss = s.join(word_list.select(word).distinct(), on=word, how="left_anti")
    n_stop = s.select(F.count(F.lit(1))).scalar()
    return miss.agg(n_stop.alias("n_stop"), F.count(F.lit(1)).alias("n_missing"),
                    F.array_sort(F.collect_list(word)).alias("missing"))


def list_size(word_list: DataFrame, word: str = "word") -> DataFrame:
    """H6: distinct word forms."""
    return word_list.agg(F.countDistinct(word).alias("n_words"))
