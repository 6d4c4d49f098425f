"""Line dedup by content-defined chunks (operator 9, native).

A text's lines are hashed; a rolling hash over the last ``span`` line hashes
ends a chunk wherever it is 0 modulo ``spread``. A line of ``wide`` or more
characters is a paragraph, several lines when printed, and a chunk of its own.
Boundaries depend only on nearby lines, so they come back to the same places
behind inserted or dropped lines. Chunks of at least ``min_lines`` lines or
``wide`` characters that occur more than once in the corpus, the same document
included, are removed except their first occurrence (smallest id, then
position). Fingerprints find the suspects, with only 16 bytes per chunk
shuffled; the suspects' bytes decide.

So a repeated passage is found wherever it lies if one of its lines is wide, as
in any passage of over 50 words on up to three lines of common prose. A passage
of narrow lines is found if two of its boundaries lie two lines or more apart.
The pipeline's stage (``drop_repeated_lines``) also removes every two neighbouring
lines that stand earlier in the corpus, so copies and passages of two or more
lines go whole; the registered query keeps the chunk rule that its SQL defines.

Defined results: null texts count as empty and have no lines; lines are parted
by newline alone, so empty lines count; repeated rows are different rows, the
first keeps its chunks; rows are told apart by their place in the files, so
null or repeated ids do no harm; an empty table gives no rows; columns with
clashing names are replaced by the result's. Nothing is collected per chunk:
counts and minima are aggregated before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import numbered, table, text_or_empty

SPAN = 2          # lines in the rolling hash
SPREAD = 2        # a line ends a chunk with probability 1 / SPREAD
MIN_LINES = 2     # only multi-line chunks are removed,
WIDE = 72         # a line of this many characters counting as several
WORDED = r"(?U)\S"  # a text or line that is more than white space

# Fixed values of the rolling hash
FACTOR = 1_000_003
MODULUS = 2_147_483_647


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunked(docs: DataFrame, text: str = "text", span: int = SPAN, spread: int = SPREAD,
            wide: int = WIDE) -> DataFrame:
    """Add ``_lines`` and ``_cuts``: the line numbers (from 0) at which chunks end, exclusive."""
    t = text_or_empty(text)
    df = docs.withColumn("_lines", F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\n", -1))) \
        .withColumn("_hash", F.transform("_lines", _line_hash)) \
        .withColumn("_wide", F.transform("_lines", lambda line: F.length(line) >= wide))

    def ends(i: Column) -> Column:
        value = F.lit(0).cast("long")
        for k in range(span - 1, -1, -1):
            earlier = F.coalesce(F.try_element_at("_hash", F.when(i - k > 0, (i - k).cast("int"))), F.lit(0))
            value = (value * FACTOR + earlier) % MODULUS
        beside = F.coalesce(F.try_element_at("_wide", (i + 1).cast("int")), F.lit(False))
        return F.try_element_at("_wide", i.cast("int")) | beside | (value % spread == 0)

    n = F.size("_lines")
    return df.withColumn("_cuts", F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: ends(i) | (i == n)))).drop("_hash", "_wide")


def repeated_chunks(rows: DataFrame, order: list[str], min_lines: int = MIN_LINES, wide: int = WIDE) -> DataFrame:
    """``(_row, _drop)``: per row the numbers of its chunks to remove."""
    chunks = rows.select("_row", *order, "_lines", F.posexplode(F.arrays_zip(
        F.col("_cuts").alias("e"),
        F.concat(F.array(F.lit(0)), F.slice("_cuts", F.lit(1), F.greatest(F.size("_cuts") - 1, F.lit(0)))).alias("s"))
    ).alias("_no", "_c")) \
        .select("_row", *order, "_no", (F.col("_c.e") - F.col("_c.s")).alias("_size"), F.array_join(
            F.slice("_lines", F.col("_c.s") + 1, F.col("_c.e") - F.col("_c.s")), "\n").alias("_text")) \
        .filter((F.col("_size") >= min_lines) | (F.length("_text") >= wide)).drop("_size") \
        .withColumn("_fp", F.xxhash64("_text"))
    suspects = chunks.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_fp")
    # another key from here on: with the fingerprint itself, the planner would
    # keep a hot chunk's rows in the join's one task for the aggregation too.
    # So it aggregates before the shuffle, and both joins may be split
    seen = chunks.join(suspects, "_fp", "left_semi").withColumn("_key", F.bitwise_not("_fp")).drop("_fp")
    # bytes decide: the text is the key, the first place stays
    place = F.struct(*order, "_row", "_no")
    first = seen.groupBy("_key", "_text").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")) \
        .filter("_n > 1").drop("_n")
    return seen.join(first, ["_key", "_text"]).filter(~place.eqNullSafe(F.col("_first"))) \
        .groupBy("_row").agg(F.collect_set("_no").alias("_drop"))


def drop_repeated_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN,
                         spread: int = SPREAD, min_lines: int = MIN_LINES, wide: int = WIDE) -> DataFrame:
    """``docs`` with repeated chunks gone from ``text``, and ``n_lines``,
    ``n_chunks``, ``n_removed`` (chunks) and ``n_lines_removed``."""
    placed = numbered(docs).withColumn("_order", F.col(doc_id))
    rows = chunked(placed, text, span, spread, wide)
    drop = repeated_chunks(rows.select("_row", "_order", "_lines", "_cuts"), ["_order"], min_lines, wide)
    got = placed.join(drop, "_row", "left")
    got = chunked(got, text, span, spread, wide)
    gone = F.coalesce("_drop", F.array().cast("array<int>"))
    kept = F.filter(F.transform("_cuts", lambda e, k: F.when(~F.array_contains(gone, k), F.array_join(F.slice(
        "_lines", F.when(k > 0, F.try_element_at("_cuts", k)).otherwise(0) + 1,
        e - F.when(k > 0, F.try_element_at("_cuts", k)).otherwise(0)), "\n"))), lambda s: s.isNotNull())
    lines = F.aggregate(gone, F.lit(0), lambda acc, k: acc + F.try_element_at("_cuts", k + 1) - F.when(
        k > 0, F.try_element_at("_cuts", k)).otherwise(0))
    return got.withColumns({
        text: F.when(F.size(gone) == 0, F.col(text)).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size("_lines").cast("long"), "n_chunks": F.size("_cuts").cast("long"),
        "n_removed": F.size(gone).cast("long"), "n_lines_removed": lines.cast("long"),
    }).drop("_row", "_order", "_drop", "_lines", "_cuts")


def repeated_pairs(rows: DataFrame, order: list[str]) -> DataFrame:
    """``(_row, _pairs)``: per row the numbers of the lines in pairs of
    neighbouring lines that stand earlier too; blank lines between them go along."""
    words = F.filter(F.transform("_lines", lambda line, i: F.struct(i.alias("i"), line.alias("line"))),
                     lambda x: x["line"].rlike(WORDED))
    n = F.greatest(F.size("_words") - 1, F.lit(0))
    pairs = rows.withColumn("_words", words).select("_row", *order, F.explode(F.zip_with(
        F.slice("_words", F.lit(1), n), F.slice("_words", F.lit(2), n), lambda a, b: F.struct(
            a["i"].alias("a"), b["i"].alias("b"), F.concat(a["line"], F.lit("\n"), b["line"]).alias("t")))).alias("_p")) \
        .select("_row", *order, F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"), F.xxhash64("_p.t").alias("_fp"),
                F.unhex(F.md5("_p.t")).alias("_key"))
    suspects = pairs.groupBy("_fp").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_fp")
    seen = pairs.join(suspects, "_fp", "left_semi").drop("_fp")
    # 128 bits decide, so that no pair's text is shuffled
    place = F.struct(*order, "_row", "_a")
    first = seen.groupBy("_key").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")) \
        .filter("_n > 1").drop("_n")
    return seen.join(first, "_key").filter(~place.eqNullSafe(F.col("_first"))) \
        .groupBy("_row").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("_a", "_b")))).alias("_pairs"))


def drop_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN,
                        spread: int = SPREAD, min_lines: int = MIN_LINES, wide: int = WIDE) -> DataFrame:
    """``docs`` without repeated chunks and without repeated pairs of lines, and
    ``n_lines``, ``n_lines_removed``. Where a passage or a copy starts and ends
    doesn't matter: lines that chunk boundaries part from it are in its pairs."""
    placed = numbered(docs).withColumn("_order", F.col(doc_id))
    rows = chunked(placed, text, span, spread, wide)
    drop = repeated_chunks(rows.select("_row", "_order", "_lines", "_cuts"), ["_order"], min_lines, wide)
    pairs = repeated_pairs(rows.select("_row", "_order", "_lines"), ["_order"])
    got = chunked(placed.join(drop, "_row", "left").join(pairs, "_row", "left"), text, span, spread, wide)
    none = F.array().cast("array<int>")
    in_chunks = F.flatten(F.transform(F.coalesce("_drop", none), lambda k: F.sequence(
        F.when(k > 0, F.try_element_at("_cuts", k)).otherwise(0), F.try_element_at("_cuts", k + 1) - 1)))
    got = got.withColumn("_gone", F.array_union(in_chunks, F.coalesce("_pairs", none)))
    every = F.when(F.size("_lines") == 0, none).otherwise(F.sequence(F.lit(0), F.greatest(F.size("_lines") - 1, F.lit(0))))
    kept = F.transform(F.array_except(every, "_gone"), lambda i: F.try_element_at("_lines", i + 1))
    return got.withColumns({
        text: F.when(F.size("_gone") == 0, F.col(text)).otherwise(F.array_join(kept, "\n")),
        "n_lines": F.size("_lines").cast("long"), "n_lines_removed": F.size("_gone").cast("long"),
    }).drop("_row", "_order", "_drop", "_pairs", "_gone", "_lines", "_cuts")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_chunks(docs).select(
        "doc_id", "n_lines", "n_chunks", "n_removed", "n_lines_removed", F.sha2("text", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks and pairs of lines go from the texts; a document left without text goes too."""
    names = docs.columns
    # the generated column keeps the filter above the texts' projection: pushed
    # below it, the optimiser would write the line hashes into each use of them
    got = drop_repeated_lines(docs).withColumn("_at", F.monotonically_increasing_id())
    kept = got.filter(((F.col("n_lines_removed") == 0) | F.col("text").rlike(WORDED)) & (F.col("_at") >= 0))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.when(F.col("n_lines_removed") == 0, F.col("n_chars"))
                               .otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return kept.select(*names)
