"""Scans and sinks: CSV with the all-string / no-NA rule, parquet, line
files, word lists, named split sets, split-partitioned writes.

Readers stay lazy; writers are actions and return the written path.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.sources.ranges import read_csv_records, read_lines

__all__ = [
    "read_text_csv", "write_text_csv", "read_parquet", "write_parquet",
    "read_lines", "write_lines", "read_word_list", "read_tokenized",
    "load_splits", "write_splits", "read_splits", "land_if_absent",
    "append_lines", "export_vocab",
]

# CSV dialect that round-trips pandas' default writer/reader exactly:
# quote and escape are both '"', embedded newlines allowed, no trimming.
_CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"',
             "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "false",
             "ignoreTrailingWhiteSpace": "false"}
#: Written last into a folder, so its table is whole.
_MARKER = "_SUCCESS"
_CSV_WRITE = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "false",
              "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
              "emptyValue": '""'}


def read_text_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A1: header CSV, every column a string, empty cells ``''``, ``NA`` kept.

    Files are read by byte ranges, whatever line ends their cells hold, so one
    large file is many tasks; each file's first record is its header. Empty
    lines are skipped, a record of another number of cells is an error, and
    ``\\r\\n`` ends a record as ``\\n`` does.
    With ``columns`` the schema is fixed up front (no header inference pass).
    """
    if columns is None:
        columns = spark.read.options(**_CSV_READ).csv(path).columns
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    # the record is whole: its own line ends are content
    options = {k: v for k, v in _CSV_READ.items() if k not in ("header", "multiLine")}
    text = F.regexp_replace("text", r"\r\z", "")
    return (read_csv_records(spark, path).filter("not (block = 0 and seq = 0)").select(text.alias("text"))
            .filter("text <> ''").select(F.from_csv("text", ddl, {**options, "lineSep": "\u0001"}).alias("r"))
            .select("r.*").na.fill(""))


def write_text_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV without a row index; cells are never trimmed."""
    df.write.mode(mode).options(**_CSV_WRITE).csv(path)
    return path


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A2: parquet scan (column pruning and filter pushdown are Catalyst's)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite",
                  partition_by: list[str] | None = None) -> str:
    """A7."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def write_lines(df: DataFrame, text_col: str, path: str, mode: str = "overwrite") -> str:
    """One row per line; every line newline-terminated (Spark text sink)."""
    df.select(F.col(text_col).cast("string").alias("value")).write.mode(mode).text(path)
    return path


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """A4: header skipped; first field → ``word``, the rest → ``attrs``.

    The last duplicate of a word wins. "Last" is the file order: files by
    path, then split offset, then row position inside the split — no
    global sort, one aggregation keyed by word.
    """
    df = spark.read.options(**{**_CSV_READ, "multiLine": "false"}).csv(path)
    cols = df.columns
    order = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"),
                     F.monotonically_increasing_id())
    attrs = F.array(*[F.coalesce(F.col(c), F.lit("")) for c in cols[1:]]) if len(cols) > 1 \
        else F.array().cast("array<string>")
    return (df.select(F.coalesce(F.col(cols[0]), F.lit("")).alias("word"), attrs.alias("attrs"),
                      order.alias("ord"))
            .groupBy("word").agg(F.max_by("attrs", "ord").alias("attrs")))


def read_tokenized(spark: SparkSession, path: str, ids_col: str = "ids") -> DataFrame:
    """A5: a saved tokenised split; fails if absent or without the id column."""
    df = spark.read.parquet(path)
    if ids_col not in df.columns:
        raise ValueError(f"{path}: no column {ids_col!r} (found {df.columns})")
    if not isinstance(df.schema[ids_col].dataType, T.ArrayType):
        raise TypeError(f"{ids_col!r} is not an array column")
    return df


def load_splits(frames: dict[str, DataFrame], split_col: str = "split") -> DataFrame:
    """Several named inputs → one table with a ``split`` column."""
    if not frames:
        raise ValueError("no inputs")
    tagged = [df.withColumn(split_col, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write_splits(df: DataFrame, path: str, split_col: str = "split",
                 mode: str = "overwrite", format: str = "parquet") -> str:
    """One output directory per split (``split=<name>``), as ``parquet``
    or as ``csv`` (all columns as strings, quoted like A8)."""
    if format == "csv":
        df = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
    w = df.write.mode(mode).partitionBy(split_col)
    w.options(**(_CSV_WRITE if format == "csv" else {})).format(format).save(path)
    return path


def read_splits(spark: SparkSession, path: str, splits: list[str] | None = None,
                split_col: str = "split", format: str = "parquet") -> DataFrame:
    """Read back a split set; a split filter prunes directories."""
    df = spark.read.options(**(_CSV_READ if format == "csv" else {})).format(format).load(path)
    return df.filter(F.col(split_col).isin(splits)) if splits else df


def land_if_absent(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """A10: write only when the target does not exist yet.

    The table is written beside the target and renamed when it is whole, so
    a target either has its commit marker or is what a failed job left: one
    without marker is landed again. When two jobs land the same target, the first stays.
    """
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop(target, _MARKER)):
        return path
    name = f".{target.getName()}-{uuid.uuid4().hex[:12]}"
    staged = hadoop(target.getParent(), name) if target.getParent() else hadoop(name)
    df.write.format(fmt).save(staged.toString())
    if not fs.exists(hadoop(staged, _MARKER)):      # the session may write none itself
        fs.create(hadoop(staged, _MARKER)).close()
    if fs.exists(target) and not fs.exists(hadoop(target, _MARKER)):
        fs.delete(target, True)
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, True)
        if not fs.exists(hadoop(target, _MARKER)):
            raise OSError(f"{path}: could not be landed")
    return path


def append_lines(df: DataFrame, path: str, text_col: str = "line") -> str:
    """Append text lines (one file per task, never one shared file)."""
    df.select(F.col(text_col).alias("value")).write.mode("append").text(path)
    return path


def export_vocab(vocab: DataFrame, path: str | None = None) -> DataFrame:
    """``id<TAB>piece`` lines in id order; written when a path is given."""
    lines = vocab.select("id", F.concat_ws("\t", F.col("id").cast("string"), F.col("piece")).alias("line"))
    if path:
        lines.orderBy("id").select("line").write.mode("overwrite").text(path)
    return lines
