"""Projections, predicates and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.sources import io

# Fixed value: the separator placed between the parts of an instruction triple.
SEP = "<SEP>"


def drop_columns_strict(df: DataFrame, *cols: str) -> DataFrame:
    """B1: drop columns, raising on a name that is not there."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}; have {df.columns}")
    return df.drop(*cols)


def assemble_prompt(df: DataFrame, parts=("system_prompt", "question", "response"),
                    sep: str = SEP, out: str = "prompt") -> DataFrame:
    """B2: ``system_prompt + sep + question + sep + response`` (NULL → '')."""
    pieces = []
    for i, p in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(F.coalesce(F.col(p).cast("string"), F.lit("")))
    return df.withColumn(out, F.concat(*pieces))


def token_column(df: DataFrame, name: str | None = "ids", position: int | None = None):
    """The token list column, by name (or by position, type-checked)."""
    if name is None:
        name = df.columns[position]
    if not isinstance(df.schema[name].dataType, T.ArrayType):
        raise TypeError(f"column {name!r} is not a token list")
    return F.col(name)


def length_filter(df: DataFrame, ids: str = "ids", min_length: int = 0,
                  max_length: int = 2000, length_col: str | None = None) -> DataFrame:
    """Keep rows with ``min_length <= len <= max_length`` (both inclusive).

    With a stored ``length_col`` the predicate is a plain column range, which
    reaches the parquet scan as a pushed filter."""
    n = F.col(length_col) if length_col else F.size(ids)
    return df.filter(n.between(min_length, max_length))


def remap_token(df: DataFrame, ids: str = "ids", old: int = -1, new: int = 32000) -> DataFrame:
    """Replace one id by another in every list (no Python)."""
    return df.withColumn(ids, F.transform(F.col(ids), lambda x: F.when(x == old, F.lit(new)).otherwise(x)))


def head_by(df: DataFrame, order_cols: list, n: int = 201) -> DataFrame:
    """The first ``n`` rows under an explicit order.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top ``n`` and only those reach the final merge.
    """
    return df.orderBy(*order_cols).limit(n)


def union_all_by_name(*frames: DataFrame) -> DataFrame:
    """Concatenate, keep duplicates; missing columns become NULL; column
    order is first-seen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def combine_and_export(spark: SparkSession, frames: list[DataFrame], parquet_path: str,
                       csv_path: str, drop: tuple[str, ...] = ("id",)) -> DataFrame:
    """Union → parquet → drop the id → CSV; returns the CSV read back."""
    combined = union_all_by_name(*frames)
    io.write_parquet(combined, parquet_path)
    landed = spark.read.parquet(parquet_path)
    out = drop_columns_strict(landed, *drop)
    io.write_text_csv(out, csv_path)
    return io.read_text_csv(spark, csv_path, columns=out.columns)
