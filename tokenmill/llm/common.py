"""Helpers shared by the operators of this package."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.session import scratch_path, ship_code, table_path

#: Bytes of text that a Python worker lays out as arrays at a time.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the cluster's shared folder and reread it.

    The table outlives lost executors and cuts the lineage; nothing is kept
    on the machine that computed it.
    """
    spark = df.sparkSession
    ship_code(spark)
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bare_scan(df: DataFrame) -> bool:
    """Whether every row of ``df`` is one row of a file: only columns and filters stand above the scan."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "Relation") or plan.getClass().getSimpleName() == "LogicalRelation"


def private(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """Add a row's identity: its file (as a hash) and its place in that file.

    Unlike generated ids it doesn't depend on how a scan is split into tasks,
    so it stays the same over jobs, retries and lost executors. A table that
    isn't read from files row by row (a join, a union, an ``explode``) is written to the
    shared folder first, as is one with a column named ``_metadata``.
    """
    meta = next((c for c in df.columns if c.lower() == "_metadata"), None)
    if meta is None and _bare_scan(df):
        try:
            return _with_identity(df, name)
        except AnalysisException:      # a scan that knows no files
            pass
    if meta is None:
        return _with_identity(landed(df, "rows"), name)
    other = private(df, "_kept_metadata")
    return _with_identity(landed(df.withColumnRenamed(meta, other), "rows"), name).withColumnRenamed(other, meta)


def _with_identity(df: DataFrame, name: str) -> DataFrame:
    got = df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("f"),
                                       F.col("_metadata.row_index").alias("i")))
    got.schema  # noqa: B018  resolves the columns
    return got


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string column and its n+1 row offsets,
    without a copy. A null counts as an empty string."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, arr.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def row_chunks(off: np.ndarray, size: int = CHUNK_BYTES):
    """Row ranges ``(a, b)`` of at most ``size`` bytes; a longer row stands alone."""
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + size, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


class Powers:
    """Odd base to the power i and its inverse, modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base = base | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(n, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Well-mixed 64-bit values of 64-bit keys (finaliser with two multiplies)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2 ** 64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64), seed)


def sorted_groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """The groups of rows sorted by ``by``; a group may reach over batches."""
    rest: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
        if rest is None or not len(rest):
            continue
        rest = rest.combine_chunks()
        cols = [rest.column(c).to_numpy() for c in by]
        edge = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])))
        edge = np.append(edge, len(rest)).tolist()
        for a, b in zip(edge[:-2], edge[1:-1], strict=True):
            yield rest.slice(a, b - a)
        rest = rest.slice(edge[-2])
    if rest is not None and len(rest):
        yield rest


def components(edges: DataFrame, a: str = "a", b: str = "b", task_rows: int | None = None) -> DataFrame:
    """Connected components: ``(node, component)`` for every node on an edge,
    the component being its smallest node.

    Alternates large-star and small-star steps; every step is a grouped
    minimum and a join, written to the shared folder, so a hub is no group in
    one task: AQE splits its side of the join. Ends when no edge changes.
    ``task_rows`` reads the edges in as many partitions as make that many rows
    each, so that a small graph's steps need no shuffle.
    """
    e = landed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "cc")
    parts = max(1, -(-e.count() // task_rows)) if task_rows else None
    e = e.coalesce(parts) if parts else e
    nodes = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large-star: every larger neighbour points at the smallest one seen from u
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: smaller neighbours and the node itself point at the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e2 = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")) \
            .filter("u <> v").distinct()
        e = landed(e2, "cc")
        e = e.coalesce(parts) if parts else e
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")), "node", "left") \
        .select("node", F.coalesce("component", "node").alias("component"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
