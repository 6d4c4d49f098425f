"""Text files read by byte ranges: a file is as many tasks as it has ranges.

Spark's line reader gives every line to the range in which it starts. What a
range alone can't know (how many lines stand before it, whether it starts inside a
quoted cell) is summed up per range, a table of one row per range, and
composed over the ranges of a file in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.session import ship_code

_BOM = "\ufeff"


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, size, value)``: what stands between two ``\\n``, and its range."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A3: ``readlines()`` of a text-mode file: ``(file, line_no, line)``, ``line_no`` from 0.

    ``\\r\\n`` and ``\\r`` end a line as ``\\n`` does and are read as ``\\n``; line
    ends are kept; only the last line of a file may lack one. An empty file
    has no lines. Files may be of any size (a line stays below 2 GB). A line's
    number is its place in its range plus the lines of the ranges before. The
    reader drops a file's byte order mark; it is put back on line 0, told by
    the file's size as the last line end is. For compressed files, whose size
    tells neither, the last line is taken to have its end.
    """
    raw = _raw(spark, path)
    pieces = F.split(F.regexp_replace("value", r"\r\z", ""), "\r", -1)
    lines = raw.select("file", "block", "size", (F.octet_length("value") + 1).alias("bytes"),
                       F.col("value").endswith("\r").alias("cr"), F.posexplode(pieces).alias("k", "piece")) \
        .withColumn("at", F.monotonically_increasing_id())
    per = lines.groupBy("file", "block").agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"),
        F.sum(F.when(F.col("k") == 0, F.col("bytes"))).alias("bytes"), F.max_by("cr", "at").alias("cr"))
    ranges = Window.partitionBy("file")
    over = F.sum("bytes").over(ranges) - F.col("size")     # 1: no last line end; -3: a byte order mark
    plain = ~F.lower("file").rlike(r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd)$")
    per = per.select(
        "file", "block", "first",
        F.coalesce(F.sum("n").over(ranges.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        (plain & over.isin(-3, -2) & (F.col("block") == F.min("block").over(ranges))).alias("bom"),
        F.when(plain & over.isin(1, -2) & ~F.col("cr") & (F.col("block") == F.max("block").over(ranges)),
               F.col("last")).alias("open"))
    got = lines.select("file", "block", "at", "piece").join(per, ["file", "block"]) \
        .withColumn("line_no", F.col("at") - F.col("first") + F.col("before"))
    return got.select("file", "line_no", F.concat(
        F.when(F.col("bom") & (F.col("line_no") == 0), _BOM).otherwise(""), "piece",
        F.when(F.col("at") == F.col("open"), "").otherwise("\n")).alias("line"))


_RECORDS = "file string, block long, seq long, head boolean, tail boolean, text string"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines ``(file, block, odd, value)``, in the order of their ranges, to the
    records of each range. ``head``: it starts before the range; ``tail``: it ends behind it."""
    key, odd, seq, head = None, 0, 0, False
    rest: list[str] = []            # lines of the record that is still open

    def batch(texts: list, head_first: bool, tail_last: bool):
        nonlocal seq
        n = len(texts)
        flags = np.zeros((2, n), bool)
        flags[0, 0], flags[1, -1] = head_first, tail_last
        rows = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()),
                pa.array(np.arange(seq, seq + n)), pa.array(flags[0]), pa.array(flags[1]), pa.array(texts, pa.string())]
        seq += n
        return pa.RecordBatch.from_arrays(rows, ["file", "block", "seq", "head", "tail", "text"])

    for b in batches:
        if not b.num_rows:
            continue
        block = b.column("block").to_numpy()
        file = b.column("file").dictionary_encode()
        code = file.indices.to_numpy()
        edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(code) != 0)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            here = (file.dictionary[int(code[lo])].as_py(), int(block[lo]))
            if here != key:
                if rest:
                    yield batch(["\n".join(rest)], head, True)
                key, odd, seq, rest = here, int(b.column("odd")[lo].as_py()), 0, []
                head = odd == 1
            values = b.column("value").slice(lo, hi - lo)
            total = odd + np.cumsum(pc.count_substring(values, '"').to_numpy())
            starts = np.flatnonzero(np.append(odd, total[:-1]) % 2 == 0)
            odd = int(total[-1] % 2)
            if not len(starts):
                rest += values.to_pylist()
                continue
            texts = []
            if starts[0]:
                rest += values.slice(0, int(starts[0])).to_pylist()
            if rest:
                texts.append("\n".join(rest))
            first, head = head and bool(rest), False
            ends = np.append(starts[1:], hi - lo)
            if odd:             # the last record goes on
                rest = values.slice(int(starts[-1])).to_pylist()
                starts, ends = starts[:-1], ends[:-1]
            else:
                rest = []
            if len(starts):
                whole = values.slice(int(starts[0]), int(ends[-1] - starts[0]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1]) - starts[0], pa.int32()), whole)
                texts += pc.binary_join(lists, "\n").to_pylist()
            if texts:
                yield batch(texts, first, False)
    if rest:
        yield batch(["\n".join(rest)], head, True)


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, seq, text)``: the raw records of CSV files, in order within a file.

    A line starts a record if the quotes before it in the file are even in
    number: quotes inside a quoted cell are doubled, and only there may cells
    hold quotes or line ends (as pandas, Spark and RFC 4180 write). One light
    pass counts the quotes of each range; the parity at a range's start is a sum over
    the ranges before. A record over several ranges is put together from its parts, at most two per range.
    """
    ship_code(spark)
    raw = _raw(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = raw.groupBy("file", "block").agg(F.sum(quotes).alias("q")) \
        .select("file", "block", (F.coalesce(F.sum("q").over(before), F.lit(0)) % 2).cast("int").alias("odd")).filter("odd = 1")
    # at most one short row per byte range of the input, and only ranges that start inside a cell
    lines = raw.select("file", "block", "value").join(F.broadcast(starts), ["file", "block"], "left") \
        .select("file", "block", F.coalesce("odd", F.lit(0)).alias("odd"), "value")
    recs = lines.mapInArrow(_records, _RECORDS)
    order = Window.partitionBy("file").orderBy("block", "seq")
    parts = recs.filter("head or tail").withColumn("g", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(order))
    joined = parts.groupBy("file", "g").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))).alias("p")) \
        .select("file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["seq"].alias("seq"),
                F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return recs.filter("not head and not tail").select("file", "block", "seq", "text").unionByName(joined)
