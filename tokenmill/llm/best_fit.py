"""Sequence packing by bulk-synchronous best fit (operator 13).

A document's ids are those of a public byte-level BPE vocabulary, followed by
one end id. Documents of more than ``width`` ids are cut into pieces of
``width``, of which the first may be shorter. A piece of more than half a
sequence opens a sequence of its own. The rest is placed in supersteps, longest
pieces first, one octave of lengths at a time:

1. the octave's pieces and all gaps that can take one of them are range-sorted
   by size, largest first, a gap before a piece of its size;
2. every range sweeps its rows in that order: a piece takes its successor,
   the smallest gap that is not smaller, and what is left of the gap re-enters
   the sweep at its new size;
3. pieces and gaps left over in different ranges are matched by rank, like
   brackets: the running count of gaps less pieces over all ranges gives every
   row a level, and a piece takes the gap before it on its level, so no two
   pieces want the same one. A gap several times a piece's size stands for
   that many ranks;
4. the gaps are updated, and steps 1 to 3 repeated until none takes a piece;
5. pieces that fit nowhere open sequences by the same sweep, in groups dealt
   by a hash, which ends the octave.

Only a histogram of lengths (at most ``width`` rows) and a few totals reach
the driver. Rows hold no ids, only where they lie and their checksum. Every
superstep is written to the shared folder, so lost executors cost one step.

Defined results: a null or empty text is the end id alone; repeated rows are
packed once each; an empty table gives no rows; very long texts become many
full pieces. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.llm.common import landed, table
from tokenmill.llm.packing import Vocabulary
from tokenmill.session import ship_code

WIDTH = 1024
END_ID = 2
#: Rows of a range and of a hash group, and the most ranges of a superstep.
RANGE_ROWS = 50_000
MAX_RANGES = 20_000
OCTAVES = 5

_PIECES = "array<struct<piece:int,start:long,length:long,ids_crc32:long,doc_tokens:long>>"
_GAP, _PIECE, _PLACED = 0, 1, 2
#: ``size``: room of a gap, length of a piece; ``place``: ids before a placed piece; ``slots``: how many pieces of
#: any later range a gap takes; ``above``: ranks of the same kind nearer to the next range (gaps) or before it (pieces)
_SWEPT = "kind int, row long, sequence_id long, size long, place long, part int, slots long, above long"


def cut_pieces(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
               end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, doc_tokens``; all but the first are full."""
    ship_code(docs.sparkSession)
    piece = pa.struct([("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens"))])
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf(_PIECES)
    def pieces(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = vocabulary.tokenizer()
        for arr in col:
            rows, size = [[], [], [], [], []], [0]
            for value in arr:
                ids = t.ids(value.as_py() or "") + end
                n = len(ids) // 4
                edges = [0, *range(n % width or width, n + 1, width)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, x in zip(rows, (k, a, b - a, zlib.crc32(ids[4 * a:4 * b]), n), strict=True):
                        column.append(x)
                size.append(len(rows[0]))
            flat = pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(rows, piece, strict=True)],
                                              fields=list(piece))
            yield pa.ListArray.from_arrays(pa.array(size, pa.int32()), flat)

    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(pieces(F.col(text))).alias("p")) \
        .select("doc_id", "p.*")


class Sweep:
    """Best fit over rows in falling order of size, gaps before pieces.

    ``stack`` holds the gaps that take the piece at hand, the smallest on top;
    ``later`` those that are too small for it but not for all that follow.
    """

    def __init__(self, width: int):
        self.width = width
        self.stack: list[tuple[int, int]] = []
        self.later: list[tuple[int, int]] = []
        self.least = width

    def _at(self, size: int) -> None:
        self.least = size
        while self.later and -self.later[0][0] >= size:
            room, sequence = heapq.heappop(self.later)
            self.stack.append((-room, sequence))

    def gap(self, room: int, sequence: int) -> None:
        self._at(room)
        self.stack.append((room, sequence))

    def piece(self, length: int) -> tuple[int, int] | None:
        """The sequence and the place in it, or None if no gap takes the piece."""
        self._at(length)
        if not self.stack:
            return None
        room, sequence = self.stack.pop()
        if room > length:
            heapq.heappush(self.later, (length - room, sequence))
        return sequence, self.width - room


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in ("kind", "row", "sequence_id", "size")), strict=True)


def _batch(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _SWEPT.split(", ")]
    types = [pa.int32() if c.split()[1] == "int" else pa.int64() for c in _SWEPT.split(", ")]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _sweep_range(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sweep, unplaced = TaskContext.get().partitionId(), Sweep(width), 0
        for batch in batches:
            out = []
            for kind, row, sequence, size in _rows(batch):
                if kind == _GAP:
                    sweep.gap(size, sequence)
                elif (at := sweep.piece(size)) is not None:
                    out.append((_PLACED, row, at[0], size, at[1], part, 0, 0))
                else:
                    out.append((_PIECE, row, None, size, None, part, 0, unplaced))
                    unplaced += 1
            yield from _batch(out)
        # no piece of a later range is longer than this range's last row
        out, above = [(_GAP, None, s, -room, None, part, 0, 0) for room, s in sweep.later], 0
        for room, sequence in reversed(sweep.stack):
            slots = room // max(sweep.least, 1)
            out.append((_GAP, None, sequence, room, None, part, slots, above))
            above += slots
        for a in range(0, len(out), 10_000):
            yield from _batch(out[a:a + 10_000])
    return run


def _open_group(width: int, octave: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sweep, opened = TaskContext.get().partitionId(), Sweep(width), 0
        for batch in batches:
            out = []
            for _, row, _, size in _rows(batch):
                at = sweep.piece(size)
                if at is None:   # below zero: pieces that open a sequence alone use their row
                    at = -1 - ((opened << 26) + (part << 6) + octave), 0
                    opened += 1
                    heapq.heappush(sweep.later, (size - width, at[0]))
                out.append((_PLACED, row, at[0], size, at[1], part, 0, 0))
            yield from _batch(out)
        left = [(_GAP, None, s, -room, None, part, 0, 0) for room, s in sweep.later]
        left += [(_GAP, None, s, room, None, part, 0, 0) for room, s in sweep.stack]
        for a in range(0, len(left), 10_000):
            yield from _batch(left[a:a + 10_000])
    return run


def _ranges(rows: int, range_rows: int) -> int:
    return max(1, min(MAX_RANGES, -(-rows // range_rows)))


def _matched_by_rank(swept: DataFrame, pieces: int, width: int) -> DataFrame:
    """Step 3: ``row, sequence_id, size, place`` of pieces that take a gap of an earlier range."""
    left = swept.filter((F.col("kind") == _PIECE) | (F.col("slots") > 0)) \
        .select("kind", "row", "sequence_id", "size", "part", "slots", "above")
    # one row per range
    per_part = left.groupBy("part").agg(F.sum((F.col("kind") == _PIECE).cast("long")).alias("n_pieces"),
                                        F.sum("slots").alias("n_slots"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    depth = per_part.withColumn("depth", F.coalesce(F.sum(F.col("n_slots") - F.col("n_pieces")).over(before), F.lit(0)))
    # no more ranks of a range than there are pieces can be wanted
    ranks = left.filter(F.col("above") < pieces).join(depth, "part") \
        .withColumn("nth", F.explode(F.when(F.col("kind") == _PIECE, F.array(F.lit(0).cast("long")))
                                     .otherwise(F.sequence(F.lit(0).cast("long"), F.least("slots", F.lit(pieces)) - 1)))) \
        .withColumn("level", F.when(F.col("kind") == _PIECE, F.col("depth") - F.col("above"))
                    .otherwise(F.col("depth") - F.col("n_pieces") + F.col("n_slots") - F.col("above") - F.col("nth")))
    # a level holds at most two rows of a range
    level = Window.partitionBy("level").orderBy("part", F.col("kind").desc())
    wants = ranks.select("kind", "row", "size", F.lag(F.when(F.col("kind") == _GAP, F.col("sequence_id"))).over(level).alias("sequence_id"),
                         F.lag("size").over(level).alias("room")) \
        .filter((F.col("kind") == _PIECE) & F.col("sequence_id").isNotNull())
    # at most `width` pieces share a sequence
    inside = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return wants.select("row", "sequence_id", "size",
                        (F.lit(width) - F.col("room") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("place"))


def place(pieces: DataFrame, width: int = WIDTH, range_rows: int = RANGE_ROWS, octaves: int = OCTAVES) -> DataFrame:
    """``row, sequence_id, place`` of every row of ``pieces`` (``row long, length long``; from written files)."""
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= width rows
    half = width // 2
    alone = pieces.filter(F.col("length") > half)
    placed = [alone.select("row", F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("place"))]
    gaps = alone.filter(F.col("length") < width).select(F.col("row").alias("sequence_id"), (F.lit(width) - F.col("length")).alias("size"))
    n_gaps = sum(n for k, n in counts.items() if half < k < width)
    top = half
    for octave in range(octaves):
        low = top // 2 if octave < octaves - 1 else 0
        n = sum(c for k, c in counts.items() if low < k <= top)
        rest = pieces.filter((F.col("length") > low) & (F.col("length") <= top)) \
            .select("row", F.col("length").alias("size"))
        while n:
            can = gaps.filter(F.col("size") > low)
            rows = can.select(F.lit(_GAP).alias("kind"), F.lit(None).cast("long").alias("row"), "sequence_id", "size") \
                .unionByName(rest.select(F.lit(_PIECE).alias("kind"), "row", F.lit(None).cast("long").alias("sequence_id"), "size"))
            parts = _ranges(n + n_gaps, range_rows)
            order = [F.col("size").desc(), F.col("kind"), F.coalesce("sequence_id", "row")]
            swept = landed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
                           .mapInArrow(_sweep_range(width), _SWEPT), "swept")
            placed.append(swept.filter(F.col("kind") == _PLACED).select("row", "sequence_id", "place"))
            gaps = gaps.filter(F.col("size") <= low).unionByName(swept.filter(F.col("kind") == _GAP).select("sequence_id", "size"))
            rest = swept.filter(F.col("kind") == _PIECE).select("row", "size")
            n, least, n_gaps, room = _state(rest, gaps)
            if not n or room < least:
                break
            ranked = landed(_matched_by_rank(swept, n, width), "ranked")
            placed.append(ranked.select("row", "sequence_id", "place"))
            taken = ranked.groupBy("sequence_id").agg(F.sum("size").alias("taken"))
            gaps = landed(gaps.join(taken, "sequence_id", "left")
                          .select("sequence_id", (F.col("size") - F.coalesce("taken", F.lit(0))).alias("size"))
                          .filter("size > 0"), "gaps")
            rest = landed(rest.join(ranked.select("row"), "row", "left_anti"), "rest")
            n, least, n_gaps, room = _state(rest, gaps)
            if not n or room < least:
                break
        if n:
            groups = _ranges(n, range_rows)
            opened = landed(rest.select(F.lit(_PIECE).alias("kind"), "row", F.lit(None).cast("long").alias("sequence_id"), "size")
                            .repartition(groups, F.xxhash64("row")).sortWithinPartitions(F.col("size").desc(), "row")
                            .mapInArrow(_open_group(width, octave), _SWEPT), "opened")
            placed.append(opened.filter(F.col("kind") == _PLACED).select("row", "sequence_id", "place"))
            gaps = gaps.unionByName(opened.filter(F.col("kind") == _GAP).select("sequence_id", "size"))
        top = low
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def _state(rest: DataFrame, gaps: DataFrame) -> tuple[int, int, int, int]:
    """Pieces left, the shortest of them, gaps, and the largest of them (zeros if none)."""
    both = rest.select(F.lit(True).alias("p"), "size").unionByName(gaps.select(F.lit(False).alias("p"), "size"))
    piece, gap = (F.when(c, F.col("size")) for c in (F.col("p"), ~F.col("p")))
    return tuple(both.agg(F.count(piece), F.coalesce(F.min(piece), F.lit(0)), F.count(gap), F.coalesce(F.max(gap), F.lit(0))).first())


def pack(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
         end_id: int = END_ID, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; sequences hold at most ``width`` ids."""
    pieces = landed(cut_pieces(docs, vocabulary, doc_id, text, width, end_id)
                    .withColumn("row", F.monotonically_increasing_id()), "pieces")
    where = place(pieces.select("row", "length"), width, range_rows)
    return pieces.join(where, "row").withColumnRenamed("place", "offset") \
        .select("doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _vocabulary() -> Vocabulary:
    import public_tokenizers as public
    return Vocabulary(str(public.path("byte_bpe_50k.json")), str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), _vocabulary())
