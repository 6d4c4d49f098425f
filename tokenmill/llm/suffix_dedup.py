"""Repeated byte strings by blockwise sorting of suffixes (operator 2).

Every byte is removed that is covered by a ``length``-byte string which also
starts anywhere else. Two suffixes are equal for ``length`` bytes only if they
are so from the offset at which both lie on the difference cover: for any two
positions some offset below the cover's modulus v takes both into it. So:

1. the suffixes at cover positions (17 of 273 at length 400) are ranked by
   their first ``length - v + 1`` bytes, one bucket of them sorted at a time;
2. a suffix none of whose cover samples within reach has an equal elsewhere
   cannot repeat and drops out; the ties that remain are decided by
   sorting those suffixes on their whole ``length`` bytes, again a bucket at a
   time. Equal neighbours in a bucket are repeats.

Suffixes are compared by 64-bit fingerprints of the bytes in question, so a
bucket is a table of numbers whose order is that of the fingerprints; the
suffix array's lexicographic order is not needed, as only equality counts.
Texts are read in blocks of consecutive rows. A block sends each bucket its
distinct fingerprints with their counts, as differences in byte planes (which
the shuffle compresses), so a string that a third of all rows share is one
entry per block; a bucket returns what repeats. Texts with exact copies are
worked on once and their copies are wholly removed.

Defined results: null texts are empty; texts shorter than ``length`` bytes
lose nothing; repeated rows are copies and lose all if long enough; null or
repeated ids do no harm (rows are told apart by their place in the files); an
empty table gives no rows. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import Powers, byte_values, landed, mixed, numbered, row_chunks, table, text_or_empty, utf8
from tokenmill.session import ship_code

LENGTH = 400
BLOCK_BYTES = 8_000_000
BUCKET_ENTRIES = 600_000

# Perfect difference sets, modulus to members; every non-zero
# residue is the difference of exactly one pair.
COVERS = {
    7: (1, 2, 4),
    73: (1, 2, 4, 8, 16, 32, 37, 55, 64),
    273: (1, 2, 4, 8, 16, 32, 64, 91, 117, 128, 137, 182, 195, 205, 234, 239, 256),
}
_VALUES = byte_values(2)
_POWERS = Powers(0x5851F42D4C957F2D)


def cover_for(length: int) -> int:
    """The largest modulus that leaves at least a quarter of the length to compare."""
    fit = [v for v in COVERS if 4 * (length - v + 1) >= length]
    if not fit:
        raise ValueError(f"length {length} is too short; the least is 8")
    return max(fit)


class Windows:
    """Fingerprints of fixed-length windows at any positions of a byte array."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _POWERS.get(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUES[raw] * up[:len(raw)], out=self.total[1:])

    def at(self, pos: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((self.total[pos + length] - self.total[pos]) * self.down[pos], length)


def _positions(off: np.ndarray, length: int, keep) -> np.ndarray:
    """Positions from which ``length`` bytes lie in one row, where ``keep(place in the row)``."""
    n = np.diff(off)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - off[row]
    return np.flatnonzero(keep(place) & (n[row] - place >= length))


def cover_positions(off: np.ndarray, length: int, v: int) -> np.ndarray:
    on = np.zeros(v, bool)
    on[list(COVERS[v])] = True
    return _positions(off, length - v + 1, lambda p: on[p % v])


# --- blocks and buckets: sorted fingerprints as differences in byte planes

def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _coded(h: np.ndarray) -> bytes:
    return _planes(np.diff(h, prepend=np.uint64(0)))


def _decoded(b: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(b, np.uint64), dtype=np.uint64)


def _bucket_edges(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted fingerprints (by equal ranges of their values)."""
    bounds = (np.arange(1, buckets, dtype=object) * (1 << 64) // buckets).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(h, bounds), [len(h)]])


_SENT = "bucket int, block long, entries binary, counts binary"


def _sent(block: int, h: np.ndarray, buckets: int) -> list[tuple]:
    u, n = np.unique(h, return_counts=True)
    e = _bucket_edges(u, buckets)
    return [(k, block, _coded(u[e[k]:e[k + 1]]), _planes(n[e[k]:e[k + 1]].astype(np.uint32)))
            for k in np.flatnonzero(np.diff(e)).tolist()]


def _as_table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("entries", pa.binary()), ("counts", pa.binary())])
_BACK = "block long, bucket int, entries binary, counts binary"
_BACK_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("entries", pa.binary()), ("counts", pa.binary())])


def _sorted_bucket(part: pa.Table):
    """All entries of a bucket, sorted; the total of each one's group; and whose they are."""
    part = part.sort_by("block")
    entries = [_decoded(b) for b in part["entries"].to_pylist()]
    counts = np.concatenate([_unplaned(b, np.uint32) for b in part["counts"].to_pylist()])
    h = np.concatenate(entries)
    order = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.append(True, h[order[1:]] != h[order[:-1]]))
    total = np.add.reduceat(counts[order].astype(np.int64), first)
    size = np.diff(np.append(first, len(h)))
    of = np.empty(len(h), np.int64)
    of[order] = np.repeat(total, size)
    ends = np.cumsum([0] + [len(e) for e in entries])
    return part, h, of, ends


def _ranked_samples(part: pa.Table) -> pa.Table:
    """To each block, those of its fingerprints that occur more than once, with their totals."""
    part, h, of, ends = _sorted_bucket(part)
    rows = []
    for k, (block, bucket) in enumerate(zip(part["block"].to_pylist(), part["bucket"].to_pylist(), strict=True)):
        a, b = ends[k], ends[k + 1]
        many = of[a:b] > 1
        if many.any():
            rows.append((block, bucket, _coded(h[a:b][many]),
                         _planes(np.minimum(of[a:b][many], 2 ** 32 - 1).astype(np.uint32))))
    return _as_table(rows, _BACK_ARROW)


def _ranked_windows(part: pa.Table) -> pa.Table:
    """To each block, a bit for each of its fingerprints in the bucket: whether it repeats."""
    part, _, of, ends = _sorted_bucket(part)
    rows = [(block, bucket, np.packbits(of[ends[k]:ends[k + 1]] > 1).tobytes(), b"") for k, (block, bucket) in
            enumerate(zip(part["block"].to_pylist(), part["bucket"].to_pylist(), strict=True))]
    return _as_table(rows, _BACK_ARROW)


def _runs(mask_starts: np.ndarray, width: int, off: np.ndarray) -> list[np.ndarray]:
    """Merged byte runs ``[k, 2]`` of each row covered by ``width`` bytes from the given sorted positions."""
    n = len(off) - 1
    out = [np.zeros((0, 2), np.int64)] * n
    if not len(mask_starts):
        return out
    row = np.searchsorted(off, mask_starts, "right") - 1
    gap = np.append(True, (row[1:] != row[:-1]) | (mask_starts[1:] > mask_starts[:-1] + width))
    first = np.flatnonzero(gap)
    last = np.append(first[1:], len(mask_starts)) - 1
    runs = np.stack([mask_starts[first] - off[row[first]], mask_starts[last] + width - off[row[first]]], 1)
    for r, a, b in zip(*_groups(row[first]), strict=True):
        out[r] = runs[a:b]
    return out


def _groups(row: np.ndarray):
    edge = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    return row[edge].tolist(), edge.tolist(), np.append(edge[1:], len(row)).tolist()


def _cut(text: bytes, runs: np.ndarray) -> str:
    keep, at = hashlib.sha256(), 0
    for a, b in runs.tolist():
        keep.update(text[at:a])
        at = b
    keep.update(text[at:])
    return keep.hexdigest()


_STATE = """id {id}, f long, i long, block long, n_bytes long, removed array<struct<start:long,end:long>>,
kept_sha256 string, copies long, text string, candidates binary"""


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """``id, n_bytes, removed`` (byte runs) and ``kept_sha256`` of every row."""
    spark = docs.sparkSession
    ship_code(spark)
    v = cover_for(length)
    short = length - v + 1
    rows = numbered(docs).select(F.col(doc_id).alias("id"), F.col("_row.f").alias("f"), F.col("_row.i").alias("i"),
                                 text_or_empty(text).alias("text"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    per_block = max(1, int(block_bytes * total.n / max(total.b, 1)))
    shift = per_block.bit_length() - 1
    rows = rows.withColumn("block", F.xxhash64("f", F.shiftright("i", shift)))
    buckets = max(16, -(-int(total.b * len(COVERS[v]) / v) // bucket_entries))
    id_type = rows.schema["id"].dataType.simpleString()
    struct = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    # 1. rank the suffixes on the cover
    def sample(batches):
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            raw, off = utf8(batch.column(1))
            out = []
            edges = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(blocks)) if len(blocks) else [0]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                parts = []
                for x, y in row_chunks(off[a:b + 1]):
                    o = off[a + x:a + y + 1] - off[a + x]
                    pos = cover_positions(o, length, v)
                    n = np.diff(o)
                    row = np.searchsorted(o, pos, "right") - 1
                    pos = pos[n[row] >= length]
                    parts.append(Windows(raw[off[a + x]:off[a + y]]).at(pos, short))
                out += _sent(int(blocks[a]), np.concatenate(parts), buckets) if parts else []
            yield from _as_table(out, _SENT_ARROW).to_batches()

    ranked = rows.select("block", "text").mapInArrow(sample, _SENT).groupBy("bucket") \
        .applyInArrow(_ranked_samples, _BACK)

    # texts with exact copies: how many, and which row stands for them
    content = rows.select(F.unhex(F.sha2("text", 256)).alias("c"), "block", F.struct("f", "i").alias("_row"))
    same = content.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("first")).filter("n > 1")
    copied = content.join(same, "c").select("block", F.col("_row.f").alias("f"), F.col("_row.i").alias("i"),
                                            F.when(F.col("_row") == F.col("first"), F.col("n")).otherwise(0).alias("n"))
    told = ranked.select("block", "entries", "counts", F.lit(None).cast("long").alias("f"),
                         F.lit(None).cast("long").alias("i"), F.lit(None).cast("long").alias("n")).unionByName(
        copied.withColumns({"entries": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary")}))

    # 2. suffixes with an equal sample in reach are candidates
    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.to_pylist()
        dup = [(_decoded(r["entries"]), _unplaned(r["counts"], np.uint32)) for r in right if r["entries"] is not None]
        h = np.concatenate([d[0] for d in dup]) if dup else np.zeros(0, np.uint64)
        n_of = np.concatenate([d[1] for d in dup]).astype(np.int64) if dup else np.zeros(0, np.int64)
        order = np.argsort(h)
        h, n_of = h[order], n_of[order]
        copies = {(r["f"], r["i"]): r["n"] for r in right if r["entries"] is None}
        left = left.combine_chunks()
        key = list(zip(left["f"].to_pylist(), left["i"].to_pylist(), strict=True))
        raw, off = utf8(left["text"])
        size = np.diff(off)
        cand = [b""] * len(size)
        times = np.array([copies.get(k, 1) for k in key], np.int64)
        if len(h):
            for a, b in row_chunks(off):
                o = off[a:b + 1] - off[a]
                pos = cover_positions(o, length, v)
                row = np.searchsorted(o, pos, "right") - 1
                use = (size[a:b][row] >= length) & (times[a:b][row] > 0)
                pos, row = pos[use], row[use]
                s = Windows(raw[off[a]:off[b]]).at(pos, short)
                at = np.minimum(np.searchsorted(h, s), len(h) - 1)
                hit = (h[at] == s) & (n_of[at] > times[a:b][row])
                pos, row = pos[hit], row[hit]
                first = np.maximum(pos - (v - 1), o[row])
                last = np.minimum(pos, o[row + 1] - length)
                good = last >= first
                first, last, row = first[good], last[good], row[good]
                if not len(first):
                    continue
                gap = np.append(True, (row[1:] != row[:-1]) | (first[1:] > last[:-1] + 1))
                g = np.flatnonzero(gap)
                e = np.append(g[1:], len(first)) - 1
                spans = np.stack([first[g] - o[row[g]], last[e] + 1 - o[row[g]]], 1)
                for r, x, y in zip(*_groups(row[g]), strict=True):
                    cand[a + r] = spans[x:y].astype("<i8").tobytes()
        whole = (times != 1) & (size >= length)     # copies go, whatever else is found
        view = raw.tobytes()
        texts = left["text"].to_pylist()
        removed = [[{"start": 0, "end": int(n)}] if w else [] for w, n in zip(whole, size, strict=True)]
        sha = [hashlib.sha256(b"" if w else view[off[k]:off[k + 1]]).hexdigest() if w or not cand[k] else None
               for k, w in enumerate(whole)]
        return pa.Table.from_arrays([
            left["id"], left["f"], left["i"], left["block"], pa.array(size, pa.int64()),
            pa.array(removed, pa.list_(struct)), pa.array(sha, pa.string()), pa.array(times, pa.int64()),
            pa.array([t if c else None for t, c in zip(texts, cand, strict=True)], pa.string()),
            pa.array([c or None for c in cand], pa.binary())],
            ["id", "f", "i", "block", "n_bytes", "removed", "kept_sha256", "copies", "text", "candidates"])

    state = landed(rows.groupBy("block").cogroup(told.groupBy("block"))
                   .applyInArrow(candidates, _STATE.format(id=id_type)), "suffixes")
    open_rows = state.filter("candidates IS NOT NULL")

    # 3. sort the candidates on their whole length, a bucket at a time
    size = open_rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("b")).first().b
    wide = max(16, -(-int(size) // bucket_entries))

    def starts(part: pa.Table):
        """Fingerprints and positions of a block's candidates, rows in order."""
        part = part.sort_by([("f", "ascending"), ("i", "ascending")]).combine_chunks()
        raw, off = utf8(part["text"])
        spans = [np.frombuffer(c, "<i8").reshape(-1, 2) + off[k] for k, c in enumerate(part["candidates"].to_pylist())]
        spans = np.concatenate(spans)
        n = spans[:, 1] - spans[:, 0]
        pos = np.repeat(spans[:, 0] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out = []
        for a, b in row_chunks(off):
            x, y = np.searchsorted(pos, [off[a], off[b]])
            out.append(Windows(raw[off[a]:off[b]]).at(pos[x:y] - off[a], length))
        return part, raw, off, pos, np.concatenate(out)

    def send(part: pa.Table) -> pa.Table:
        h = starts(part)[-1]
        return _as_table(_sent(part["block"][0].as_py(), h, wide), _SENT_ARROW)

    narrow = open_rows.select("f", "i", "block", "text", "candidates")
    bits = narrow.groupBy("block").applyInArrow(send, _SENT).groupBy("bucket").applyInArrow(_ranked_windows, _BACK)

    def decide(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _as_table([], _DECIDED_ARROW)
        left, raw, off, pos, h = starts(left)
        u = np.unique(h)
        e = _bucket_edges(u, wide)
        again = np.zeros(len(u), bool)
        for r in right.to_pylist():
            a, b = e[r["bucket"]], e[r["bucket"] + 1]
            again[a:b] = np.unpackbits(np.frombuffer(r["entries"], np.uint8), count=b - a).astype(bool)
        repeats = pos[again[np.searchsorted(u, h)]]
        runs = _runs(repeats, length, off)
        view = raw.tobytes()
        rows = [(f, i, [{"start": a, "end": b} for a, b in runs[k].tolist()], _cut(view[off[k]:off[k + 1]], runs[k]))
                for k, (f, i) in enumerate(zip(left["f"].to_pylist(), left["i"].to_pylist(), strict=True))]
        return _as_table(rows, _DECIDED_ARROW)

    decided = narrow.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(
        decide, "f long, i long, removed array<struct<start:long,end:long>>, kept_sha256 string")
    closed = state.filter("candidates IS NULL OR copies <> 1").select("id", "n_bytes", "removed", "kept_sha256")
    opened = state.filter("candidates IS NOT NULL AND copies = 1").select("id", "n_bytes", "f", "i") \
        .join(decided, ["f", "i"]).select("id", "n_bytes", "removed", "kept_sha256")
    return closed.unionByName(opened)


_DECIDED_ARROW = pa.schema([("f", pa.int64()), ("i", pa.int64()), ("removed", pa.list_(pa.struct(
    [("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeated_spans(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", F.aggregate(
        "removed", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
