"""Near-duplicate documents by BagMinHash (operator 8).

A document is the multiset of its five-word shingles. Every (shingle, weight
block) pair, the blocks being [0,1), [1,2), [2,4), [4,8) ..., runs a Poisson
process of its own: its points have an arrival time, a place in the block and
a register, all from hashes. A document keeps the points placed below the
shingle's count, so a document with a larger count keeps a superset, and each
register's earliest point is the same in two documents with probability equal
to their weighted Jaccard similarity (sum of minima over sum of maxima). Only
points up to the time by which the registers are expected to be filled are
drawn; documents with an empty register draw on.

Bands of registers find candidates; all candidates are verified on the whole
multisets, with integers, from the texts. Groups of any size are handled
without listing their pairs:

1. documents with equal multisets are one node;
2. in each bucket every node is compared with the bucket's smallest node;
3. links make connected components;
4. in buckets that still hold several components, nodes are compared with two
   random pivots, again and again, as long as that joins many (at most
   ``PIVOT_TURNS`` times);
5. in what is left, sizes and sketches (a byte per register) of all nodes of
   different components are compared, a large bucket as pairs of blocks. Sizes
   must allow the similarity, and at least 60 of 100 registers must agree; the
   pairs left are verified within the block, which gives out a forest of links.

So of the pairs that share a bucket none is passed over but those in one
component already and those whose sketches disagree. At similarity 0.8 two
documents share none of the 25 buckets, or less than 60 registers, with
probability 2e-6 each.

Defined results: null texts, empty texts and texts without a word are in no
group (a class of their own); texts of fewer than five words are one shingle;
repeated rows are one group, the row with the smallest (id, place) stays;
classes carry the smallest id of their rows; an empty table gives no rows; the
result's columns replace input columns of the same names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import components, landed, mixed, numbered, row_chunks, sorted_groups, table, utf8
from tokenmill.llm.words import shingles
from tokenmill.session import ship_code

REGISTERS = 100
BAND_ROWS = 4
SIMILARITY = 0.8
_UNIT = 2.0 ** -53


def _uniform(key: np.ndarray, seed: int) -> np.ndarray:
    return ((mixed(key, seed) >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT


def _weight_blocks(doc, key, count):
    """The elements (document, block key, rate, block start, count)."""
    parts = []
    j = 0
    while len(doc):
        lo = 0 if j == 0 else 2 ** (j - 1)
        rate = 1 if j == 0 else lo
        parts.append((doc, mixed(key, 100 + j), np.full(len(doc), rate, np.float64),
                      np.full(len(doc), lo, np.float64), count))
        more = count > lo + rate
        doc, key, count = doc[more], key[more], count[more]
        j += 1
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def bag_minhash(doc: np.ndarray, sh: np.ndarray, n_docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures ``[n_docs, registers]`` of the shingle multisets; documents
    without shingles get zeros."""
    sig = np.zeros((n_docs, registers), np.uint64)
    if not len(doc):
        return sig
    order = np.argsort(mixed(doc.astype(np.uint64), 5) + sh)
    d, s = doc[order], sh[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(d))).astype(np.float64)
    elements = _weight_blocks(d[at], s[at], count)
    weight = np.bincount(doc, minlength=n_docs).astype(np.float64)
    limit = np.where(weight > 0, registers * (math.log(registers) + 3) / np.maximum(weight, 1), 0.0)
    flat = sig.reshape(-1)
    best = np.full(n_docs * registers, np.inf)
    while True:
        e_doc, key, rate, lo, cnt = elements
        t = np.zeros(len(key))
        k = 0
        while len(key):
            t = t - np.log(_uniform(key, 1000 + 4 * k)) / rate
            alive = t <= limit[e_doc]
            e_doc, key, rate, lo, cnt, t = (x[alive] for x in (e_doc, key, rate, lo, cnt, t))
            kept = lo + rate * _uniform(key, 1001 + 4 * k) < cnt
            slot = e_doc[kept] * registers + (mixed(key[kept], 1002 + 4 * k) % np.uint64(registers)).astype(np.int64)
            name, when = mixed(key[kept], 1003 + 4 * k), t[kept]
            np.minimum.at(best, slot, when)
            won = when == best[slot]
            flat[slot[won]] = name[won]
            k += 1
        open_docs = np.isinf(best.reshape(n_docs, registers)).any(1) & (weight > 0)
        if not open_docs.any():
            return sig
        limit[open_docs] *= 3
        again = open_docs[elements[0]]
        elements = [x[again] for x in elements]
        best.reshape(n_docs, registers)[open_docs] = np.inf


def band_keys(sig: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    n, m = sig.shape
    bands = sig.reshape(n, m // rows, rows)
    h = np.broadcast_to(mixed(np.arange(m // rows, dtype=np.uint64), 21), bands.shape[:2])
    for j in range(rows):
        h = mixed(h ^ bands[:, :, j], 22 + j)
    return h


_SIGNED = "struct<same:long,n:long,bands:array<long>,sketch:binary>"
BLOCK = 2048      # nodes of a bucket that one task compares with as many others
AGREE = 0.6       # share of registers that agree at least, at similarity 0.8
_SLICE = 64
GRAPH_ROWS = 50_000   # links that one task of a components step reads
PIVOT_TURNS = 4   # what they leave apart is compared by sketches


def signed(df: DataFrame, text: str = "text", registers: int = REGISTERS, rows: int = BAND_ROWS) -> DataFrame:
    """Add ``s``: the multiset's fingerprint, its size and its band keys."""
    ship_code(df.sparkSession)

    @F.arrow_udf(_SIGNED)
    def sign(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in col:
            raw, off = utf8(arr)
            same, size, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            sketches = []
            for a, b in row_chunks(off):
                doc, sh = shingles(raw[off[a]:off[b]], off[a:b + 1] - off[a])
                n = np.bincount(doc, minlength=b - a)
                total = np.zeros(b - a, np.uint64)
                if len(doc):
                    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    with np.errstate(over="ignore"):
                        total[doc[first]] = np.add.reduceat(mixed(sh, 31), first)
                same.append(mixed(total ^ mixed(n.astype(np.uint64), 32), 33).view(np.int64))
                size.append(n)
                sig = bag_minhash(doc, sh, b - a, registers)
                keys.append(band_keys(sig, rows).reshape(-1).view(np.int64))
                sketches.append((mixed(sig, 35) & np.uint64(255)).astype(np.uint8).tobytes())
            n = len(off) - 1
            per = registers // rows
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * per, pa.int32()),
                                             pa.array(np.concatenate(keys), pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(same)), pa.array(
                np.concatenate(size), pa.int64()), lists, pa.Array.from_buffers(
                    pa.binary(registers), n, [None, pa.py_buffer(b"".join(sketches))]).cast(pa.binary())],
                ["same", "n", "bands", "sketch"])

    return df.withColumn("s", sign(F.col(text)))


def overlaps(raw_a, off_a, raw_b, off_b) -> tuple[np.ndarray, np.ndarray]:
    """Sums of minima and of maxima of the two multisets, pair by pair."""
    da, sa = shingles(raw_a, off_a)
    db, sb = shingles(raw_b, off_b)
    side = np.concatenate([np.zeros(len(da), np.int64), np.ones(len(db), np.int64)])
    return _overlap(np.concatenate([da, db]), np.concatenate([sa, sb]), side, len(off_a) - 1)


def _overlap(pair, key, side, n) -> tuple[np.ndarray, np.ndarray]:
    if not len(key):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(mixed(pair.astype(np.uint64), 5) + key)
    pair, key, side = pair[order], key[order], side[order]
    at = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]) | (key[1:] != key[:-1])))
    in_b = np.add.reduceat(side, at)
    in_a = np.diff(np.append(at, len(key))) - in_b
    low, high = np.minimum(in_a, in_b), np.maximum(in_a, in_b)
    return (np.bincount(pair[at], low, n).astype(np.int64), np.bincount(pair[at], high, n).astype(np.int64))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``low`` and ``high``; ``texts(node, text)``."""

    @F.arrow_udf("struct<low:long,high:long>")
    def compare(a: pa.Array, b: pa.Array) -> pa.Array:
        (raw_a, off_a), (raw_b, off_b) = utf8(a), utf8(b)
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in row_chunks(off_a + off_b):
            x, y = overlaps(raw_a[off_a[i]:off_a[j]], off_a[i:j + 1] - off_a[i],
                            raw_b[off_b[i]:off_b[j]], off_b[i:j + 1] - off_b[i])
            low.append(x)
            high.append(y)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))],
                                          ["low", "high"])

    left, right = texts.toDF("a", "_ta"), texts.toDF("b", "_tb")
    got = pairs.join(left, "a").join(right, "b").select("a", "b", compare("_ta", "_tb").alias("s"))
    return got.select("a", "b", "s.low", "s.high")


def _with_components(held: DataFrame, comp: DataFrame) -> DataFrame:
    return held.join(comp, "node").select("key", "c", "node", F.col("component").alias("comp"))


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after ``links``: components of the links between components, then one join."""
    a, b = comp.toDF("a", "ca"), comp.toDF("b", "cb")
    between = links.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b").distinct()
    to = components(between, task_rows=GRAPH_ROWS).toDF("component", "to")
    return landed(comp.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "classes")


def _candidates(t: pa.Table, similarity: float, agree: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one block pair that are in different components, whose
    sizes and sketches allow a link, and that share no earlier bucket."""
    part, node, comp, n = (t.column(c).to_numpy() for c in ("part", "node", "comp", "n"))
    none = np.zeros(0, np.int64)
    if len(t) < 2 or (comp == comp[0]).all():
        return none, none
    sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(t), -1)
    bands = t.column("bands").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
    key = t.column("key")[0].as_py()
    crossing = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    left, right = [none], [none]
    for k in range(0, len(t), _SLICE):
        s = slice(k, k + _SLICE)
        ok = (comp[s, None] != comp[None, :]) & (node[s, None] < node[None, :])
        ok &= np.minimum(n[s, None], n[None, :]) >= similarity * np.maximum(n[s, None], n[None, :]) - 1e-9
        if crossing:
            ok &= part[s, None] != part[None, :]
        a, b = np.nonzero(ok)
        a += k
        for x in range(0, len(a), 65536):
            c, d = a[x:x + 65536], b[x:x + 65536]
            near = (sketch[c] == sketch[d]).sum(1) >= agree
            c, d = c[near], d[near]
            first = (bands[c] == bands[d]).argmax(1)
            own = bands[c, first] == key
            left.append(c[own])
            right.append(d[own])
    return np.concatenate(left), np.concatenate(right)


def _suspects(batches: Iterator[pa.RecordBatch], similarity: float, agree: int) -> Iterator[pa.RecordBatch]:
    """The rows of each block pair that are in some candidate pair."""
    for t in sorted_groups(batches, ["key", "i", "j"]):
        a, b = _candidates(t, similarity, agree)
        if len(a):
            yield from t.take(pa.array(np.union1d(a, b))).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch], similarity: float, agree: int) -> Iterator[pa.RecordBatch]:
    """Verify the candidate pairs of each block pair; give out a forest of the links."""
    for t in sorted_groups(batches, ["key", "i", "j"]):
        a, b = _candidates(t, similarity, agree)
        if not len(a):
            continue
        raw, off = utf8(t.column("text"))
        doc, sh = shingles(raw, off)
        at = np.searchsorted(doc, np.arange(len(t) + 1))
        size = np.diff(at)
        hit = []
        for x in range(0, len(a), 1000):
            c, d = a[x:x + 1000], b[x:x + 1000]
            row = np.concatenate([c, d])
            m = size[row]
            pos = np.repeat(at[row] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            pair = np.repeat(np.tile(np.arange(len(c)), 2), m)
            side = np.repeat(np.repeat([0, 1], len(c)), m)
            low, high = _overlap(pair, sh[pos], side, len(c))
            hit.append(low >= high * similarity - 1e-9)
        hit = np.concatenate(hit)
        a, b = a[hit], b[hit]
        if not len(a):
            continue
        node = t.column("node").to_numpy()
        label = node.copy()
        while True:
            low, before = np.minimum(label[a], label[b]), label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            if (label == before).all():
                break
        used = np.flatnonzero(label != node)
        yield pa.RecordBatch.from_arrays([pa.array(node[used]), pa.array(label[used])], ["a", "b"])


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                    registers: int = REGISTERS, band_rows: int = BAND_ROWS) -> DataFrame:
    """``docs`` with ``class_id`` (smallest id of the class), ``class_size`` and
    ``kept`` (one row of each class)."""
    rows = numbered(docs)
    sig = landed(signed(rows.select(F.col(doc_id).alias("id"), "_row", F.col(text).alias("t")), "t", registers,
                        band_rows).drop("t"), "signatures")
    nodes = landed(sig.filter("s.n > 0").groupBy(F.col("s.same").alias("node")).agg(
        F.min("_row").alias("_row"), F.first("s.bands").alias("bands"), F.first("s.n").alias("n"),
        F.first("s.sketch").alias("sketch")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("c"), F.count(F.lit(1)).alias("n")) \
        .filter("n > 1").drop("n")
    # nodes that share a bucket, with the bucket's smallest node as its centre
    held = landed(members.join(buckets, "key"), "buckets")
    need = held.select("node").distinct().join(nodes.select("node", "_row"), "node")
    texts = landed(rows.select("_row", F.coalesce(F.col(text), F.lit("")).alias("text")).join(need, "_row")
                   .select("node", "text"), "texts")
    link = F.col("low") >= F.col("high") * F.lit(similarity) - 1e-9
    star = held.filter("node <> c").select(F.col("c").alias("a"), F.col("node").alias("b")).distinct()
    near = landed(verified(star, texts), "star")
    comp = landed(held.select("node").distinct().join(components(near.filter(link), task_rows=GRAPH_ROWS), "node", "left")
                  .select("node", F.coalesce("component", "node").alias("component")), "classes")

    # random pivots join what the centre left apart, as long as they find many links
    turn, tested, joined = 0, 1, 1
    while joined * 20 >= tested > 0 and turn < PIVOT_TURNS:
        seen = _with_components(held, comp)
        pivots = seen.select("key", F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "comp").alias("p")) \
            .groupBy("key").agg(F.min("p").alias("low"), F.max("p").alias("high"))
        cross = landed(seen.join(pivots, "key").select("node", "comp", F.explode(F.array("low", "high")).alias("p"))
                       .filter("comp <> p.comp").select(F.least("node", "p.node").alias("a"),
                                                        F.greatest("node", "p.node").alias("b")).distinct(), "pivots")
        found = landed(verified(cross, texts).filter(link).select("a", "b"), "pivots")
        tested, joined = cross.count(), found.count()
        if joined:
            comp = _joined(comp, found)
        turn += 1

    # what is still apart: compare the sketches of different components
    seen = _with_components(held, comp)
    mixed_keys = seen.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("m")) \
        .filter("x <> y").select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    shared = seen.join(mixed_keys, "key").withColumn("part", F.pmod(F.xxhash64("node", "key"), "parts").cast("int"))
    dealt = shared.select("key", "node", "comp", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")) \
        .join(nodes.select("node", "n", "sketch", "bands"), "node") \
        .select("key", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "node", "comp", "n",
                "sketch", "bands")
    agree = int(AGREE * registers)
    by = ["key", "i", "j"]
    work = dealt.repartition(*by).sortWithinPartitions(*by, "node")
    suspects = landed(work.mapInArrow(lambda b: _suspects(b, similarity, agree), work.schema), "suspects")
    read = suspects.join(texts, "node").repartition(*by).sortWithinPartitions(*by, "node") \
        .select(*suspects.columns, "text")
    comp = _joined(comp, read.mapInArrow(lambda b: _linked(b, similarity, agree), "a long, b long"))

    named = sig.select("id", "_row", F.when(F.col("s.n") > 0, F.col("s.same")).alias("node")) \
        .join(comp, "node", "left").withColumn("g", F.coalesce("component", "node"))
    first = named.filter("g IS NOT NULL").groupBy("g").agg(
        F.min(F.struct("id", "_row")).alias("first"), F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    answer = named.join(first, "g", "left").select(
        "_row", F.when(F.col("g").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.coalesce(F.col("first._row") == F.col("_row"), F.lit(True)).alias("kept"))
    return rows.drop("class_id", "class_size", "kept").join(answer, "_row").drop("_row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "class_size", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    names = docs.columns
    return near_duplicates(docs).filter("kept").select(*names)
