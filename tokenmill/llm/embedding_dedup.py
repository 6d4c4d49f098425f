"""Near-duplicate embeddings by E8 lattice hashing (operator 5).

Each of ``tables`` tables projects the unit vectors at random to 8 dimensions,
twice, scales them and decodes each projection to its nearest E8 lattice point;
the two points are the vector's cell. Besides its home cell a vector probes the
``probes`` neighbouring cells its projection lies nearest to. Vectors that
share a cell are compared by cosine in double precision; nothing below the
threshold is linked. All vectors are indexed; the tables are drawn from a seed,
not fitted. For pairs at cosine 0.95 in 64 dimensions two vectors share a cell
with probability 0.99 (the README has the measured recall).

Equal vectors are one node with a multiplicity. A cell's members are cut into
blocks of about ``block`` vectors and block pairs are compared, so no task
holds a whole large cell; a block pair gives out per-vector link counts and a
spanning forest, never its pairs. A pair that shares several cells is counted
in the smallest cell alone.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths never link; repeated
rows link with each other; a null id is the largest id when the smallest is
taken; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import components, landed, mixed, numbered, table
from tokenmill.session import ship_code

COSINE = 0.95
TABLES = 10
PROBES = 3
SCALE = 0.7
POINTS = 2        # lattice points per cell
BLOCK = 512
SEED = 8


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest non-zero vectors of E8."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(out)


_SHORT = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer point of even sum: if the sum is odd, the coordinate
    rounded by the most is rounded the other way."""
    r = np.rint(x)
    d = x - r
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    worst = np.abs(d[odd]).argmax(1)
    r[odd, worst] += np.where(d[odd, worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point: of the two cosets D8 and D8 + 1/2 the closer one."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def cell_keys(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int = SEED) -> np.ndarray:
    """Home and probed cells of every vector, as 64-bit keys ``[n, tables * (probes + 1)]``."""
    n, dim = unit.shape
    keys = []
    for t in range(tables):
        rng = np.random.default_rng([seed, t, dim])
        points, nearby = [], []
        for _ in range(POINTS):
            y = scale * (unit @ rng.normal(size=(dim, 8)))
            at = nearest_e8(y)
            points.append(at)
            nearby.append((y - at) @ _SHORT.T)
        home = (2 * np.concatenate(points, 1)).astype(np.int64)
        best = np.argsort(-np.concatenate(nearby, 1), axis=1, kind="stable")[:, :probes]
        for p in range(probes + 1):
            cell = home.copy()
            if p:
                step = (2 * _SHORT[best[:, p - 1] % len(_SHORT)]).astype(np.int64)
                for k in range(POINTS):
                    at = best[:, p - 1] // len(_SHORT) == k
                    cell[at, 8 * k:8 * k + 8] += step[at]
            h = np.full(n, t * 1_000_003 + dim, np.uint64)
            for j in range(cell.shape[1]):
                h = mixed(h ^ cell[:, j].view(np.uint64), 41 + j)
            keys.append(h.view(np.int64))
    return np.stack(keys, 1) if keys else np.zeros((n, 0), np.int64)


def _by_length(arr: pa.Array):
    """Index and double vectors of the usable rows, one vector length at a time."""
    rows = arr.to_numpy(zero_copy_only=False) if len(arr) else np.zeros(0, object)
    size = np.array([-1 if r is None else len(r) for r in rows], np.int64)
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        yield at, np.array([np.asarray(rows[i], np.float64) for i in at])


def _units(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so nothing overflows."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def usable(col: str):
    c = F.col(col)
    return F.coalesce(F.exists(c, lambda x: x != 0) & ~F.exists(
        c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def _pairs_in(part: np.ndarray, node, mult, keys, unit, key, crossing, cosine):
    """Link counts and forest labels of one block pair of one cell."""
    sim = unit @ unit.T
    hit = np.triu(sim >= cosine, 1)
    if crossing:
        hit &= part[:, None] != part[None, :]
    a, b = np.nonzero(hit)
    if not len(a):
        return None
    least = np.full(len(a), np.iinfo(np.int64).max)
    for j in range(keys.shape[1]):   # smallest cell that both are in
        k = keys[a, j]
        shared = (keys[b] == k[:, None]).any(1)
        least = np.where(shared, np.minimum(least, k), least)
    own = least == key
    a, b = a[own], b[own]
    if not len(a):
        return None
    degree = np.zeros(len(node), np.int64)
    np.add.at(degree, a, mult[b])
    np.add.at(degree, b, mult[a])
    label = node.copy()
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        if (label == before).all():
            break
    used = np.flatnonzero(degree)
    return node[used], degree[used], label[used]


def _compare_blocks(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, i, j); a block pair may reach over several batches."""
    rest: pa.Table | None = None

    def run(t: pa.Table, last: bool):
        t = t.combine_chunks()
        cols = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        n = len(t)
        edge = np.flatnonzero(np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols]))) if n else []
        stop = np.append(edge, n)
        whole = len(edge) if last else len(edge) - 1
        out = []
        if whole > 0:
            part, node, mult = (t.column(c).to_numpy() for c in ("part", "node", "mult"))
            many = np.flatnonzero(np.diff(stop[:whole + 1]) > 1)
            vec, keys = t.column("embedding"), t.column("keys")
            for g in many:
                a, b = int(stop[g]), int(stop[g + 1])
                rows = vec.slice(a, b - a).combine_chunks()
                rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
                width = len(rows[0])
                unit = _units(rows.flatten().to_numpy().astype(np.float64).reshape(b - a, width))
                kk = keys.slice(a, b - a).combine_chunks()
                kk = kk.chunk(0) if isinstance(kk, pa.ChunkedArray) else kk
                got = _pairs_in(part[a:b], node[a:b], mult[a:b], kk.flatten().to_numpy().reshape(b - a, -1), unit,
                                cols[0][a], cols[1][a] != cols[2][a], cosine)
                if got is not None:
                    out.append(got)
        return out, t.slice(int(stop[whole]) if whole >= 0 else 0)

    def as_batch(out):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)],
                                          ["node", "degree", "label"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None and len(rest) else t
        out, rest = run(t, False)
        if out:
            yield as_batch(out)
    if rest is not None and len(rest):
        out, _ = run(rest, True)
        if out:
            yield as_batch(out)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
                 tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, block: int = BLOCK) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``."""
    ship_code(vectors.sparkSession)
    rows = numbered(vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")))
    rows = rows.withColumn("ok", usable("embedding"))
    node = F.xxhash64("_row.f", "_row.i")

    @F.arrow_udf("array<long>")
    def cells(col: pa.Array) -> pa.Array:
        out: list = [None] * len(col)
        for at, v in _by_length(col):
            for i, k in zip(at, cell_keys(_units(v), tables, probes, scale), strict=True):
                out[i] = np.unique(k)
        width = max((len(k) for k in out if k is not None), default=0)
        # equal widths: the smallest key stands in for repeated ones
        return pa.array([None if k is None else np.concatenate([np.repeat(k[:1], width - len(k)), k]) for k in out],
                        pa.list_(pa.int64()))

    distinct = landed(rows.filter("ok").groupBy("embedding").agg(F.min(node).alias("node"),
                                                                 F.count(F.lit(1)).alias("mult"))
                      .withColumn("keys", cells("embedding")), "vectors")
    full = tables * (probes + 1)
    padded = F.concat(F.array_repeat(F.element_at("keys", 1), F.lit(full) - F.size("keys")), F.col("keys"))
    distinct = distinct.withColumn("keys", padded)
    members = distinct.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    cell = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = members.join(cell, "key").withColumn("parts", F.ceil(F.col("n") / block).cast("int")) \
        .withColumn("part", F.pmod(F.xxhash64("node", "key"), F.col("parts")).cast("int"))
    dealt = shared.select("key", "node", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")) \
        .select("key", "node", "part", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j")).distinct()
    work = dealt.join(distinct, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node") \
        .select("key", "i", "j", "part", "node", "mult", "embedding", "keys")
    found = landed(work.mapInArrow(lambda b: _compare_blocks(b, cosine), "node long, degree long, label long"), "links")
    comp = components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
    degree = found.groupBy("node").agg(F.sum("degree").alias("degree"))
    named = rows.join(distinct.select("embedding", "node", "mult").withColumn("ok", F.lit(True)), ["embedding", "ok"],
                      "left").join(degree, "node", "left").join(comp, "node", "left") \
        .withColumn("g", F.coalesce("component", "node"))
    lowest = named.filter("g IS NOT NULL").groupBy("g").agg(F.min("vec_id").alias("component_id"))
    return named.join(lowest, "g", "left").select(
        "vec_id", F.coalesce(F.coalesce("degree", F.lit(0)) + F.col("mult") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("g").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")) \
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
