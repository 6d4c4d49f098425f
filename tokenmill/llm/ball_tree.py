"""Ranked lexical search by exact sparse ball trees (operator 11).

A document is a sparse vector over the items' terms: each term's component is
its weight times its saturated count, an integer; an item is the 0/1 vector of
its terms, so a score is an inner product of integers. Terms outside all items
cannot change a score and only count towards a document's length.

Every task deals its documents into blocks and builds a ball tree over each:
nodes are halved along the line between two far documents, and a node has its
documents' centroid, the radius of their ball, and their radius along every
axis (how far any of them lies above the centroid there). A document's score
for an item is then at most both

    item . centroid + |item| * radius      and      item . (centroid + axis radii)

The second bound is the tighter one where a node's documents share few of an
item's terms, which is the rule in a space of thousands of axes. Bounds are
rounded up by more than the arithmetic can be off. For each item the nodes are
opened best first, and a subtree whose bound is below the item's k-th best
score so far is dropped; leaves are scored in 64-bit integers, so results are
exact. The best scores live on from block to block of a task.

Items are read in passes of at most ``PASS_TERMS`` distinct terms, and trees
built for blocks of items, so neither grows with the benchmark. Terms are
matched by fingerprint, then byte by byte.

Defined results: a null text or one without a term has no rank and counts in
neither mean nor document count; rows that repeat an item id make one item of
all their terms; repeated documents rank once each; empty tables give no rows.
Equal scores go by ascending ``doc_id``, nulls last. Columns besides ids and
texts are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenmill.llm.common import Powers, byte_values, landed, row_chunks, table, utf8
from tokenmill.llm.words import LOWER
from tokenmill.session import ship_code

TOP = 10
PASS_TERMS = 200_000    # distinct terms of the items of one pass over the documents
BLOCK_TERMS = 16_384    # ... of the items that share a tree
BLOCK_ITEMS = 256
TREE_DOCS = 2048
LEAF_DOCS = 8
TREE_CELLS = 8_000_000  # nodes of a tree times terms of its items

_VALUES = byte_values(19)
_POWERS = Powers(0xD1342543DE82EF95)
_STRIDE = np.uint64(0x9E3779B97F4A7C15)


def terms_of(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and fingerprint of the terms of all rows, and each row's term offsets."""
    low = LOWER[raw]
    word = low > 0
    starts, ends = word.copy(), word.copy()
    starts[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    starts[cut] = word[cut]
    ends[cut - 1] = word[cut - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = _POWERS.get(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_VALUES[low] * up[:len(raw)], out=total[1:])
        h = (total[e] - total[s]) * down[s] ^ (e - s).astype(np.uint64) * _STRIDE
    return s, e, h, np.searchsorted(s, off)


class Terms:
    """Distinct terms (lower-case UTF-8), numbered as given."""

    def __init__(self, terms: list[bytes]):
        off = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
        raw = np.frombuffer(b"".join(terms), np.uint8)
        h = terms_of(raw, off)[2]
        order = np.argsort(h, kind="stable")
        self.raw, self.start, self.number, self.hash = raw, off[:-1], order, h[order]

    def match(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which occurrences are terms, and their numbers; equal fingerprints are compared byte by byte."""
        if not len(self.hash) or not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        hit = np.flatnonzero(self.hash[at] == h)
        number = self.number[at[hit]]
        size = (e - s)[hit]
        first = np.concatenate([[0], np.cumsum(size)])
        inside = np.arange(first[-1]) - np.repeat(first[:-1], size)
        same = LOWER[raw[np.repeat(s[hit], size) + inside]] == self.raw[
            np.minimum(np.repeat(self.start[number], size) + inside, len(self.raw) - 1)]
        ok = np.add.reduceat(~same, first[:-1]) == 0 if len(hit) else np.zeros(0, bool)
        return hit[ok], number[ok]


@dataclass
class Items:
    """Items that share a tree: their terms' numbers, 0/1 rows and positions in the pass."""
    numbers: np.ndarray   # sorted term numbers, one per dimension
    has: np.ndarray       # item x dimension
    place: list[int]

    def terms(self) -> tuple[np.ndarray, np.ndarray]:
        """The items' dimensions one after the other, and where each item's begin."""
        item, dim = np.nonzero(self.has)
        return dim, np.searchsorted(item, np.arange(len(self.has)))


class BallTree:
    """A tree over documents in compressed rows: ``ptr``, dimension ``ids``, integer ``values``.

    ``order`` lists the documents so that each node is a range ``[a, b)``.
    """

    def __init__(self, ptr: np.ndarray, ids: np.ndarray, values: np.ndarray, dims: int, leaf: int = LEAF_DOCS):
        self.ptr, self.ids, self.dims = ptr, ids, dims
        self.x = values.astype(np.float64)
        self.order = np.arange(len(ptr) - 1)
        self.range, self.children, radii = [(0, len(self.order))], [None], []
        self.centroids = np.zeros((4 * len(self.order) // leaf + 4, dims))
        k = 0
        while k < len(self.range):
            a, b = self.range[k]
            docs = self.order[a:b]
            at, row = self._entries(docs)
            self.centroids[k], to_centre, radius = self._ball(at, row, len(docs))
            radii.append(radius)
            if b - a > leaf and to_centre.max() > 0:
                one = docs[to_centre.argmax()]
                near = self._dot(at, row, len(docs), one)
                other = docs[(np.bincount(row, self.x[at] ** 2, len(docs)) - 2 * near).argmax()]
                along = near - self._dot(at, row, len(docs), other)
                self.order[a:b] = docs[np.argsort(along, kind="stable")]
                middle = (a + b) // 2
                self.children[k] = (len(self.range), len(self.range) + 1)
                self.range += [(a, middle), (middle, b)]
                self.children += [None, None]
            k += 1
        # documents in the tree's order: a node is one slice of the entries
        at, _ = self._entries(self.order)
        size = (self.ptr[1:] - self.ptr[:-1])[self.order]
        self.ids, self.x, self.values = self.ids[at], self.x[at], values[at]
        self.ptr = np.concatenate([[0], np.cumsum(size)])
        self.centroids, self.radii = self.centroids[:k], np.array(radii)
        self.peaks = np.zeros((k, dims))   # centroid + radius along every axis
        for k in range(k - 1, -1, -1):
            if self.children[k] is None:
                a, b = self.ptr[list(self.range[k])]
                np.maximum.at(self.peaks[k], self.ids[a:b], self.x[a:b])
            else:
                np.maximum(*self.peaks[list(self.children[k])], out=self.peaks[k])

    def _entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.ptr[docs + 1] - self.ptr[docs]
        row = np.repeat(np.arange(len(docs)), size)
        first = np.cumsum(size) - size
        return np.repeat(self.ptr[docs] - first, size) + np.arange(len(row)), row

    def _ball(self, at: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Centroid, squared distances from it (0 if below their rounding), radius rounded up."""
        ids, x = self.ids[at], self.x[at]
        c = np.bincount(ids, x, self.dims) / n
        square = np.bincount(row, x * (x - 2 * c[ids]), n) + c @ c
        slack = 1e-11 * ((x * x).sum() + c @ c)   # the squares are differences of larger ones
        return c, np.where(square > slack, square, 0), float(np.sqrt(max(square.max(), 0) + slack))

    def _dot(self, at: np.ndarray, row: np.ndarray, n: int, doc: int) -> np.ndarray:
        v = np.zeros(self.dims)
        own = slice(self.ptr[doc], self.ptr[doc + 1])
        v[self.ids[own]] = self.x[own]
        return np.bincount(row, v[self.ids[at]] * self.x[at], n)

    def bounds(self, dim: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Upper bounds (node x item) of the scores below a node, rounded up; items as of ``Items.terms``."""
        lengths = np.sqrt(np.diff(np.append(first, len(dim))))
        ball = np.add.reduceat(self.centroids[:, dim], first, axis=1) + self.radii[:, None] * lengths
        axes = np.add.reduceat(self.peaks[:, dim], first, axis=1)
        return np.minimum(ball, axes) * (1 + 1e-9) + 1.0

    def search(self, has: np.ndarray, bound: np.ndarray, best: Best) -> int:
        """Offer all documents that may be among the best; returns the leaves opened."""
        queue, opened = [(-bound[0], 0)], 0
        while queue and -queue[0][0] >= best.least:
            k = heapq.heappop(queue)[1]
            if self.children[k] is None:
                a, b = self.range[k]
                i, j = self.ptr[a], self.ptr[b]
                best.offer(self.order[a:b], np.add.reduceat(self.values[i:j] * has[self.ids[i:j]], self.ptr[a:b] - i))
                opened += 1
            else:
                for child in self.children[k]:
                    if bound[child] >= best.least:
                        heapq.heappush(queue, (-bound[child], child))
        return opened


class Best:
    """The ``top`` best ``(score, id)`` of one item; scores above 0 only."""

    def __init__(self, top: int):
        self.top, self.rows, self.least = top, [], 1
        self.ids: list = []

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        for k in np.flatnonzero(scores >= self.least).tolist():
            doc_id, score = self.ids[docs[k]], int(scores[k])
            entry = (-score, doc_id is None, 0 if doc_id is None else doc_id)
            if len(self.rows) < self.top or entry < self.rows[-1]:
                self.rows.append(entry)
                self.rows.sort()
                del self.rows[self.top:]
                if len(self.rows) == self.top:
                    self.least = max(1, -self.rows[-1][0])


def count_terms(docs: DataFrame, terms: Terms, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs``: all terms of a document, and those of ``terms`` with their counts."""
    ship_code(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = utf8(batch.column(1))
            for a, b in row_chunks(off):
                part, at = raw[off[a]:off[b]], off[a:b + 1] - off[a]
                s, e, h, first = terms_of(part, at) if len(part) else (*(np.zeros(0, np.int64),) * 3, np.zeros(b - a + 1, np.int64))
                hit, number = terms.match(part, s, e, h)
                row = np.searchsorted(first, hit, "right") - 1
                key, tf = np.unique(row.astype(np.int64) << 32 | number, return_counts=True)
                lists = pa.array(np.searchsorted(key >> 32, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(first).astype(np.int64)),
                     pa.ListArray.from_arrays(lists, pa.array((key & 0xFFFFFFFF).astype(np.int32))),
                     pa.ListArray.from_arrays(lists, pa.array(tf.astype(np.int64)))], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(run, f"doc_id {id_type}, n long, terms array<int>, tfs array<long>")


def saturated(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    m = 100 - 90 + (90 * n * docs) // total
    return (1000000000 * tf) // (1000 * tf + 8 * m)


def _blocks(vectors: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in vectors:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _search(blocks: list[Items], item_ids: list, item_type: pa.DataType, weight: np.ndarray, n_docs: int, total: int, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in item_ids]
        id_type = None
        of_items = [items.terms() for items in blocks]
        widest = max(len(items.numbers) for items in blocks)
        rows = max(LEAF_DOCS, min(TREE_DOCS, TREE_CELLS * LEAF_DOCS // (4 * widest)))
        for t in _blocks(batches, rows):
            id_type = t.schema.field("doc_id").type
            ids = t.column("doc_id").to_pylist()
            terms = t.column("terms").chunk(0)
            size = terms.value_lengths().to_numpy().astype(np.int64)
            number = terms.flatten().to_numpy()
            tf = t.column("tfs").chunk(0).flatten().to_numpy()
            value = weight[number] * saturated(tf, np.repeat(t.column("n").to_numpy(), size), n_docs, total)
            row = np.repeat(np.arange(len(ids)), size)
            for items, (dims, first) in zip(blocks, of_items, strict=True):
                dim = np.searchsorted(items.numbers, number)
                use = items.numbers[np.minimum(dim, len(items.numbers) - 1)] == number
                docs, local = np.unique(row[use], return_inverse=True)
                if not len(docs):
                    continue
                ptr = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(docs)))])
                tree = BallTree(ptr, dim[use], value[use], len(items.numbers))
                bound = tree.bounds(dims, first)
                names = [ids[k] for k in docs.tolist()]
                for k, place in enumerate(items.place):
                    best[place].ids = names
                    tree.search(items.has[k], bound[:, k], best[place])
        if id_type is not None:
            found = [(item_ids[k], None if null else doc_id, -score) for k, b in enumerate(best) for score, null, doc_id in b.rows]
            a, b, c = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, item_type), pa.array(b, id_type), pa.array(c, pa.int64())],
                                             names=["item_id", "doc_id", "score"])
    return run


def _passes(items: DataFrame, pass_terms: int, block_terms: int, block_items: int):
    """``(item ids, terms, blocks)`` of the items of each pass, in the order of their ids."""
    ids: list = []
    number: dict[str, int] = {}
    blocks: list[list[tuple[int, list[int]]]] = [[]]
    in_block: set[int] = set()

    def finish():
        out = []
        for block in filter(None, blocks):
            numbers = np.unique(np.concatenate([n for _, n in block]))
            has = np.zeros((len(block), len(numbers)), bool)
            for k, (_, n) in enumerate(block):
                has[k, np.searchsorted(numbers, n)] = True
            out.append(Items(numbers, has, [p for p, _ in block]))
        return ids, Terms([t.encode() for t in number]), out

    for r in items.orderBy("item_id").toLocalIterator():   # one pass' items at a time
        if ids and len(number) + len(r.terms) > pass_terms:
            yield finish()
            ids, number, blocks, in_block = [], {}, [[]], set()
        own = [number.setdefault(t, len(number)) for t in r.terms]
        if blocks[-1] and (len(blocks[-1]) >= block_items or len(in_block | set(own)) > block_terms):
            blocks.append([])
            in_block = set()
        in_block.update(own)
        blocks[-1].append((len(ids), own))
        ids.append(r.item_id)
    if ids:
        yield finish()


def item_terms(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, terms``: the distinct terms of each item that has one."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    return benchmark.select(F.col(item_id).alias("item_id"), F.explode(words).alias("t")).distinct() \
        .groupBy("item_id").agg(F.sort_array(F.collect_list("t")).alias("terms"))


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP, doc_id: str = "doc_id", item_id: str = "item_id",
           text: str = "text", pass_terms: int = PASS_TERMS, block_terms: int = BLOCK_TERMS,
           block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``item_id, rank, doc_id, score`` of each item's ``top`` best documents."""
    spark = docs.sparkSession
    id_type, item_type = (d.schema[c].dataType.simpleString() for d, c in ((docs, doc_id), (benchmark, item_id)))
    found = spark.createDataFrame([], f"item_id {item_type}, doc_id {id_type}, score long")
    arrow_type = benchmark.select(item_id).limit(0).toArrow().schema.field(0).type
    for item_ids, terms, blocks in _passes(item_terms(benchmark, item_id, text), pass_terms, block_terms, block_items):
        vectors = landed(count_terms(docs, terms, doc_id, text), "vectors")
        n_docs, total = vectors.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        # one row per term of the pass
        df = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")) \
            .select("term", F.floor(F.lit(1000.0) * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1))).alias("w")) \
            .toArrow()
        weight = np.zeros(len(terms.hash), np.int64)
        weight[df["term"].to_numpy()] = df["w"].to_numpy()
        found = found.unionByName(
            vectors.filter(F.size("terms") > 0)
            .mapInArrow(_search(blocks, item_ids, arrow_type, weight, n_docs, total, top),
                        f"item_id {item_type}, doc_id {id_type}, score long"))
    # at most `top` rows per item and task
    rank = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top) \
        .select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
