"""Benchmark decontamination by a generalised suffix automaton (operator 3).

The words of all test items build one generalised suffix automaton. Documents
stream through it: each word extends the longest match or follows suffix links
to a shorter one; where the match reaches ``window`` words, the last
``window`` words are an occurrence of an item's window. Items of fewer words
are one window of their own length. Words are compared by 64-bit fingerprints,
computed for a batch at once; only stretches whose neighbouring word pairs all
occur in some item enter the automaton, since no match can leave them.

Test items are the small side: they are read in blocks of at most
``block_words`` words, an automaton each (building takes up to 1.6 KB a word,
so some 300 MB), and the documents are streamed once per block, in tasks of
their own. So neither the driver nor a worker holds more than a block's
automaton at a time. The rows that a block hits are few; only these are
grouped and joined with the documents.

``remove_spans`` cuts from the texts what a length or a coverage limit forbids.

Defined results: null or empty texts have no words and no hits; items without
words never match; repeated items all count, repeated ids once; a null item id
takes part as the empty string; an empty item table leaves everything clean.
Existing columns with the result's names are replaced. Cutting leaves a null or
empty text as it is and never joins two words, since what parts a span from its
neighbours stays.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.llm.common import numbered, private, row_chunks, table, utf8
from tokenmill.llm.words import fingerprint_words, word_bytes
from tokenmill.session import ship_code

WINDOW = 13
BLOCK_WORDS = 200_000
SPAN_WORDS = 26      # hit words in a row, two windows full, that are cut whatever their share of the text


class SuffixAutomaton:
    """All substrings of the items, as word numbers."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        owners: list[set[int]] = [set()]
        self.names = [name for name, _ in items]
        for k, (_, words) in enumerate(items):
            at = 0
            for w in words:
                at = self._extend(at, w, owners)
                owners[at].add(k)
        # items whose window ends in a state: those of the states below it
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True)
        for u in order:
            up = self.link[u]
            if up > 0 and self.size[up] >= window:
                owners[up] |= owners[u]
        self.owners = [frozenset(x) if self.size[u] >= window else None for u, x in enumerate(owners)]
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.least = window
        for k, (_, words) in enumerate(items):
            if 0 < len(words) < window:
                at = 0
                for w in words:
                    at = self.step[at][w]
                self.short.setdefault(at, []).append((len(words), k))
                self.least = min(self.least, len(words))

    def _new(self, size, step, link, owners):
        self.size.append(size)
        self.step.append(step)
        self.link.append(link)
        owners.append(set())
        return len(self.size) - 1

    def _split(self, p, w, owners):
        """The state for p's string plus w alone, parted from longer strings."""
        q = self.step[p][w]
        if self.size[q] == self.size[p] + 1:
            return q
        c = self._new(self.size[p] + 1, dict(self.step[q]), self.link[q], owners)
        self.link[q] = c
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = c
            p = self.link[p]
        return c

    def _extend(self, last, w, owners):
        if w in self.step[last]:
            return self._split(last, w, owners)
        new = self._new(self.size[last] + 1, {}, 0, owners)
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, owners)
        return new

    def matches(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Occurrences ``(first word, end)`` of windows, and the items they are of."""
        at = length = 0
        spans, found = [], set()
        step, link, size = self.step, self.link, self.size
        for t, w in enumerate(words):
            while at and w not in step[at]:
                at = link[at]
                length = size[at]
            if w in step[at]:
                at = step[at][w]
                length += 1
            else:
                length = 0
            if length >= self.window:
                u = at
                while size[link[u]] >= self.window:
                    u = link[u]
                spans.append((t + 1 - self.window, t + 1))
                found |= self.owners[u]
            if self.short:
                u = at
                while u > 0:
                    for m, k in self.short.get(u, ()):
                        if m <= length:
                            spans.append((t + 1 - m, t + 1))
                            found.add(k)
                    u = link[u]
        return spans, found


class Matcher:
    """An automaton and the word tables that pick the stretches for it."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        arr = pa.array([t or "" for _, t in items], pa.string())
        h, off = fingerprint_words(*utf8(arr))
        self.words = np.unique(h)
        ids = np.searchsorted(self.words, h)
        v = max(len(self.words), 1)
        pair = ids[:-1].astype(np.int64) * v + ids[1:]
        inside = np.ones(len(pair), bool)
        cut = off[1:-1]
        inside[cut[(cut > 0) & (cut <= len(pair))] - 1] = False
        self.pairs = np.unique(pair[inside])
        self.auto = SuffixAutomaton(
            [(name, ids[off[i]:off[i + 1]].tolist()) for i, (name, _) in enumerate(items)], window)

    def rows(self, raw: np.ndarray, off: np.ndarray):
        """Per row: word count, hit spans (merged, in words), item names."""
        h, wo = fingerprint_words(raw, off)
        n = len(off) - 1
        spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        if len(h) and len(self.words):
            ids = np.searchsorted(self.words, h)
            ids[ids == len(self.words)] = 0
            known = self.words[ids] == h
            joined = np.zeros(len(h), bool)      # to the word before
            joined[1:] = known[1:] & known[:-1]
            joined[wo[:-1][wo[:-1] < len(h)]] = False
            t = np.flatnonzero(joined)
            if len(t) and len(self.pairs):
                pair = ids[t - 1].astype(np.int64) * max(len(self.words), 1) + ids[t]
                p = np.searchsorted(self.pairs, pair)
                p[p == len(self.pairs)] = 0
                joined[t] = self.pairs[p] == pair
            else:
                joined[:] = False
            first = np.flatnonzero(known & ~joined)
            stop = np.append(np.flatnonzero(~joined), len(h))
            end = stop[np.searchsorted(stop, first, "right")]
            long = end - first >= self.auto.least
            row = np.searchsorted(wo, first[long], "right") - 1
            for r, a, b in zip(row.tolist(), first[long].tolist(), end[long].tolist(), strict=True):
                got, found = self.auto.matches(ids[a:b].tolist())
                base = a - int(wo[r])
                spans[r] += [(base + x, base + y) for x, y in got]
                items[r].update(self.auto.names[k] for k in found)
        return np.diff(wo), [merged(s) for s in spans], items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        if size >= block_words:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1]) // 2 + 1
    yield block


_FOUND = "struct<n_words:long,spans:array<struct<start:long,end:long>>,items:array<string>>"


def _matched(df: DataFrame, text: str, matcher: Matcher, name: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(matcher)

    @F.arrow_udf(_FOUND)
    def found(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        for arr in col:
            raw, off = utf8(arr)
            counts, spans, items = [], [], []
            for a, b in row_chunks(off):
                n, s, i = m.rows(raw[off[a]:off[b]], off[a:b + 1] - off[a])
                counts.append(n)
                spans += s
                items += i
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(counts) if counts else np.zeros(0, np.int64), pa.int64()),
                 pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], pa.list_(pair)),
                 pa.array([sorted(i) for i in items], pa.list_(pa.string()))], ["n_words", "spans", "items"])

    return df.withColumn(name, found(F.col(text)))


def _matched_blocks(docs: DataFrame, text: str, first: Matcher, blocks: Iterator[list[tuple[str, str]]],
                    window: int, name: str) -> DataFrame:
    """As ``_matched``, by several blocks: one pass each over the documents,
    whose hit rows are united, grouped by row and joined with the first pass."""
    row = private(docs, "_row")
    placed = numbered(docs, row)
    out = _matched(placed, text, first, name)
    rest = None
    for block in blocks:
        hits = _matched(placed.select(row, text), text, Matcher(block, window), name) \
            .filter(F.size(F.col(name)["spans"]) > 0).select(row, F.col(name)["spans"].alias("s"), F.col(name)["items"].alias("i"))
        rest = hits if rest is None else rest.unionAll(hits)
    more = private(docs, "_more")
    rest = rest.groupBy(row).agg(F.struct(F.flatten(F.collect_list("s")).alias("spans"),
                                          F.flatten(F.collect_list("i")).alias("items")).alias(more))
    # sort the spans of all blocks, then merge those that overlap
    every = F.array_sort(F.concat(F.col(name)["spans"], F.col(more)["spans"]))
    spans = F.aggregate(every, F.lit([]).cast("array<struct<start:long,end:long>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))
    hits = F.array_sort(F.array_distinct(F.concat(F.col(name)["items"], F.col(more)["items"])))
    return out.join(rest, row, "left").withColumn(name, F.when(F.col(more).isNull(), F.col(name)).otherwise(
        F.struct(F.col(name)["n_words"].alias("n_words"), spans.alias("spans"), hits.alias("items")))).drop(row, more)


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW, coverage: float = 0.05,
                       block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add ``n_words``, ``n_hit``, ``hit_spans`` (word ranges, end exclusive),
    ``hit_items`` and ``contaminated`` (hits reach ``coverage`` of the words)."""
    ship_code(docs.sparkSession)
    small = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.coalesce(F.col(item_text), F.lit("")))
    blocks = _blocks(small, block_words)
    found = private(docs, "_found")
    first, second = Matcher(next(blocks), window), next(blocks, None)
    if second is None:
        out = _matched(docs, text, first, found)
    else:
        out = _matched_blocks(docs, text, first, itertools.chain([second], blocks), window, found)
    out = out.withColumns({"n_words": F.col(found)["n_words"], "hit_spans": F.col(found)["spans"],
                           "hit_items": F.col(found)["items"]}).drop(found)
    out = out.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"),
                                              lambda acc, s: acc + s["end"] - s["start"]))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * coverage))


@F.arrow_udf(T.StringType())
def _without(col: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the bytes from each span's first word to its last."""
    raw, off = utf8(col)
    out = []
    for k, cuts in enumerate(spans.to_pylist()):
        part = raw[off[k]:off[k + 1]]
        first, end = word_bytes(part, np.array([0, len(part)]))
        edges = [0, *(x for s in cuts for x in (int(first[s["start"]]), int(end[s["end"] - 1]))), len(part)]
        out.append(b"".join(part[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)).decode())
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", span_words: int = SPAN_WORDS,
                 coverage: float = 0.05, **options) -> DataFrame:
    """``find_contamination`` with the hit spans beyond the limits cut from ``text``.

    A span of ``span_words`` words or more exceeds the length limit. If all hits
    reach ``coverage`` of a document's words, all its spans go. Added:
    ``cut_spans`` (word ranges of the text given) and ``n_cut`` (words).
    """
    got = find_contamination(docs, items, text=text, coverage=coverage, **options)
    got = got.withColumn("cut_spans", F.when(F.col("contaminated"), F.col("hit_spans")).otherwise(
        F.filter("hit_spans", lambda s: s["end"] - s["start"] >= span_words)))
    got = got.withColumn("n_cut", F.aggregate("cut_spans", F.lit(0).cast("long"),
                                              lambda acc, s: acc + s["end"] - s["start"]))
    # only texts that lose something reach Python
    cut = F.when(F.col("n_cut") > 0, F.col(text))
    spans = F.when(F.col("n_cut") > 0, F.col("cut_spans")).otherwise(F.array().cast("array<struct<start:long,end:long>>"))
    return got.withColumn(text, F.when(F.col("n_cut") > 0, _without(cut, spans)).otherwise(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))).alias("contaminated"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the contaminated documents; the others stay as they are."""
    names = docs.columns
    got = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return got.filter((F.col("n_hit") == 0) | (F.col("n_hit") * 20 < F.col("n_words"))).select(*names)
