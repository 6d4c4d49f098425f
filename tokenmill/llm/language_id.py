"""Language identification by prediction by partial matching (operator 4).

One byte context tree of variable order (up to two bytes of context) per
language is learned from all labelled rows: Spark sums the counts of
(language, two context bytes, byte). The frozen statistics give the exact
code length of every byte: the longest known context predicts it, or an
escape (method C, with exclusion of the symbols already refused) goes to the
next shorter context and at last to a uniform choice of the bytes left. Since
the code length depends on three bytes only, it is tabled once per language;
a text's score is the sum over all of its bytes, in 1/65536 bit, so sums are
exact and do not depend on batches.

The model holds at most 257^3 counts per language, whatever the corpus size;
only that table goes to the driver and to the workers.

Defined results: null text, empty text or text without a letter: ``und``,
score 0. Rows of equal text get equal answers; ties go to the smallest
language name. Without any learned language all texts are ``und``. Very long
texts are scored whole, in chunks. Columns that the input already has under
the result's names are replaced, other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.llm.common import row_chunks, table, utf8
from tokenmill.session import ship_code

UNDETERMINED = "und"
START = 256          # stands for the missing context before a text's first byte
BASE = 257
UNIT = 65536.0       # code lengths are held in 1/65536 bit
DENSE = 1 << 24      # counts are tabled densely up to this many cells, else sorted


def _trigrams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two context symbols and the symbol at every byte; contexts end at a text's start."""
    c0 = raw.astype(np.int32)
    c1 = np.empty_like(c0)
    c2 = np.empty_like(c0)
    if len(c0):
        c1[1:] = c0[:-1]
        c2[2:] = c0[:-2]
        first = off[:-1][np.diff(off) > 0]
        second = off[:-1][np.diff(off) > 1] + 1
        c1[first] = START
        c2[first] = START
        c2[second] = START
    return c2, c1, c0


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names = langs.dictionary.to_pylist()
        which = langs.indices.to_numpy(zero_copy_only=False)
        raw, off = utf8(batch.column(1))
        for a, b in row_chunks(off):
            o = off[a:b + 1] - off[a]
            c2, c1, c0 = _trigrams(raw[off[a]:off[b]], o)
            if not len(c0):
                continue
            lang = np.repeat(which[a:b], np.diff(o)).astype(np.int64)
            used = np.zeros(BASE, bool)
            used[c0] = used[START] = True
            sym = np.flatnonzero(used)
            n = len(sym)
            cls = np.zeros(BASE, np.int64)
            cls[sym] = np.arange(n)
            code = ((lang * n + cls[c2]) * n + cls[c1]) * n + cls[c0]
            if len(names) * n ** 3 <= DENSE:
                full = np.bincount(code)
                key = np.flatnonzero(full)
                cnt = full[key]
            else:
                key, cnt = np.unique(code, return_counts=True)
            g = (sym[key // (n * n) % n] * BASE + sym[key // n % n]) * BASE + sym[key % n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in key // n ** 3], pa.string()), pa.array(g, pa.int64()),
                 pa.array(cnt, pa.int64())], ["lang", "gram", "n"])


def learn_counts(labelled: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``(lang, gram, n)``: how often each byte follows two context bytes, over all rows."""
    ship_code(labelled.sparkSession)
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()) \
        .select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    return rows.mapInArrow(_count_batches, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ByteModel:
    """Frozen code lengths ``cost[c2, c1, c0, language]`` over byte classes.

    Class 0 is the start of a text, the last class all bytes never learned
    (they share one code length: uniform among the unseen ones).
    """

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        gram = counts["gram"].to_numpy(np.int64)
        c2, c1, c0 = gram // BASE ** 2, gram // BASE % BASE, gram % BASE
        sym = np.unique(c0)
        size = len(sym) + 2
        self.cls = np.full(BASE, size - 1, np.int32)
        self.cls[sym] = np.arange(1, size - 1)
        self.cls[START] = 0
        self.size = size
        self.cost = np.zeros((size, size, size, len(self.langs)), np.int32)
        which = pd.Categorical(counts["lang"], categories=self.langs).codes
        n = counts["n"].to_numpy(np.float64)
        for k in range(len(self.langs)):
            at = which == k
            full = np.zeros((size, size, size))
            np.add.at(full, (self.cls[c2[at]], self.cls[c1[at]], self.cls[c0[at]]), n[at])
            one = full.sum(0)
            zero = one.sum(0)
            for a in range(size):
                self.cost[a, :, :, k] = np.rint(_code_lengths(full[a], one, zero) * UNIT)
        self.cost = self.cost.reshape(size ** 3, len(self.langs))

    def bits(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length of every row per language, in bits (exact in 1/65536)."""
        out = np.zeros((len(off) - 1, len(self.langs)), np.int64)
        for a, b in row_chunks(off, 1_000_000):
            o = off[a:b + 1] - off[a]
            full = np.flatnonzero(np.diff(o))
            if not len(full):
                continue
            c2, c1, c0 = _trigrams(raw[off[a]:off[b]], o)
            code = (self.cls[c2] * self.size + self.cls[c1]) * self.size + self.cls[c0]
            got = [np.add.reduceat(self.cost[code, k], o[full], dtype=np.int64) for k in range(len(self.langs))] \
                if len(code) < 64 else np.add.reduceat(self.cost[code], o[full], axis=0, dtype=np.int64).T
            out[a + full] = np.array(got).T
        return out / UNIT


def _code_lengths(two: np.ndarray, one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """-log2 P(symbol | context) for all contexts ``(c1)`` of one ``c2`` row."""
    p = np.zeros_like(two)
    reach = np.ones(len(two))             # probability of having escaped so far
    refused = np.zeros(two.shape, bool)
    for counts in (two, one, np.broadcast_to(zero, two.shape)):
        c = np.where(refused, 0.0, counts)
        n, d = c.sum(1), (c > 0).sum(1)
        total = np.maximum(n + d, 1.0)
        p += reach[:, None] * c / total[:, None]
        refused |= c > 0
        reach = reach * np.where(n > 0, d / total, 1.0)
    left = np.maximum(256 - refused.sum(1), 1)
    p = np.where(refused, p, (reach / left)[:, None])
    return -np.log2(np.maximum(p, 1e-300))


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text") -> ByteModel:
    """Learn from every row with a text and a language."""
    return ByteModel(learn_counts(labelled, lang, text).toPandas())


_ANSWER = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                        T.StructField("bits_per_byte", T.DoubleType())])


def predict(df: DataFrame, model: ByteModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (share of the best language, all languages
    being equally likely beforehand) and ``bits_per_byte`` (its code length)."""
    spark: SparkSession = df.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_ANSWER)
    def answers(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for arr in col:
            raw, off = utf8(arr)
            n = len(off) - 1
            if m.langs and n:
                bits = m.bits(raw, off)
                best = bits.argmin(1)
                low = bits[np.arange(n), best]
                score = 1.0 / np.exp2(np.maximum(low[:, None] - bits, -1000.0)).sum(1)
                names = pa.array(np.array(m.langs, object)[best], pa.string())
                per = low / np.maximum(np.diff(off), 1)
            else:
                names, score, per = pa.array([UNDETERMINED] * n, pa.string()), np.zeros(n), np.zeros(n)
            yield pa.StructArray.from_arrays([names, pa.array(score), pa.array(per)], fields=list(pa.struct(
                [("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])))

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    got = df.withColumn("_lid", answers(F.col(text)))
    return got.withColumns({
        "lang_pred": F.when(letters, F.col("_lid.lang_pred")).otherwise(UNDETERMINED),
        "score": F.when(letters & (F.col("_lid.lang_pred") != UNDETERMINED), F.col("_lid.score")).otherwise(0.0),
        "bits_per_byte": F.col("_lid.bits_per_byte")}).drop("_lid")


def held_out(doc_id: str = "doc_id"):
    """The rows that are never learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language can be told, with their columns."""
    model = fit(docs.filter(~held_out()))
    names = docs.columns
    return predict(docs.select(*names), model).filter(F.col("lang_pred") != UNDETERMINED).select(*names)
