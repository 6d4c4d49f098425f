"""Sequence packing: first-fit decreasing in randomised groups (operator 6).

A document's ids are those of a public byte-level BPE vocabulary, followed by
one end id. Each document is cut into pieces: whole sequences of ``width``
ids, which need no bin, and one remainder. The remainders are dealt into
randomised groups of about ``group_size`` pieces; each group runs first-fit
decreasing on its own, the leftmost bin with enough room being found in a
tournament tree of bin capacities. A piece row holds no ids, only where they
lie and their checksum, so groups stay small whatever the texts' length.

Tokenising works on whole words: between two characters that are not white
space, a single blank or newline always starts a new token of the vocabulary's
word pattern, so texts are cut there and each distinct word is encoded once
per worker (a bounded memo; other texts go to the tokenizer whole).

Defined results: a null or empty text is the end id alone; repeated rows are
packed once each; an empty table gives no rows; very long texts become many
full pieces. Columns besides the id and the text are not read.
"""

from __future__ import annotations

import array
import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenmill.llm.common import landed, table
from tokenmill.session import ship_code

WIDTH = 1024
END_ID = 0
GROUP_SIZE = 8192
MEMO_WORDS = 300_000   # in each of two generations
MEMO_LENGTH = 48

_SPACES = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<=\S)(?=[ \n]\S)")


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    ``path`` is the tokenizer's file. ``ranks``, if given, is the same
    vocabulary as a list of ranked byte strings, which encodes new words
    several times faster and to the same ids; texts that hold a special
    token's string go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken
            with open(ranks, "rb") as f:
                table_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_of, special_tokens={})
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        if self.fast is not None:
            return array.array("I", self.fast.encode_ordinary(text)).tobytes()
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.memo) > MEMO_WORDS:   # two generations: words still in use come back
            self.older, self.memo = self.memo, {}
        for w in words:
            if len(w) <= MEMO_LENGTH:
                got = self.older.get(w)
                self.memo[w] = self._encode(w) if got is None else got

    def _join(self, words: list[str]) -> bytes:
        memo = self.memo
        try:
            return b"".join([memo[w] for w in words])
        except KeyError:
            self._learn({w for w in words if w not in memo})
            memo, older = self.memo, self.older
            return b"".join([memo.get(w) or older.get(w) or self._encode(w) for w in words])

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _SPACES.search(text) or text[0].isspace() or text[-1].isspace():
            return self._join(_SINGLE.split(text))
        # single white space only: newlines stand alone, blanks lead a word
        words: list[str] = []
        for k, line in enumerate(text.split("\n")):
            first, *rest = line.split(" ")
            if k:
                words.append("\n")
            words.append(first)
            words += [" " + w for w in rest]
        return self._join(words)


_TOKENIZERS: dict[Vocabulary, WordTokenizer] = {}


@dataclass(frozen=True)
class Vocabulary:
    path: str
    ranks: str | None = None
    pattern: str | None = None

    def tokenizer(self) -> WordTokenizer:
        """The worker's tokenizer, with its memo."""
        if self not in _TOKENIZERS:
            _TOKENIZERS[self] = WordTokenizer(self.path, self.ranks, self.pattern)
        return _TOKENIZERS[self]


_PIECES = "array<struct<start:long,length:long,ids_crc32:long,doc_tokens:long>>"


def cut_pieces(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
               end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    ship_code(docs.sparkSession)
    piece = pa.struct([(n, pa.int64()) for n in ("start", "length", "ids_crc32", "doc_tokens")])
    end = np.array([end_id], "<u4").tobytes()

    @F.arrow_udf(_PIECES)
    def pieces(col: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = vocabulary.tokenizer()
        for arr in col:
            rows, size = [[], [], [], []], [0]
            for value in arr:
                ids = t.ids(value.as_py() or "") + end
                n = len(ids) // 4
                for a in range(0, n, width):
                    part = ids[4 * a:4 * (a + width)]
                    rows[0].append(a)
                    rows[1].append(len(part) // 4)
                    rows[2].append(zlib.crc32(part))
                    rows[3].append(n)
                size.append(len(rows[0]))
            flat = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in rows], fields=list(piece))
            yield pa.ListArray.from_arrays(pa.array(size, pa.int32()), flat)

    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(pieces(F.col(text))).alias("p")) \
        .select("doc_id", "p.*")


def first_fit_decreasing(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; the leftmost bin with room takes the next
    longest piece (ties in input order). The tree holds each bin's room; a
    node holds the larger of its children's."""
    n = len(lengths)
    leaves = 1
    while leaves < n:
        leaves *= 2
    room = [width] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[k])
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[k] = at - leaves
        offsets[k] = width - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


_PACKED = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
         end_id: int = END_ID, group_size: int = GROUP_SIZE, seed: int = 0) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; sequences hold at most ``width`` ids."""
    cut = landed(cut_pieces(docs, vocabulary, doc_id, text, width, end_id), "pieces")
    row = F.monotonically_increasing_id()  # the table is written: its rows and their order stay
    rest = cut.filter(F.col("length") < width)
    groups = max(1, -(-rest.count() // group_size))
    id_type = cut.schema["doc_id"].dataType.simpleString()

    def one_group(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row", kind="stable")
        bins, offsets = first_fit_decreasing(part["length"].to_numpy(np.int64), width)
        return part.assign(sequence_id=bins * groups + key[0], offset=offsets).drop(columns=["_row", "_group"])

    packed = rest.withColumn("_row", row) \
        .withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(groups))) \
        .groupBy("_group").applyInPandas(one_group, _PACKED.format(id=id_type))
    # a full piece is a sequence of its own: ids below zero, by its row
    full = cut.filter(F.col("length") == width) \
        .withColumns({"sequence_id": -1 - row, "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)


def _vocabulary() -> Vocabulary:
    import public_tokenizers as public
    return Vocabulary(str(public.path("byte_bpe_50k.json")), str(public.path("byte_bpe_50k.tiktoken")), public.PATTERN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), _vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents as packed pieces (the pipeline's result)."""
    return pack(docs, _vocabulary())
