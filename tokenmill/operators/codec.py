"""Sub-word codec as Spark jobs.

* ``normalise_text`` — NFKC (Arrow-batched Python: no JVM built-in) then
  whitespace rules as built-in expressions.
* ``encode`` — ``mapInArrow`` over the text column with a broadcast
  vocabulary as a trie; the best (Viterbi) segmentations of a batch's distinct
  words are computed together (segmentation never crosses a word start ``▁``).
  No shuffle; the vocabulary is collected only after its size is checked.
* ``decode`` — pure Spark: id → piece through a constant array, joined.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenmill.functions.exprs import SPACE_MARK, UNK_SURFACE, normalise_ws
from tokenmill.session import ship_code

# Upper bound on pieces collected to the driver and broadcast.
MAX_VOCAB_PIECES = 1_000_000
# Penalty (in log-prob) of the unknown piece below the lowest piece score.
UNK_PENALTY = 10.0
# Bytes of text that a Python worker normalises or encodes at a time: its memory does not grow with a batch's text.
STRETCH_BYTES = 2_000_000
# What the trainer's rule reads as a blank, what it removes, and what its NFKC leaves alone.
TRAINER_BLANKS = "\t\n\f\r\u061c\u1680\u200b\u200c\u200e\u200f\u2028\u2029\u2581\ufeff\ufffd"
TRAINER_GONE = "\x01\x02\x03\x04\x05\x06\x07\x08\x0b\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b\x1c\x1d\x1e\x1f\x7f\x8f\x9f"
TRAINER_KEEPS = "\uff5e"
RULES = ("nfkc", "trainer")
_SPECIAL_KINDS = ("unk", "bos", "eos", "pad")


# --------------------------------------------------------------------------
# normalisation
# --------------------------------------------------------------------------

def _nfkc_text(t: str, keeps: str = "") -> str:
    """NFKC of all but the character ``keeps``, which it meets as a border."""
    if keeps and keeps in t:
        return keeps.join(unicodedata.normalize("NFKC", part) for part in t.split(keeps))
    return unicodedata.normalize("NFKC", t)


def nfkc(col, keeps: str = "") -> "F.Column":
    """NFKC through an Arrow UDF, some megabytes of text at a time. ASCII texts,
    which NFKC never changes, reach Python as nulls and are taken over in the JVM."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_code(spark)

    @F.arrow_udf(T.StringType())
    def normal(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([
            pa.array([None if t is None else _nfkc_text(t, keeps) for t in texts.slice(a, n).to_pylist()], pa.string())
            for a, n in _stretches(texts)])

    src = F.col(col) if isinstance(col, str) else col
    return F.coalesce(normal(F.when(src.rlike(r"[^\x00-\x7F]"), src)), src)


def _stretches(texts: pa.Array, limit: int = STRETCH_BYTES) -> list[tuple[int, int]]:
    """``(start, rows)`` of neighbouring texts of about ``limit`` bytes (a longer text is alone)."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
    return [(a, b - a) for a, b in itertools.pairwise([0, *cut.tolist(), len(texts)])]


def normalise_text(df: DataFrame, text: str = "text", out: str = "norm", use_nfkc: bool = True,
                   rule: str = "nfkc") -> DataFrame:
    """NFKC, collapse whitespace, strip, blank → ``▁``, leading ``▁``.

    ``rule="trainer"`` is the vocabulary trainer's default: control characters
    go, zero-width and other special blanks (and ``▁`` itself) are read as blanks, and the
    full-width tilde stays. A null text stays null.
    """
    if rule not in RULES:
        raise ValueError(f"unknown normalisation rule {rule!r}")
    trainer = rule == "trainer"
    src = nfkc(text, TRAINER_KEEPS if trainer else "") if use_nfkc else F.col(text)
    if trainer:
        src = F.translate(src, TRAINER_BLANKS + TRAINER_GONE, " " * len(TRAINER_BLANKS))
    return df.withColumn(out, normalise_ws(src))


# Whitespace class of the JVM-side normaliser (Java ``\s``).
_WS = re.compile(r"[ \t\n\x0b\f\r]+")


# --------------------------------------------------------------------------
# vocabulary model (driver side, bounded)
# --------------------------------------------------------------------------

class CodecModel:
    """Pieces, scores and special ids gathered from a ``vocab`` table."""

    def __init__(self, rows):
        self.pieces: dict[str, tuple[int, float]] = {}
        self.id_to_piece: list[str] = []
        self.kinds: list[str] = []
        self.special: dict[str, int] = {}
        n = len(rows)
        self.id_to_piece = [""] * n
        self.kinds = ["normal"] * n
        scores = []
        for r in rows:
            i, p, s, k = int(r[0]), r[1], float(r[2]), r[3]
            if i < 0 or i >= n:
                raise ValueError(f"vocabulary ids must be 0..{n - 1}; got {i}")
            self.id_to_piece[i] = p
            self.kinds[i] = k
            if k in _SPECIAL_KINDS:
                self.special[k] = i
            else:
                self.pieces[p] = (i, s)
                scores.append(s)
        self.max_len = max((len(p) for p in self.pieces), default=1)
        self.unk_id = self.special.get("unk", 0)
        self.unk_score = (min(scores) if scores else 0.0) - UNK_PENALTY

    @classmethod
    def from_vocab(cls, vocab: DataFrame, max_pieces: int = MAX_VOCAB_PIECES) -> "CodecModel":
        # one job: the bound is checked on the rows themselves
        rows = [tuple(r) for r in vocab.select("id", "piece", "score", "kind").limit(max_pieces + 1).collect()]
        if len(rows) > max_pieces:
            raise ValueError(f"the vocabulary exceeds the broadcast bound of {max_pieces} pieces")
        return cls(rows)

    def payload(self):
        if not hasattr(self, "_token"):
            self._token = uuid.uuid4().hex
        return (self._token, self.pieces, self.max_len, self.unk_id, self.unk_score, self.special)


class PieceTrie:
    """The pieces as a trie in flat arrays: the moves of all states, sorted by
    (state, character). Built by levels, one sort each, without a loop over pieces."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        words = list(pieces)
        codes, off = _code_points(words)
        alphabet = np.unique(codes)
        self.base = len(alphabet) + 1                # the last number: characters of no piece
        self.number = np.full(0x110000, len(alphabet), np.int32)
        self.number[alphabet] = np.arange(len(alphabet))
        sym = self.symbols(codes)
        size = np.diff(off)
        at = np.zeros(len(words), np.int64)          # each piece's state so far
        self.depth = int(size.max(initial=0))
        keys, states = [], 1
        for d in range(self.depth):
            live = np.flatnonzero(size > d)
            key, where = np.unique(at[live] * self.base + sym[off[live] + d], return_inverse=True)
            keys.append(key)
            at[live] = states + where
            states += len(key)
        # states are numbered level by level, in the order of their keys
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.root = np.searchsorted(self.keys, np.arange(self.base))
        self.piece = np.full(states, -1, np.int32)
        self.score = np.zeros(states)
        whole = np.flatnonzero(size > 0)
        self.piece[at[whole]] = [pieces[words[k]][0] for k in whole]
        self.score[at[whole]] = [pieces[words[k]][1] for k in whole]

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        return self.number[codes].astype(np.int64)

    def edges(self, sym: np.ndarray, stop: np.ndarray):
        """All occurrences of pieces: ``(start, end, state)``; one from place
        ``i`` ends at ``stop[i]`` at the latest."""
        found = []
        place = np.arange(len(sym))
        state = np.zeros(len(sym), np.int64)
        for d in range(self.depth):
            ok = place + d < stop[place]
            place, state = place[ok], state[ok]
            key = state * self.base + sym[place + d]
            k = self.root[key] if d == 0 else np.searchsorted(self.keys, key)
            ok = self.keys[np.minimum(k, len(self.keys) - 1)] == key
            place, state = place[ok], k[ok] + 1
            if not len(place):
                break
            full = self.piece[state] >= 0
            found.append((place[full], place[full] + d + 1, state[full]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all words and the words' offsets."""
    off = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=off[1:])
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), off


class _Segmenter:
    """Best segmentations of an Arrow batch's distinct words, computed together."""

    #: Places of short words laid out as arrays at a time, and of one long word.
    _PLACES = 100_000
    #: Bytes of text whose words are looked at together.
    _BYTES = STRETCH_BYTES
    #: Words of as many characters are walked place by place, each on its own.
    _LONG = 64

    def __init__(self, payload, rule: str = "nfkc"):
        self.trainer = rule == "trainer"
        self.token, pieces, _, self.unk_id, self.unk_score, self.special = payload
        self.trie = PieceTrie(pieces)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids one after the other, and their numbers; a word is given without its word start."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(size >= self._LONG).tolist()
        got, a = [(np.zeros(0, np.int32), np.zeros(0, np.int64))], 0
        for b in [*long, len(words)]:
            block = np.append(0, np.cumsum(size[a:b] + 1)) // self._PLACES
            cut = [a, *(a + np.flatnonzero(np.diff(block)) + 1).tolist(), b]
            got += [self._short(words[x:y]) for x, y in itertools.pairwise(cut) if x < y]
            if b < len(words):
                got.append(self._long(SPACE_MARK + words[b]))
            a = b + 1
        return tuple(np.concatenate(x) for x in zip(*got, strict=True))

    def _edges(self, sym: np.ndarray, stop: np.ndarray):
        """``(start, end, score, id)`` of all pieces and of unknown characters (id -1)."""
        start, end, state = self.trie.edges(sym, stop)
        alone = np.ones(len(sym), bool)
        alone[start[end == start + 1]] = False
        lone = np.flatnonzero(alone)
        return (np.concatenate([start, lone]), np.concatenate([end, lone + 1]),
                np.concatenate([self.trie.score[state], np.full(len(lone), self.unk_score)]),
                np.concatenate([self.trie.piece[state], np.full(len(lone), -1, np.int32)]))

    def _short(self, words: list[str]):
        """All words at once: the k-th step settles the k-th place of every word."""
        codes, off = _code_points([SPACE_MARK + w for w in words])
        row = np.repeat(np.arange(len(words)), np.diff(off))
        start, end, score, pid = self._edges(self.trie.symbols(codes), off[1:][row])
        # a word's places and one for its end, so that ends are no other word's start
        word = row[start]
        a, b, layer = start + word, end + word, end - off[word]
        nodes = len(codes) + len(words)
        # by step, end and start: of equal sums the first, with the longer piece, is taken
        order = np.argsort((layer * nodes + b) * (self.trie.depth + 2) - (b - a))
        a, b, score, layer = a[order], b[order], score[order], layer[order]
        best = np.zeros(nodes)
        via = np.zeros(nodes, np.int64)
        cut = np.searchsorted(layer, np.arange(1, int(layer[-1]) + 2))
        for lo, hi in itertools.pairwise(cut.tolist()):
            total = best[a[lo:hi]] + score[lo:hi]
            head = np.append(True, b[lo + 1:hi] != b[lo:hi - 1])
            top = np.maximum.reduceat(total, np.flatnonzero(head))
            group = np.cumsum(head) - 1
            hit = np.flatnonzero(total == top[group])
            hit = hit[np.append(True, group[hit[1:]] != group[hit[:-1]])]
            at = b[lo + hit]
            best[at], via[at] = top, lo + hit
        # back from every word's end at once
        at = off[1:] + np.arange(len(words))
        low = off[:-1] + np.arange(len(words))
        taken = np.zeros(nodes, np.int64)            # the edge taken from a place, plus one
        while len(at):
            e = via[at]
            at = a[e]
            taken[at] = e + 1
            at, low = at[at > low], low[at > low]
        at = np.flatnonzero(taken)
        return self._joined(pid[order[taken[at] - 1]], np.repeat(np.arange(len(words)), np.diff(off) + 1)[at], len(words))

    def _long(self, word: str) -> list[int]:
        """One long word, its pieces found for a stretch of places at a time."""
        n = len(word)
        sym = self.trie.symbols(_code_points([word])[0])
        best, back = [float("-inf")] * (n + 1), [(0, 0)] * (n + 1)
        best[0] = 0.0
        for lo in range(0, n, self._PLACES):
            hi = min(n, lo + self._PLACES)
            part = sym[lo:hi + self.trie.depth]
            cols = self._edges(part, np.full(len(part), len(part)))
            order = np.lexsort((cols[1], cols[0]))
            order = order[cols[0][order] < hi - lo]
            for i, j, s, k in zip(*[c[order].tolist() for c in cols], strict=True):
                total = best[lo + i] + s
                if total > best[lo + j]:
                    best[lo + j], back[lo + j] = total, (lo + i, k)
        ids, j = [], n
        while j > 0:
            j, k = back[j]
            ids.append(k)
        return self._joined(np.array(ids[::-1], np.int32), np.zeros(len(ids), np.int64), 1)

    def _joined(self, ids: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Neighbouring unknown characters of a word form one unknown piece."""
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] >= 0) | (ids[:-1] >= 0) | (word[1:] != word[:-1])
        ids = ids[keep]
        return np.where(ids < 0, self.unk_id, ids).astype(np.int32), np.bincount(word[keep], minlength=n)

    def batch(self, texts: pa.Array, bos: int | None, eos: int | None) -> pa.ListArray:
        """The ids of every text, between the ends asked for."""
        return pa.concat_arrays([ids for _, _, ids in self.parts(texts, bos, eos)])

    def parts(self, texts: pa.Array, bos: int | None, eos: int | None):
        """``(start, rows, ids)`` of stretches of some megabytes of text, one after the other."""
        for a, n in _stretches(texts, self._BYTES):
            yield a, n, self._part(texts.slice(a, n), bos, eos)

    def _part(self, texts: pa.Array, bos: int | None, eos: int | None) -> pa.ListArray:
        norm = _nfkc_array(texts, TRAINER_KEEPS if self.trainer else "")
        if self.trainer:
            norm = pc.replace_substring_regex(norm, f"[{TRAINER_GONE}]", "")
            norm = pc.replace_substring_regex(norm, f"[{TRAINER_BLANKS}]", " ")
        norm = pc.utf8_trim(pc.replace_substring_regex(norm, _WS.pattern, " "), " ")
        norm = pc.if_else(pc.equal(norm, ""), None, pc.replace_substring(norm, SPACE_MARK, " "))
        split = pc.split_pattern(norm, " ")
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False), out=at[1:])
        words = split.flatten().dictionary_encode()
        ids, size = self.words(words.dictionary.to_pylist())
        index = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ends = [(p, i) for p, i in ((at[:-1], bos), (at[1:], eos)) if i is not None]
        if ends:
            # the ends are words too, put in row by row
            number = len(size) + np.arange(len(ends))
            index = np.insert(index, np.stack([p for p, _ in ends], 1).ravel(), np.tile(number, len(texts)))
            at = at + len(ends) * np.arange(len(at))
            ids = np.append(ids, np.array([i for _, i in ends], np.int32))
            size = np.append(size, np.ones(len(ends), np.int64))
        pool = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(ids, pa.int32()))
        flat = pool.take(pa.array(index)).flatten()
        off = np.append(0, np.cumsum(size[index]))[at]
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), flat)


def _nfkc_array(texts: pa.Array, keeps: str = "") -> pa.Array:
    """NFKC of the texts that it may change: those beyond ASCII."""
    plain = pc.string_is_ascii(texts)
    if pc.all(plain).as_py() is not False:
        return texts
    other = [_nfkc_text(t, keeps) for t in texts.filter(pc.invert(plain)).to_pylist()]
    return pc.replace_with_mask(texts, pc.invert(plain), pa.array(other, texts.type))


_WORKER_MODELS: dict[tuple[str, str], _Segmenter] = {}


def _segmenter(bc, token: str, rule: str) -> _Segmenter:
    """One segmenter per vocabulary and rule per Python worker."""
    seg = _WORKER_MODELS.get((token, rule))
    if seg is None:
        _WORKER_MODELS.clear()
        seg = _Segmenter(bc.value, rule)
        _WORKER_MODELS[token, rule] = seg
    return seg


# --------------------------------------------------------------------------
# encode / decode
# --------------------------------------------------------------------------

def encode(df: DataFrame, vocab: DataFrame | CodecModel, text: str = "text", out: str = "ids",
           bos: bool = False, eos: bool = False, drop_text: bool = False,
           partitions: int | None = None, rule: str = "nfkc") -> DataFrame:
    """text → best-segmentation ids, with optional bos / eos ends.

    ``''`` → ``[]`` before the ends are added; a NULL text is an error
    (the input must be a string). Between segmentations of equal score the
    one with the longer last piece wins. ``drop_text`` keeps the text from
    coming back from Python. ``partitions`` deals the rows out first, for
    inputs of fewer splits than cores; there is no shuffle without it.
    ``rule`` is that of ``normalise_text``.
    """
    if rule not in RULES:
        raise ValueError(f"unknown normalisation rule {rule!r}")
    model = vocab if isinstance(vocab, CodecModel) else CodecModel.from_vocab(vocab)
    ship_code(df.sparkSession)
    sc = df.sparkSession.sparkContext
    payload = model.payload()
    token = payload[0]
    bc = sc.broadcast(payload)
    bos_id = model.special.get("bos") if bos else None
    eos_id = model.special.get("eos") if eos else None
    if bos and bos_id is None or eos and eos_id is None:
        raise ValueError("vocabulary has no bos/eos id")
    field = T.StructField(out, T.ArrayType(T.IntegerType(), True), True)
    gone = {out, text} if drop_text else {out}
    schema = T.StructType([f for f in df.schema.fields if f.name not in gone] + [field])

    def run(batches):
        seg = _segmenter(bc, token, rule)
        for b in batches:
            texts = b.column(text)
            if texts.null_count:
                raise TypeError("encode: input text must be a string, got NULL")
            b = b.drop_columns([c for c in b.schema.names if c in gone])
            for a, n, arr in seg.parts(texts, bos_id, eos_id):
                # without a column left, a batch could not be appended to
                yield pa.RecordBatch.from_arrays([*b.slice(a, n).columns, arr], names=[*b.schema.names, out])

    return (df.repartition(partitions) if partitions else df).mapInArrow(run, schema)


def _const_array(values: list[str]):
    """A constant string array folded once by the optimiser (one literal)."""
    sep = "\u0001"
    if any(sep in v for v in values):
        return F.array(*[F.lit(v) for v in values])
    return F.split(F.lit(sep.join(values)), sep, -1)


def decode(df: DataFrame, vocab: DataFrame | CodecModel, ids: str = "ids", out: str = "text") -> DataFrame:
    """ids → text; bos/eos/pad vanish, unk shows `` ⁇ ``, ``▁`` is a
    blank and the first leading blank is stripped. Built-in expressions only.
    """
    model = vocab if isinstance(vocab, CodecModel) else CodecModel.from_vocab(vocab)
    n = len(model.id_to_piece)
    hidden = [model.special[k] for k in ("bos", "eos", "pad") if k in model.special]
    unk = model.special.get("unk", -1)
    surf = [UNK_SURFACE if i == unk else p.replace(SPACE_MARK, " ")
            for i, p in enumerate(model.id_to_piece)]
    table = _const_array(surf)
    kept = F.filter(F.col(ids), lambda i: ~i.isin(hidden) & (i >= 0) & (i < n)) if hidden \
        else F.filter(F.col(ids), lambda i: (i >= 0) & (i < n))
    d = df.withColumn("_k", kept)
    joined = F.array_join(F.transform(F.col("_k"), lambda i: F.element_at(table, i + 1)), "")
    # the first piece's word-start blank is dropped (never the unk surface)
    first_blank = (F.element_at(F.col("_k"), 1) != unk) & F.col("_j").startswith(" ")
    txt = F.when((F.size("_k") > 0) & first_blank, F.expr("substr(_j, 2)")).otherwise(F.col("_j"))
    return d.withColumn("_j", joined).withColumn(out, txt).drop("_k", "_j")


def tokenize_text(df: DataFrame, vocab, text: str = "text", out: str = "Tokenized_Data",
                  length_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """encode ``text`` with both ends, drop ``text``.

    ``length_col`` stores the token count beside the list: once written to
    parquet, length filters on it are pushed down to the row-group statistics.
    """
    res = encode(df, vocab, text=text, out=out, bos=True, eos=True, drop_text=True, partitions=partitions)
    return res.withColumn(length_col, F.size(out).cast("int")) if length_col else res


def tokenize_triples(df: DataFrame, vocab, out: str = "Tokenized_Data") -> DataFrame:
    """assemble the triple, encode it, keep ``id`` + tokens."""
    from tokenmill.operators.columns import assemble_prompt
    d = assemble_prompt(df).select("id", "prompt")
    return encode(d, vocab, text="prompt", out=out, bos=True, eos=True, drop_text=True)
