"""unigram-LM vocabulary training (Kudo 2018) as an iterative Spark job.

The loop runs on the driver; pieces, scores, counts and lattices are tables:

* **Lattice.** Every occurrence of a candidate piece in every word type is an
  edge, found once: each bucket of some thousand words asks for the distinct
  fingerprints of its substrings, as one array per block of fingerprints, and
  a cogroup by block with the pieces answers. A bucket's edges are one row
  (binary columns, each a numpy array) of a bucketed table, so no later pass
  sorts or shuffles them. Words of two
  segments or more are cut into segments of ``SEGMENT`` positions, each with
  the edges that start in it.
* **State.** Pieces are dealt out to blocks by id; a block's live pieces are one
  row of arrays (id, log score, Viterbi count, cost), rewritten by every step.
  The total, ``ψ(Σc)`` of the variational M-step's ``ψ(c) − ψ(Σc)``, and the cut
  of a pruning are numbers that the next reader applies.
* **E-step.** A cogroup by block looks up the scores that each bucket needs and
  sends them as one array per bucket and block; they meet the bucket in a
  cogroup. A vectorised numpy forward–backward over the bucket's words gives
  its expected and Viterbi counts, again as one array per block, which meet
  the block's state. Words of up to ``SHORT`` positions, unless scores are so
  low that a product of them could leave the range of a double, are passed as
  cells: plain sums of products, a run of words at a time. The others are
  passed edge by edge, in logs.
* **Long words.** A segment maps the log-sums of the paths that enter it (at
  its first ``max_piece_len`` positions, as pieces reach over the cut) to those
  that leave it: a small matrix under (log-sum, +), and one under (max, +). A
  word's matrices are composed in both directions, and every segment then runs
  forward–backward on its own between the sums at its two ends.
* **Pruning** needs each piece's best split without itself: the same lattice
  over the pieces, without each piece's own edge. The cut is a distributed
  threshold: a histogram of costs, refined until the k-th is isolated.
* Whenever a quarter of the pieces is left, the lattices are rewritten without the
  dead edges, so passes shrink with the vocabulary.

Pieces with an expected count below 0.5 are dropped; after ``em_iters``
sub-iterations the pieces whose removal costs the least likelihood are pruned
(75 % kept per round, single characters always kept) until 110 % of
``vocab_size`` is reached; the best-scoring pieces then fill the vocabulary
exactly. The driver holds totals and histograms, nothing that grows with the
pieces or the text.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tokenmill.operators.order import sample_lines
from tokenmill.operators.vocab import SPECIALS, layout_vocab, seed_pieces, word_counts
from tokenmill.session import cut_lineage, drop_path, scratch_path, ship_code

_NEG = float("-inf")
#: Positions of a long word's segment; edges of a bucket (one cogroup); bins of a histogram; rows sorted at its end.
SEGMENT = 4096
#: Positions of a word that is read as cells (their lengths fit 8 bits), and words that are read together.
SHORT = 32
_TOGETHER = 16_384
BUCKET_EDGES = 1_000_000
_BINS = 512
_FEW = 200_000


# --------------------------------------------------------------------------
# numeric kernel of one bucket
# --------------------------------------------------------------------------

def _seg_logsumexp(vals: np.ndarray, seg_starts: np.ndarray) -> np.ndarray:
    m = np.maximum.reduceat(vals, seg_starts)
    base = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        s = np.add.reduceat(np.exp(vals - np.repeat(base, np.diff(np.append(seg_starts, len(vals))))), seg_starts)
        out = np.where(np.isfinite(m), m + np.log(s), _NEG)
    return out


class _Plan:
    """Edge orderings for one batch: by (end, dst) for the forward pass and
    by (start desc, src) for the backward pass, with segment boundaries.

    Edges come in the order of their words, so a stable sort by position
    leaves each position's targets in order; positions that fit 16 bits are
    sorted by radix."""

    def __init__(self, key_pos, key_flat, descending=False):
        pos = -key_pos if descending else key_pos
        small = len(pos) and np.abs(pos).max() < 2 ** 15
        self.order = np.argsort(pos.astype(np.int16) if small else pos, kind="stable")
        p = key_pos[self.order]
        f = key_flat[self.order]
        self.flat = f
        change = np.flatnonzero(np.diff(p)) + 1
        self.step_bounds = np.concatenate([[0], change, [len(p)]])
        self.seg = []
        if not len(p):
            return
        for a, b in zip(self.step_bounds[:-1], self.step_bounds[1:]):
            fs = f[a:b]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(fs)) + 1])
            self.seg.append((a, b, starts, fs[starts]))


@dataclass
class _Words:
    """Edges of one bucket, word by word: local piece code, log score, places in one flat array of positions."""
    widx: np.ndarray
    st: np.ndarray
    en: np.ndarray
    code: np.ndarray
    lp: np.ndarray
    size: np.ndarray   # last position of each word
    freq: np.ndarray

    def __post_init__(self):
        self.first = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64)
        self.last = self.first + self.size
        self.cells = int(self.last[-1] + 1) if len(self.size) else 0
        self.src, self.dst = self.first[self.widx] + self.st, self.first[self.widx] + self.en
        self.fwd = _Plan(self.en, self.dst)

    def forward(self, best: bool = False) -> np.ndarray:
        """Log-sum (or, with ``best``, the maximum) of the paths to each position."""
        at = np.full(self.cells, _NEG)
        at[self.first] = 0.0
        join = np.maximum.reduceat if best else _seg_logsumexp
        for a, b, starts, targets in self.fwd.seg:
            sel = self.fwd.order[a:b]
            at[targets] = join(at[self.src[sel]] + self.lp[sel], starts)
        return at

    def backward(self) -> np.ndarray:
        bwd = _Plan(self.st, self.src, descending=True)
        at = np.full(self.cells, _NEG)
        at[self.last] = 0.0
        for a, b, starts, targets in bwd.seg:
            sel = bwd.order[a:b]
            at[targets] = _seg_logsumexp(self.lp[sel] + at[self.dst[sel]], starts)
        return at

    def expected(self, n: int) -> np.ndarray:
        """Expected counts by code."""
        alpha, beta = self.forward(), self.backward()
        z = alpha[self.last][self.widx]
        with np.errstate(invalid="ignore"):
            post = np.exp(alpha[self.src] + self.lp + beta[self.dst] - z) * self.freq[self.widx]
        post[~np.isfinite(z) | ~np.isfinite(post)] = 0.0
        own = self.code >= 0
        return np.bincount(self.code[own], post[own], n)

    def viterbi(self, n: int) -> np.ndarray:
        """Counts by code on the best paths."""
        vit = self.forward(best=True)
        cand = vit[self.src] + self.lp
        best = np.flatnonzero((cand == vit[self.dst]) & np.isfinite(cand))
        back = np.full(self.cells, -1, dtype=np.int64)
        back[self.dst[best[::-1]]] = best[::-1]  # the first best edge per position
        ok = np.isfinite(vit[self.last])
        cur, freq, home = self.last[ok].copy(), self.freq[ok], self.first[ok]
        counts = np.zeros(n + 1)   # the last for edges that are no piece
        while len(cur):
            e = back[cur]
            np.add.at(counts, self.code[e], freq)
            cur = self.src[e]
            more = cur != home
            cur, freq, home = cur[more], freq[more], home[more]
        return counts[:n]


class _Cells:
    """Words of at most ``SHORT`` positions, by ascending size, as cells: one for every word, end and length.

    The cells of one end and length are a run over the words that reach this
    end (the last ones), so a pass takes a whole run at a time. Sums are of
    plain products: ``fits`` tells for which words none can leave the range."""

    @staticmethod
    def fits(size: np.ndarray, value: np.ndarray) -> int:
        """How many of the first words."""
        most = np.abs(value[np.isfinite(value)]).max(initial=1.0)
        return int(np.searchsorted(size, min(SHORT, 650.0 / most), "right"))

    def __init__(self, size: np.ndarray, widx: np.ndarray, st: np.ndarray, en: np.ndarray, code: np.ndarray):
        self.size, self.code = size, code
        self.top = int(size[-1])
        n = en.astype(np.int64) - st
        longest = int(n.max(initial=0))
        self.first = np.searchsorted(size, np.arange(self.top + 2))
        self.reach = len(size) - self.first      # words that reach an end
        kind = en * np.int64(longest + 1) + n
        live = np.bincount(kind, minlength=(self.top + 1) * (longest + 1)).reshape(self.top + 1, longest + 1) > 0
        run = np.where(live, self.reach[:-1, None], 0)
        start = (np.cumsum(run) - run.ravel()).reshape(run.shape)
        self.cells = int(run.sum())
        self.base = start - self.first[:-1, None]
        self.cell = self.base.ravel()[kind] + widx
        # by end: the lengths that occur, longest first, and their runs
        self.runs = [[(int(k), slice(int(start[j, k]), int(start[j, k] + self.reach[j]))) for k in np.flatnonzero(live[j])[::-1]]
                     for j in range(self.top + 1)]

    def unique(self) -> bool:
        """Whether no two pieces are the same substring; edges come in the order of their words, starts and lengths."""
        return not (self.cell[1:] == self.cell[:-1]).any()

    def at_end(self, rows: list[np.ndarray]) -> np.ndarray:
        """The value at each word's last position."""
        return np.concatenate([rows[j][:self.first[j + 1] - self.first[j]] for j in range(self.top + 1)])

    def expected(self, value: np.ndarray, freq: np.ndarray, n: int) -> np.ndarray:
        p = np.zeros(self.cells)
        p[self.cell] = np.exp(value)[self.code]
        alpha = [np.ones(len(self.size))]
        for j in range(1, self.top + 1):
            m = self.reach[j]
            at = np.zeros(m)
            for k, run in self.runs[j]:
                at += alpha[j - k][-m:] * p[run]
            alpha.append(at)
        z = self.at_end(alpha)
        weight = np.divide(freq, z, out=np.zeros(len(z)), where=z > 0)
        beta = []
        for j in range(self.top + 1):
            at = np.zeros(self.reach[j])
            ends = self.first[j + 1] - self.first[j]
            at[:ends] = weight[self.first[j]:self.first[j + 1]]
            beta.append(at)
        for j in range(self.top, 0, -1):   # all that leaves j has come by then
            m = self.reach[j]
            for k, run in self.runs[j]:
                out = p[run] * beta[j]
                beta[j - k][-m:] += out
                p[run] = out * alpha[j - k][-m:]
        return np.bincount(self.code, p[self.cell], n)

    def best(self, value: np.ndarray, back: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Best log score of each word; with ``back``, also the length of the last piece of the best path to each position
        (the longest of several)."""
        lp = np.full(self.cells, _NEG)
        lp[self.cell] = value[self.code]
        rows, last = [np.zeros(len(self.size))], [np.zeros(len(self.size), np.int8)]
        for j in range(1, self.top + 1):
            m = self.reach[j]
            at, by = np.full(m, _NEG), np.zeros(m if back else 0, np.int8)
            for k, run in self.runs[j]:
                path = rows[j - k][-m:] + lp[run]
                if back:
                    np.copyto(by, np.int8(k), where=path > at)
                np.maximum(at, path, out=at)
            rows.append(at)
            last.append(by)
        return self.at_end(rows), last

    def viterbi(self, value: np.ndarray, freq: np.ndarray, n: int) -> np.ndarray:
        z, last = self.best(value, back=True)
        code = np.zeros(self.cells, np.int64)
        code[self.cell] = self.code
        start = np.cumsum(self.reach[:-1]) - self.reach[:-1] - self.first[:-1]
        last = np.concatenate(last)
        word = np.flatnonzero(np.isfinite(z) & (self.size > 0))
        at, used, times = self.size[word].astype(np.int64), [code[:0]], [freq[:0]]
        while len(word):
            k = last[start[at] + word].astype(np.int64)
            used.append(code[self.base[at, k] + word])
            times.append(freq[word])
            at -= k
            word, at = word[at > 0], at[at > 0]
        return np.bincount(np.concatenate(used), np.concatenate(times), n)


#: An edge's start and length in one integer.
_LENGTH_BITS = 10
_ARRAYS = {"st": np.int16, "en": np.int16, "code": np.int32, "pids": np.int64, "wid": np.int64, "seg": np.int32,
           "size": np.int32, "freq": np.int64, "n": np.int32}
_PACKED = "bucket long, " + ", ".join(f"{c} binary" for c in _ARRAYS)
_PACKED_TYPE = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in _ARRAYS)])


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _packed(bucket: int, **arrays: np.ndarray) -> pa.Table:
    return pa.table([pa.array([bucket], pa.int64()), *(pa.array([arrays[c].astype(t).tobytes()], pa.binary()) for c, t in _ARRAYS.items())],
                    schema=_PACKED_TYPE)


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted; some times faster than ``np.unique``, which hashes."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _by_block(pids: np.ndarray, blocks: int) -> np.ndarray:
    """Distinct piece ids by block, then id: the order of a bucket's pieces."""
    pids = _distinct(pids)
    return pids[np.argsort(pids % blocks, kind="stable")]


def _codes(pids: np.ndarray, pid: np.ndarray) -> np.ndarray:
    """The place of each ``pid`` in ``pids``."""
    order = np.argsort(pids, kind="stable")
    return order[np.searchsorted(pids[order], pid)]


def _slices(block: np.ndarray) -> list[tuple[int, int]]:
    """Ends of the runs of equal blocks."""
    ends = np.flatnonzero(np.diff(block, append=-1)) + 1
    return list(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if len(block) else []


_MIX, _STEP, _LEN = (np.array([x], np.uint64) for x in (0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _LEN
    return x ^ (x >> np.uint64(31))


def _prints(texts: list[str], starts: np.ndarray, longest: np.ndarray, max_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints of the substrings of 1 to ``longest`` characters at the first ``starts`` positions of each text; also
    the text's number, and start and length in one integer."""
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    chars = _mixed(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64) + _STEP)
    word = np.repeat(np.arange(len(texts)), starts)
    st = np.arange(len(word)) - np.repeat(np.cumsum(starts) - starts, starts)
    pos = (np.cumsum(length) - length)[word] + st
    room = np.minimum(np.minimum(length[word] - st, longest[word]), max_len)
    h = np.zeros(len(pos), np.uint64)
    out = [(h[:0], word[:0], st[:0])]
    for n in range(1, max_len + 1):
        live = room >= n
        if not live.any():
            break
        word, st, pos, room = word[live], st[live], pos[live], room[live]
        h = h[live] * _STEP + chars[pos + n - 1]
        out.append((_mixed(h + np.uint64(n) * _LEN), word, st << _LENGTH_BITS | n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _print_block(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a fingerprint: equal ranges, so sorted fingerprints lie block by block."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _word_prints(words: pa.Table, max_len: int, proper: bool):
    size, full = _columns(words, "size", "full")
    return _prints(words.column("text").to_pylist(), size.astype(np.int64), (full - 1 if proper else full).astype(np.int64), max_len)


def _ask_fn(max_len: int, proper: bool, blocks: int):
    """The distinct fingerprints in one bucket, a row per block."""
    def run(words: pa.Table) -> pa.Table:
        h = _distinct(_word_prints(words, max_len, proper)[0])
        block = _print_block(h, blocks)
        runs = _slices(block)
        return pa.table({"bucket": pa.array(np.full(len(runs), words.column("bucket")[0].as_py(), np.int64)),
                         "block": pa.array([block[a] for a, _ in runs], pa.int64()),
                         "h": pa.array([h[a:b].tobytes() for a, b in runs], pa.binary())})
    return run


def _piece_prints_fn(max_len: int, blocks: int):
    def run(batches):
        for b in batches:
            text, pid = b.column("piece").to_pylist(), b.column("pid").to_numpy()
            ok = np.array([0 < len(t) <= max_len for t in text], bool)
            text, pid = [t for t in text if 0 < len(t) <= max_len], pid[ok]
            length = np.fromiter(map(len, text), np.int64, len(text))
            h, word, at = _prints(text, np.ones(len(text), np.int64), length, max_len)
            whole = at == length[word]   # from position 0
            h, pid = h[whole], pid[word[whole]]
            yield pa.RecordBatch.from_arrays([pa.array(_print_block(h, blocks)), pa.array(h.view(np.int64)), pa.array(pid, pa.int64())],
                                             names=["block", "h", "pid"])
    return run


def _matches(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places with ``keys[i] == h[j]``; ``h`` is sorted."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))   # of each run of equals
    at = np.minimum(np.searchsorted(h[first], keys), len(first) - 1)
    n = np.where(h[first[at]] == keys, np.diff(first, append=len(h))[at], 0)
    i = np.repeat(np.arange(len(keys)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + first[at][i]


def _in_order(word: np.ndarray, at: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All three by ``word``, ``at`` and ``j``: sorted as one integer if they fit."""
    a, b = (int(x.max(initial=0)).bit_length() for x in (at, j))
    if int(word.max(initial=0)).bit_length() + a + b > 63:
        order = np.lexsort((j, at, word))
        return word[order], at[order], j[order]
    key = np.sort((word << a | at) << b | j)
    return key >> (a + b), key >> b & ((1 << a) - 1), key & ((1 << b) - 1)


def _answer(asked: pa.Table, pieces: pa.Table) -> pa.Table:
    """Of one block: the pieces that each bucket asked for."""
    h, pid = _columns(pieces, "h", "pid")
    h = h.view(np.uint64)
    order = np.argsort(h, kind="stable")
    h, pid = h[order], pid[order]
    rows = {"bucket": [], "h": [], "pids": []}
    for bucket, keys in zip(asked.column("bucket").to_pylist(), asked.column("h").to_pylist(), strict=True):
        _, j = _matches(np.frombuffer(keys, np.uint64), h)
        if len(j):
            for c, x in (("bucket", bucket), ("h", h[j].tobytes()), ("pids", pid[j].tobytes())):
                rows[c].append(x)
    return pa.table({"bucket": pa.array(rows["bucket"], pa.int64()), "h": pa.array(rows["h"], pa.binary()),
                     "pids": pa.array(rows["pids"], pa.binary())})


def _joined(t: pa.Table, column: str, dtype) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype), *(np.frombuffer(x, dtype) for x in t.column(column).to_pylist())])


def _pack_fn(max_len: int, proper: bool, blocks: int):
    """One bucket's edges as one row; words of like length lie together, as passes go position by position."""
    def run(words: pa.Table, found: pa.Table) -> pa.Table:
        if not len(words) or not len(found):
            return _PACKED_TYPE.empty_table()
        wid, seg, size = _columns(words, "wid", "seg", "size")
        words = words.take(np.lexsort((seg, wid, size)))
        wid, seg, size, freq = _columns(words, "wid", "seg", "size", "freq")
        h, own = _joined(found, "h", np.uint64), _joined(found, "pids", np.int64)
        keys, word, at = _word_prints(words, max_len, proper)
        sort = np.argsort(keys)
        j, i = _matches(h, keys[sort])   # fewer look up more
        i = sort[i]
        word, at, j = _in_order(word[i], at[i], j)   # by word, start and length
        n = np.bincount(word, minlength=len(wid))
        used = n > 0
        # a piece's own row goes with it
        pids = _by_block(np.concatenate([own, wid[used]]) if proper else own, blocks)
        st = at >> _LENGTH_BITS
        return _packed(words.column("bucket")[0].as_py(), st=st, en=st + (at & ((1 << _LENGTH_BITS) - 1)), code=_codes(pids, own)[j], pids=pids,
                       wid=wid[used], seg=seg[used], size=size[used], freq=freq[used], n=n[used])
    return run


def _values(scores: pa.Table) -> np.ndarray:
    """The scores of a bucket's pieces, in their order; -inf for dead ones."""
    return _joined(scores.take(np.argsort(scores.column("block").to_numpy(), kind="stable")), "logp", np.float64)


def _bucket(row: pa.Table, scores: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The arrays of a bucket and the scores of its pieces."""
    return {c: np.frombuffer(row.column(c)[0].as_py(), t) for c, t in _ARRAYS.items()}, _values(scores)


def _edges(a: dict[str, np.ndarray], value: np.ndarray, start: int = 0) -> _Words:
    """The words from number ``start`` on with their live edges."""
    n = a["n"][start:]
    code = a["code"][len(a["code"]) - n.sum():].astype(np.int64)
    lp, widx = value[code], np.repeat(np.arange(len(n)), n)
    live = slice(None) if (value > _NEG).all() else lp > _NEG   # no path takes a dead edge
    st, en = (a[c][len(a[c]) - len(code):].astype(np.int64)[live] for c in ("st", "en"))
    return _Words(widx[live], st, en, code[live], lp[live], a["size"][start:].astype(np.int64), a["freq"][start:].astype(np.float64))


def _words_of(row: pa.Table, scores: pa.Table) -> tuple[np.ndarray, _Words, np.ndarray]:
    """Piece ids by local code, the words with their live edges, and the (wid, seg) of each."""
    a, value = _bucket(row, scores)
    return a["pids"], _edges(a, value), np.stack([a["wid"], a["seg"]])


def _short_words(a: dict[str, np.ndarray], value: np.ndarray):
    """A bucket's first words as cells, some thousand at a time: ``(start, end, cells)``. The rest are to be read as edges."""
    upto = np.concatenate([[0], np.cumsum(a["n"])])
    fit = _Cells.fits(a["size"], value)
    for x in range(0, fit, _TOGETHER):
        y = min(x + _TOGETHER, fit)
        own = slice(upto[x], upto[y])
        cells = _Cells(a["size"][x:y], np.repeat(np.arange(y - x), a["n"][x:y]), a["st"][own], a["en"][own], a["code"][own])
        if not cells.unique():
            return
        yield x, y, cells


def _compact_fn(piece_rows: bool):
    def run(row: pa.Table, scores: pa.Table) -> pa.Table:
        if not len(row):
            return _PACKED_TYPE.empty_table()
        a, value = _bucket(row, scores)
        pieces = value > _NEG
        words = pieces[_codes(a["pids"], a["wid"])] if piece_rows else np.ones(len(a["wid"]), bool)
        widx = np.repeat(np.arange(len(a["n"])), a["n"])
        keep = pieces[a["code"]] & words[widx]
        n = np.bincount(widx[keep], minlength=len(a["n"]))
        words = n > 0
        if not keep.any():
            return _PACKED_TYPE.empty_table()
        used = np.zeros(len(pieces), bool)
        used[a["code"][keep]] = True
        if piece_rows:
            used[_codes(a["pids"], a["wid"][words])] = True
        place = np.cumsum(used) - 1
        return _packed(row.column("bucket")[0].as_py(), st=a["st"][keep], en=a["en"][keep], code=place[a["code"][keep]], pids=a["pids"][used], n=n[words],
                       **{c: a[c][words] for c in ("wid", "seg", "size", "freq")})
    return run


_COUNTS = "block long, pids binary, expected binary, vfreq binary"


def _by_runs(pid: np.ndarray, blocks: int, **values: np.ndarray) -> pa.Table:
    """A row per block; ``pid`` lies block by block."""
    block = pid % blocks
    runs = _slices(block)
    return pa.table({"block": pa.array([block[a] for a, _ in runs], pa.int64()),
                     **{c: pa.array([x[a:b].tobytes() for a, b in runs], pa.binary()) for c, x in {"pids": pid, **values}.items()}})


def _counted(pid: np.ndarray, expected: np.ndarray, vfreq: np.ndarray, blocks: int) -> pa.Table:
    """A bucket's counts, a row per block; ``pid`` lies block by block."""
    use = (expected != 0) | (vfreq != 0)
    return _by_runs(pid[use].astype(np.int64), blocks, expected=expected[use], vfreq=vfreq[use])


def _summed(counts: pa.Table) -> pa.Table:
    """The counts of one block's pieces over all buckets."""
    pid, at = np.unique(_joined(counts, "pids", np.int64), return_inverse=True)
    return pa.table({"pid": pid, **{c: np.bincount(at, _joined(counts, c, np.float64), len(pid)) for c in ("expected", "vfreq")}})


def _counts_fn(viterbi: bool, blocks: int):
    def run(row: pa.Table, scores: pa.Table) -> pa.Table:
        if not len(row):
            return _counted(*np.zeros((3, 0)), blocks)
        a, value = _bucket(row, scores)
        n, freq, rest = len(value), a["freq"].astype(np.float64), 0
        expected, vfreq = np.zeros(n), np.zeros(n)
        for x, rest, cells in _short_words(a, value):
            expected += cells.expected(value, freq[x:rest], n)
            if viterbi:
                vfreq += cells.viterbi(value, freq[x:rest], n)
        if rest < len(freq):
            w = _edges(a, value, rest)
            expected += w.expected(n)
            if viterbi:
                vfreq += w.viterbi(n)
        return _counted(a["pids"], expected, vfreq, blocks)
    return run


def _best_fn(blocks: int):
    """Best log score of every word (here: of every piece without itself)."""
    def run(row: pa.Table, scores: pa.Table) -> pa.Table:
        if not len(row):
            return _by_runs(np.zeros(0, np.int64), blocks, alt=np.zeros(0))
        a, value = _bucket(row, scores)
        rest, best = 0, [np.zeros(0)]
        for _, rest, cells in _short_words(a, value):
            best.append(cells.best(value)[0])
        if rest < len(a["size"]):
            w = _edges(a, value, rest)
            best.append(w.forward(best=True)[w.last])
        order = np.argsort(a["wid"] % blocks, kind="stable")
        return _by_runs(a["wid"][order], blocks, alt=np.concatenate(best)[order])
    return run


# --------------------------------------------------------------------------
# long words: segments between boundary sums
# --------------------------------------------------------------------------

def _framed(w: _Words, enter: np.ndarray, leave: np.ndarray) -> _Words:
    """The segments of ``w`` with a node before and one behind: edges of no piece (code -1) enter position ``j`` with
    score ``enter[:, j]`` and leave ``j`` positions behind the segment's size with ``leave[:, j]``."""
    n, k = enter.shape
    word = np.repeat(np.arange(n), k)
    j = np.tile(np.arange(k), n)
    end = w.size + k + 1
    widx = np.concatenate([w.widx, word, word])
    st = np.concatenate([w.st + 1, np.zeros(n * k, np.int64), w.size[word] + j + 1])
    en = np.concatenate([w.en + 1, j + 1, end[word]])
    code = np.concatenate([w.code, np.full(2 * n * k, -1, np.int64)])
    lp = np.concatenate([w.lp, enter.ravel(), leave.ravel()])
    keep = np.isfinite(lp)
    order = np.argsort(widx[keep], kind="stable")
    return _Words(*(x[keep][order] for x in (widx, st, en, code, lp)), end, w.freq)


def _matrices_fn(k: int):
    """Per segment: the (log-sum, +) and (max, +) matrices from entry to exit offsets."""
    def run(row: pa.Table, scores: pa.Table) -> pa.Table:
        _, w, name = _words_of(row, scores)
        rows = {"wid": [], "seg": [], "sums": [], "best": []}
        for s in range(len(w.size)):
            own = w.widx == s
            m = own.sum()
            # one copy of the segment for each entry
            copies = _Words(np.repeat(np.arange(k), m), *(np.tile(x[own], k) for x in (w.st, w.en, w.code, w.lp)),
                            np.repeat(w.size[s:s + 1], k), np.repeat(w.freq[s:s + 1], k))
            f = _framed(copies, np.where(np.eye(k, dtype=bool), 0.0, _NEG), np.zeros((k, k)))
            out = (f.first + 1 + w.size[s])[:, None] + np.arange(k)
            rows["wid"].append(name[0, s])
            rows["seg"].append(name[1, s])
            rows["sums"].append(f.forward()[out].ravel())
            rows["best"].append(f.forward(best=True)[out].ravel())
        lists = pa.list_(pa.float64())
        return pa.table({"wid": pa.array(rows["wid"], pa.int64()), "seg": pa.array(rows["seg"], pa.int32()),
                         "sums": pa.array(rows["sums"], lists), "best": pa.array(rows["best"], lists)})
    return run


_ENDS = "wid long, seg int, enter array<double>, leave array<double>, best_in int, best_out int"


def _compose_fn(k: int):
    """Sums at both ends of every segment of one word, and where its best path crosses them."""
    def plus(a, axis):
        with np.errstate(divide="ignore"):
            return np.logaddexp.reduce(a, axis=axis)

    def run(word: pd.DataFrame) -> pd.DataFrame:
        word = word.sort_values("seg")
        sums = [np.reshape(m, (k, k)) for m in word["sums"]]
        best = [np.reshape(m, (k, k)) for m in word["best"]]
        start = np.where(np.arange(k) == 0, 0.0, _NEG)
        enter, reach = [start], [start]
        for a, b in zip(sums, best, strict=True):
            enter.append(plus(enter[-1][:, None] + a, 0))
            reach.append((reach[-1][:, None] + b).max(0))
        leave, cross = [start], [0]
        for a, b, r in zip(sums[::-1], best[::-1], reach[-2::-1], strict=True):
            leave.append(plus(a + leave[-1][None, :], 1))
            cross.append(int((r + b[:, cross[-1]]).argmax()))
        leave, cross = leave[::-1], cross[::-1]
        if not np.isfinite(reach[-1][0]):   # no path through the whole word
            cross = [-1] * len(cross)
        return pd.DataFrame({"wid": word["wid"], "seg": word["seg"], "enter": [x.tolist() for x in enter[:-1]],
                             "leave": [x.tolist() for x in leave[1:]], "best_in": cross[:-1], "best_out": cross[1:]})
    return run


def _long_counts_fn(k: int, viterbi: bool, blocks: int):
    def run(edges: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.column("wid").is_null().to_numpy()
        scores, ends = right.filter(pa.array(kind)), right.filter(pa.array(~kind))
        pid, w, name = _words_of(edges, scores)
        at = {key: i for i, key in enumerate(zip(*(c.tolist() for c in _columns(ends, "wid", "seg")), strict=True))}
        row = [at[int(a), int(b)] for a, b in name.T]
        enter, leave = (np.array(ends.column(c).to_pylist(), np.float64)[row] for c in ("enter", "leave"))
        expected = _framed(w, enter, leave).expected(len(pid))
        if not viterbi:
            return _counted(pid, expected, np.zeros(len(pid)), blocks)
        one = np.arange(k)[None, :]
        gate = [np.where(one == ends.column(c).to_numpy()[row][:, None], 0.0, _NEG) for c in ("best_in", "best_out")]
        return _counted(pid, expected, _framed(w, *gate).viterbi(len(pid)), blocks)
    return run


# --------------------------------------------------------------------------
# lattice tables
# --------------------------------------------------------------------------

@dataclass
class Part:
    """Packed rows as a table bucketed by ``bucket``; the pieces of each bucket, packed by block, as one bucketed by ``block``."""
    rows: DataFrame
    used: DataFrame
    names: list[str]
    paths: list[str]
    blocks: int

    def drop(self) -> None:
        for n in self.names:
            self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {n}")
        for p in self.paths:
            drop_path(self.rows.sparkSession, p)


@dataclass
class Lattice:
    """Words in one segment, and the segments of longer words (None if there are none)."""
    whole: Part
    cut: Part | None
    max_piece_len: int
    tasks: int
    proper: bool

    def drop(self) -> None:
        for p in filter(None, (self.whole, self.cut)):
            p.drop()


def _bucketed(rows: DataFrame, n: int, key: str, name: str) -> tuple[str, str]:
    """A table's name and path."""
    name, path = f"{name}_{uuid.uuid4().hex[:12]}", scratch_path(rows.sparkSession, name)
    rows.write.bucketBy(n, key).option("path", path).saveAsTable(name)
    return name, path


def _written(rows: DataFrame, tasks: int, blocks: int) -> Part:
    """``rows`` come by bucket, so a task writes few files."""
    spark = rows.sparkSession
    name, path = _bucketed(rows, tasks, "bucket", "lattice")

    def pieces(batches):
        for b in batches:
            for bucket, pids in zip(b.column("bucket").to_pylist(), b.column("pids").to_pylist(), strict=True):
                runs = _by_runs(np.frombuffer(pids, np.int64), blocks)
                runs = runs.add_column(0, "bucket", pa.array(np.full(len(runs), bucket, np.int64)))
                yield from runs.to_batches()

    used, used_path = _bucketed(spark.table(name).select("bucket", "pids").mapInArrow(pieces, "bucket long, block long, pids binary")
                                .repartition(blocks, "block"), blocks, "block", "used")
    return Part(spark.table(name), spark.table(used), [name, used], [path, used_path], blocks)


def build_lattice(words: DataFrame, pieces: DataFrame, max_piece_len: int = 16, segment: int = SEGMENT,
                  bucket_edges: int = BUCKET_EDGES, proper: bool = False, blocks: int | None = None) -> Lattice:
    """Every occurrence of a piece (``pid, piece``) in every word (``wid, word, freq``), written once.

    ``proper`` leaves out a word's edge over its whole length (a piece is not
    its own alternative). Segments hold at least ``segment`` positions, which
    must not be less than ``max_piece_len``. ``blocks`` of pieces meet the
    buckets (by default as many as there are tasks).
    """
    if max_piece_len >= 1 << _LENGTH_BITS:
        raise ValueError(f"pieces of at most {(1 << _LENGTH_BITS) - 1} characters")
    spark = words.sparkSession
    ship_code(spark)
    segment = max(min(segment, 15_000), max_piece_len)   # positions are kept in 16 bits
    length = F.length("word")
    rows, positions, longest = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0)),
                                         F.coalesce(F.max(length), F.lit(0))).first()
    # of the max_piece_len substrings at a position, about a third are pieces
    cores = spark.sparkContext.defaultParallelism
    buckets = max(4 * cores, -(-int(positions) * max_piece_len // (3 * bucket_edges)))
    # more than cores, as a hash deals buckets out unevenly; for small buckets a task's fixed cost tells more
    tasks = max(4 * cores, -(-buckets // 8)) if buckets > 4 * cores else cores
    blocks = blocks or tasks
    n_segs = F.greatest(F.lit(1), (length / segment).cast("int"))
    parts = words.select("wid", "freq", "word", n_segs.alias("n_segs"),
                         F.explode(F.sequence(F.lit(0), n_segs - 1)).alias("seg"))
    begin = F.col("seg") * segment
    parts = parts.select("wid", "freq", "n_segs", "seg", length.alias("full"),
                         F.when(F.col("seg") == F.col("n_segs") - 1, length - begin).otherwise(F.lit(segment)).alias("size"),
                         F.substring("word", begin + 1, F.lit(2 * segment + max_piece_len)).alias("text"))
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("wid", "seg"), F.lit(buckets)))
    named = pieces.select("pid", "piece").filter("piece is not null") \
        .mapInArrow(_piece_prints_fn(max_piece_len, blocks), "block long, h long, pid long")
    has_long = longest >= 2 * segment

    def pack(which: str) -> Part:
        own = parts.filter(which).drop("n_segs").repartition(tasks, "bucket").groupBy("bucket")
        asked = own.applyInArrow(_ask_fn(max_piece_len, proper, blocks), "bucket long, block long, h binary")
        found = asked.groupBy("block").cogroup(named.groupBy("block")).applyInArrow(_answer, "bucket long, h binary, pids binary")
        return _written(own.cogroup(found.groupBy("bucket")).applyInArrow(_pack_fn(max_piece_len, proper, blocks), _PACKED), tasks, blocks)

    return Lattice(pack("n_segs = 1"), pack("n_segs > 1") if has_long else None, max_piece_len, tasks, proper)


def compact_lattice(lattice: Lattice, state: Pieces) -> Lattice:
    """The lattice without the edges of removed pieces (and, of pieces, without removed pieces' own rows)."""
    parts = [p and _written(_meet(p, state, _compact_fn(lattice.proper), _PACKED), lattice.tasks, p.blocks)
             for p in (lattice.whole, lattice.cut)]
    lattice.drop()
    return Lattice(*parts, lattice.max_piece_len, lattice.tasks, lattice.proper)


def _lookup_fn(read):
    """Of one block: the scores of the pieces that each bucket uses, -inf for dead ones. ``read`` gives their ids and scores."""
    def run(used: pa.Table, scores: pa.Table) -> pa.Table:
        pid, logp = read(scores)
        order = np.argsort(pid, kind="stable")
        pid, logp = np.append(pid[order], 0), np.append(logp[order], _NEG)   # the last for ids behind all others
        values = []
        for ids in used.column("pids").to_pylist():
            ids = np.frombuffer(ids, np.int64)
            at = np.searchsorted(pid[:-1], ids)
            values.append(np.where(pid[at] == ids, logp[at], _NEG).astype(np.float64).tobytes())
        return pa.table({"bucket": used.column("bucket"), "block": used.column("block"), "logp": pa.array(values, pa.binary())})
    return run


def _meet(part: Part, scores: DataFrame | Pieces, fn, schema: str, more: DataFrame | None = None) -> DataFrame:
    """Each bucket with the scores of its pieces; the lattice is bucketed, so only scores move, as arrays."""
    if isinstance(scores, Pieces):
        rows, read = scores.rows, scores.reader()
    else:
        rows, read = scores.select("pid", "logp", _block(part.blocks)), lambda t: _columns(t, "pid", "logp")
    need = part.used.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(_lookup_fn(read), "bucket long, block long, logp binary")
    if more is not None:
        need = need.unionByName(more, allowMissingColumns=True)
    return part.rows.groupBy("bucket").cogroup(need.groupBy("bucket")).applyInArrow(fn, schema)


def _segment_names(batches):
    for b in batches:
        for bucket, wid, seg in zip(*(b.column(c).to_pylist() for c in ("bucket", "wid", "seg")), strict=True):
            wid, seg = np.frombuffer(wid, np.int64), np.frombuffer(seg, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(wid), bucket)), pa.array(wid), pa.array(seg)],
                                             names=["bucket", "wid", "seg"])


def _block_counts(lattice: Lattice, scores: DataFrame | Pieces, viterbi: bool) -> DataFrame:
    """The E-step's counts, a row per bucket and block."""
    k = lattice.max_piece_len
    counts = _meet(lattice.whole, scores, _counts_fn(viterbi, lattice.whole.blocks), _COUNTS)
    if lattice.cut:
        matrices = _meet(lattice.cut, scores, _matrices_fn(k), "wid long, seg int, sums array<double>, best array<double>")
        ends = _stored(matrices.groupBy("wid").applyInPandas(_compose_fn(k), _ENDS), "ends")
        names = lattice.cut.rows.select("bucket", "wid", "seg").mapInArrow(_segment_names, "bucket long, wid long, seg int")
        counts = counts.unionByName(_meet(lattice.cut, scores, _long_counts_fn(k, viterbi, lattice.cut.blocks), _COUNTS,
                                          ends.join(names, ["wid", "seg"])))
    return counts


def expected_counts(lattice: Lattice, scores: DataFrame, viterbi: bool = False) -> DataFrame:
    """E-step: ``pid, expected, vfreq`` under ``scores(pid, logp)``."""
    return _block_counts(lattice, scores, viterbi).groupBy("block").applyInArrow(_summed, "pid long, expected double, vfreq double")


# --------------------------------------------------------------------------
# piece table
# --------------------------------------------------------------------------

def digamma(x, log=F.log):
    """ψ(x) for x > 0 (a column; or, with their ``log``, an array or number): the recurrence up to x + 6, then the asymptotic series."""
    y = x + 6
    f = 1.0 / (y * y)
    series = log(y) - 0.5 / y - f * (1.0 / 12 - f * (1.0 / 120 - f * (1.0 / 252 - f * (1.0 / 240 - f * (1.0 / 132)))))
    for k in range(6):
        series = series - 1.0 / (x + k)
    return series


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Pieces of one block, by id; each binary column is a numpy array.
_STATE = {"pid": np.int64, "is_char": np.bool_, "vfreq": np.float64, "logp": np.float64, "cost": np.float64}
_STATE_TYPE = "block long, " + ", ".join(f"{c} binary" for c in _STATE) + ", n long, total double"


def _block(blocks: int) -> Column:
    return F.pmod(F.col("pid").cast("long"), F.lit(blocks).cast("long")).alias("block")


def _state_row(block: int, total: float = 0.0, **arrays: np.ndarray) -> pa.Table:
    n = len(arrays["pid"])
    return pa.table({"block": pa.array([block], pa.int64()),
                     **{c: pa.array([arrays.get(c, np.zeros(n)).astype(t).tobytes()], pa.binary()) for c, t in _STATE.items()},
                     "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.float64())})


def _state_fn(block: pa.Table) -> pa.Table:
    """A block of the first state."""
    block = block.sort_by("pid")
    pid, is_char, logp = (block.column(c).to_numpy() for c in ("pid", "is_char", "logp"))
    return _state_row(block.column("block")[0].as_py(), pid=pid, is_char=is_char, logp=logp)


@dataclass
class Pieces:
    """The live pieces: a row per block, whose log scores are ``logp - shift``. With a ``cut``, of the pieces that are no
    characters only those of a higher cost, or of the same and up to this id, live."""
    rows: DataFrame
    shift: float = 0.0
    cut: tuple[float, int] | None = None

    def arrays(self):
        """Reads a block: its live pieces' arrays."""
        shift, cut = self.shift, self.cut

        def read(t: pa.Table) -> dict[str, np.ndarray]:
            a = {c: _joined(t, c, dtype) for c, dtype in _STATE.items()}
            if cut is not None:
                live = a["is_char"] | (a["cost"] > cut[0]) | ((a["cost"] == cut[0]) & (a["pid"] <= cut[1]))
                a = {c: x[live] for c, x in a.items()}
            return a | {"logp": a["logp"] - shift}
        return read

    def reader(self):
        """Reads a block: ids and log scores."""
        read = self.arrays()

        def scores(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
            a = read(t)
            return a["pid"], a["logp"]
        return scores

    def table(self) -> DataFrame:
        """A row per piece: ``pid, is_char, logp``."""
        read = self.arrays()

        def rows(batches):
            for b in batches:
                a = read(pa.Table.from_batches([b]))
                yield pa.RecordBatch.from_arrays([pa.array(a[c]) for c in ("pid", "is_char", "logp")], names=["pid", "is_char", "logp"])
        return self.rows.mapInArrow(rows, "pid long, is_char boolean, logp double")


def _m_step_fn(read):
    """Of one block: the counts of all buckets make the next state; ``logp`` lacks the total's share."""
    def run(state: pa.Table, counts: pa.Table) -> pa.Table:
        a = read(state)
        if not len(a["pid"]):
            return _state_row(0, pid=a["pid"]).slice(0, 0)
        ids = _joined(counts, "pids", np.int64)
        at = np.minimum(np.searchsorted(a["pid"], ids), len(a["pid"]) - 1)
        own = a["pid"][at] == ids
        c, vfreq = (np.bincount(at[own], _joined(counts, x, np.float64)[own], len(a["pid"])) for x in ("expected", "vfreq"))
        c = np.where(a["is_char"], np.maximum(c, 0.5), c)
        keep = c >= 0.5
        c = c[keep]
        return _state_row(state.column("block")[0].as_py(), c.sum(), pid=a["pid"][keep], is_char=a["is_char"][keep], vfreq=vfreq[keep],
                          logp=digamma(c, np.log))
    return run


def _m_step(state: Pieces, counts: DataFrame) -> tuple[Pieces, int]:
    """The next state and its size."""
    seen = Observation()
    rows = state.rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_m_step_fn(state.arrays()), _STATE_TYPE)
    rows = _stored(rows.observe(seen, F.sum("n").alias("n"), F.sum("total").alias("total")), "pieces")
    n, total = (seen.get[c] or 0 for c in ("n", "total"))
    return Pieces(rows, digamma(float(total), math.log) if n else 0.0), n


_ALL = (_NEG, 2 ** 63 - 1)


def best_cut(df: DataFrame, key: str, k: int) -> tuple[float, int]:
    """The last of the ``k`` rows with the largest ``key`` (a finite double), ties by ascending ``pid`` (unique): a value and
    an id, such that the rows above this value, and those of this value up to this id, are the ``k``.

    A histogram between the extremes finds the bin with the k-th row and is
    refined there until few rows, or only ties, are left.
    """
    if k <= 0:
        return -_NEG, -1
    part, value, left = df, F.col(key), k
    tie = None
    while True:
        n, low, high = part.agg(F.count(F.lit(1)), F.min(value), F.max(value)).first()
        if n <= left:      # the bin's rows all belong to the best
            return _ALL if not n else (low, _ALL[1]) if tie is None else (tie, int(-low))
        if n <= _FEW:
            return tuple(part.orderBy(F.desc(key), "pid").limit(left).orderBy(F.asc(key), F.desc("pid")).select(key, "pid").first())
        if low == high:    # only ties are left: by id
            value, tie = -F.col("pid").cast("double"), low
            continue
        at = F.least(F.floor((value - low) / F.lit(high - low) * _BINS), F.lit(_BINS - 1))
        bins = part.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")) \
            .orderBy(F.desc("at")).collect()   # at most _BINS rows
        for b in bins:
            if b.n >= left:
                part = part.filter((value >= b.low) & (value <= b.high))
                break
            left -= b.n


def best_rows(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest ``key``, as in ``best_cut``."""
    value, pid = best_cut(df, key, k)
    return df.filter((F.col(key) > value) | ((F.col(key) == value) & (F.col("pid") <= pid)))


def _costs_fn(read):
    """Of one block: what each piece's removal costs; beside the state, as lists, for those that are no characters."""
    def run(state: pa.Table, best: pa.Table) -> pa.Table:
        a = read(state)
        alt = np.full(len(a["pid"]), _NEG)
        if len(alt):
            ids = _joined(best, "pids", np.int64)
            at = np.minimum(np.searchsorted(a["pid"], ids), len(alt) - 1)
            own = a["pid"][at] == ids
            alt[at[own]] = _joined(best, "alt", np.float64)[own]
        with np.errstate(invalid="ignore"):
            cost = np.where(alt > _NEG, a["vfreq"] * (a["logp"] - alt), 1e300)
        multi = ~a["is_char"]
        out = _state_row(state.column("block")[0].as_py() if len(state) else 0, **(a | {"cost": cost}))
        return out.append_column("ids", pa.array([a["pid"][multi]], pa.list_(pa.int64()))) \
            .append_column("costs", pa.array([cost[multi]], pa.list_(pa.float64()))).slice(0, min(1, len(state)))
    return run


def _prune(state: Pieces, pieces: Lattice, n_chars: int, target: int) -> Pieces:
    """Keep the ``target`` pieces whose removal costs most likelihood (Viterbi
    frequency × (log p − log p of the best split without it)); single
    characters are always kept."""
    alt = _meet(pieces.whole, state, _best_fn(pieces.whole.blocks), "block long, pids binary, alt binary")
    costs = _stored(state.rows.groupBy("block").cogroup(alt.groupBy("block"))
                    .applyInArrow(_costs_fn(state.arrays()), _STATE_TYPE + ", ids array<long>, costs array<double>"), "costs")
    flat = costs.select(F.explode(F.arrays_zip(F.col("ids").alias("pid"), F.col("costs").alias("cost"))).alias("x")).select("x.pid", "x.cost")
    return Pieces(costs.select(*state.rows.columns), 0.0, best_cut(flat, "cost", target - n_chars))


def _without_rare(seeds: DataFrame, coverage: float) -> DataFrame:
    """Pieces of the most frequent characters that make up ``coverage`` of the text; a tie goes to the smaller one."""
    chars = seeds.filter("n_chars = 1")   # no more rows than characters exist
    before = F.sum("freq").over(Window.orderBy(F.desc("freq"), "piece").rowsBetween(Window.unboundedPreceding, -1))
    rare = chars.select("piece", F.coalesce(before, F.lit(0)).alias("b"), F.sum("freq").over(Window.partitionBy()).alias("t")) \
        .filter(F.col("b") >= F.lit(coverage) * F.col("t")).select(F.col("piece").alias("ch"))
    hit = seeds.select("pid", F.explode(F.array_distinct(F.split("piece", ""))).alias("ch")).join(rare, "ch", "left_semi")
    return seeds.join(hit.select("pid").distinct(), "pid", "left_anti")


def train_vocab(norm_df: DataFrame, vocab_size: int = 32000, norm: str = "norm",
                seed_size: int = 1_000_000, max_piece_len: int = 16, em_iters: int = 2,
                shrink: float = 0.75, with_pad: bool = True,
                character_coverage: float = 1.0, input_sentence_size: int | None = None,
                sentence_keys: list[str] | None = None, segment: int = SEGMENT) -> DataFrame:
    """Train a unigram vocabulary of ``vocab_size`` ids (specials included).

    ``character_coverage`` below 1 keeps only the most frequent characters
    that make up this share of the text; pieces with another character are no
    candidates and words with one are not learned from.
    ``input_sentence_size`` learns from that many rows of ``norm_df``, drawn in
    the seeded order of their ``sentence_keys`` (off by default: all rows).
    Words of ``2 * segment`` characters or more are cut into segments.
    """
    spark = norm_df.sparkSession
    if input_sentence_size is not None:
        if not sentence_keys:
            raise ValueError("input_sentence_size needs sentence_keys")
        norm_df = sample_lines(norm_df, sentence_keys, input_sentence_size)
    words = _stored(word_counts(norm_df, norm).withColumn("wid", F.monotonically_increasing_id()), "words")
    seeds = _stored(seed_pieces(words, top_k=seed_size, max_piece_len=max_piece_len)
                    .withColumn("pid", F.monotonically_increasing_id()), "seeds")
    all_seeds = seeds
    if character_coverage < 1:
        seeds = _stored(_without_rare(seeds, character_coverage), "seeds")
    alive, n_chars, total = seeds.agg(F.count(F.lit(1)), F.count(F.when(F.col("n_chars") == 1, 1)), F.sum("score")).first()
    n_special = len(SPECIALS) if with_pad else len(SPECIALS) - 1
    goal = max(vocab_size - n_special, n_chars)
    first = seeds.select("pid", (F.col("n_chars") == 1).alias("is_char"), F.log(F.col("score") / F.lit(float(total or 1))).alias("logp"))
    if not alive:
        chosen = first
    else:
        lattice = build_lattice(words, seeds, max_piece_len, segment)
        blocks = lattice.whole.blocks
        state = Pieces(_stored(first.withColumn("block", _block(blocks)).groupBy("block").applyInArrow(_state_fn, _STATE_TYPE), "pieces"))
        whole = None   # built over the pieces that the first round leaves
        # train down to 110 % of the goal, then keep the best-scoring pieces
        desired = int(goal * 1.1)
        compacted_at = alive
        while True:
            for it in range(em_iters):
                if alive * 4 <= compacted_at:
                    lattice, whole = compact_lattice(lattice, state), whole and compact_lattice(whole, state)
                    compacted_at = alive
                state, alive = _m_step(state, _block_counts(lattice, state, it == em_iters - 1))
            if alive <= desired:
                break
            if whole is None:
                left = seeds.join(state.table().select("pid"), "pid", "left_semi")
                whole = build_lattice(left.select(F.col("pid").alias("wid"), F.col("piece").alias("word"),
                                                  F.lit(1).cast("long").alias("freq")), left, max_piece_len, proper=True, blocks=blocks)
            alive = max(desired, int(alive * shrink))
            state = _prune(state, whole, n_chars, alive)
        for t in filter(None, (lattice, whole)):
            t.drop()
        chosen = state.table()
    # final: the best `goal` pieces by score, characters always kept
    chosen = chosen.filter("is_char").unionByName(best_rows(chosen.filter(~F.col("is_char")), "logp", goal - n_chars))
    final = cut_lineage(chosen.join(all_seeds.select("pid", "piece"), "pid").select("piece", F.col("logp").alias("score")), spark)
    return layout_vocab(final, score="score", with_pad=with_pad)
