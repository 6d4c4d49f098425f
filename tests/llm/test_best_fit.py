"""Best-fit packing against sequential best fit and the tokenizer."""

import heapq
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_fixtures import SF_SMALL, docs, empty  # noqa: F401
from tokenmill.llm import best_fit
from tokenmill.llm.common import landed


def sequential(lengths, width):
    """Number of sequences of plain best-fit decreasing."""
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            opened += 1
            gaps.append(width - n)
    return opened


def lay_out(rows, width):
    """Sequences of (row, place, length); fails on overlaps, holes and overlong sequences."""
    per = defaultdict(list)
    for row, sequence, at, n in rows:
        per[sequence].append((at, n))
    for pieces in per.values():
        end = 0
        for at, n in sorted(pieces):
            assert at == end
            end += n
        assert end <= width
    return per


@pytest.mark.parametrize("range_rows", [50_000, 40])
@pytest.mark.parametrize("kind", ["even", "small gaps", "many copies", "one", "none"])
def test_place(spark, kind, range_rows):
    rng = np.random.default_rng(1)
    lengths = {"even": rng.integers(1, 129, 400), "many copies": np.r_[np.full(60, 75), np.full(300, 6), rng.integers(1, 40, 40)],
               "small gaps": np.r_[rng.integers(50, 70, 80), rng.integers(1, 6, 500)], "one": [1], "none": []}[kind]
    lengths = [int(n) for n in lengths]
    pieces = landed(spark.createDataFrame(list(enumerate(lengths)), "row long, length long"), "lengths")
    got = [(r.row, r.sequence_id, r.place, lengths[r.row]) for r in best_fit.place(pieces, 128, range_rows).collect()]
    assert sorted(r[0] for r in got) == list(range(len(lengths)))
    n = len(lay_out(got, 128))
    least = sequential(lengths, 128)
    assert n <= least if range_rows > len(lengths) else n <= 1.08 * least + 2


def test_sweep_is_best_fit():
    rng = np.random.default_rng(3)
    lengths = sorted(rng.integers(1, 65, 500).tolist(), reverse=True)
    sweep, opened = best_fit.Sweep(64), 0
    for n in lengths:
        if sweep.piece(n) is None:
            heapq.heappush(sweep.later, (n - 64, opened))
            opened += 1
    assert opened == sequential(lengths, 64)


def expected_ids(text):
    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    return [*tok.encode(text or "", add_special_tokens=False).ids, best_fit.END_ID]


def check_pieces(rows, texts, width):
    """``texts``: (doc_id, text) rows; compares all pieces with the tokenizer's ids."""
    want = []
    for i, t in texts:
        ids = expected_ids(t)
        edges = [0, *range(len(ids) % width or width, len(ids) + 1, width)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    return lay_out([(None, r.sequence_id, r.offset, r.length) for r in rows], width)


def test_pack_edges(spark, docs, empty):  # noqa: F811
    odd = docs.union(spark.createDataFrame([(20, "a <|endoftext|> b", "en", "k", 0.0)], docs.schema)) \
        .withColumnRenamed("kept", "row").withColumnRenamed("score", "sequence_id")
    rows = best_fit.pack(odd, best_fit._vocabulary(), width=64).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in odd.collect()], 64)
    assert best_fit.pack(empty, best_fit._vocabulary()).isEmpty()


def test_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    rows = best_fit.query(spark, SF_SMALL).collect()
    n = len(check_pieces(rows, texts, best_fit.WIDTH))
    assert n <= sequential([r.length for r in rows], best_fit.WIDTH)
