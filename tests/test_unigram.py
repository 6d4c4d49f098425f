import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenmill.operators import codec, unigram


def test_unigram_vocab_is_consistent_and_compresses(spark):
    rows = [(i, t) for i, t in enumerate(
        ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "then the theme ended",
         "other mothers gather there", "the rather smooth rhythm"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    norm = codec.normalise_text(df, "text", "norm")
    v = unigram.train_vocab(norm, vocab_size=40, seed_size=200)
    rows_v = v.collect()
    ids = sorted(r.id for r in rows_v)
    # dense ids; at most the requested size (EM may empty pieces on a tiny corpus)
    assert ids == list(range(len(ids))) and len(ids) <= 40
    assert {r.kind for r in rows_v if r.id < 4} == {"unk", "bos", "eos", "pad"}
    pieces = {r.piece for r in rows_v if r.kind == "normal"}
    chars = {c for _, t in rows for c in "▁" + t.replace(" ", "▁")}
    assert chars <= pieces
    assert any(len(p) > 2 for p in pieces)
    m = codec.CodecModel.from_vocab(v)
    enc = codec.encode(df, m)
    back = codec.decode(enc, m, ids="ids", out="back")
    assert back.filter(F.col("back") != F.col("text")).count() == 0
    n_tok = enc.select(F.sum(F.size("ids"))).first()[0]
    assert n_tok < sum(len(t) for _, t in rows) * 0.6


def test_character_coverage_and_sentence_sample(spark):
    rows = [(i, "abab baba " * 10 + ("qx" if i == 0 else "")) for i in range(20)]
    norm = codec.normalise_text(spark.createDataFrame(rows, "doc_id long, text string"), "text", "norm")
    full = {r.piece for r in unigram.train_vocab(norm, vocab_size=20, seed_size=50).collect()}
    cut = {r.piece for r in unigram.train_vocab(norm, vocab_size=20, seed_size=50, character_coverage=0.99).collect()}
    assert {"a", "b", "q", "x", "▁"} <= full
    assert {"a", "b", "▁"} <= cut and not any(c in p for c in "qx" for p in cut - {"<pad>"})
    few = unigram.train_vocab(norm, vocab_size=20, seed_size=50, input_sentence_size=0, sentence_keys=["doc_id"])
    assert [r.kind for r in few.orderBy("id").collect()] == ["unk", "bos", "eos", "pad"]
    with pytest.raises(ValueError):
        unigram.train_vocab(norm, input_sentence_size=5)


def _forward_backward(word, scores):
    """Expected counts of one word by listing all segmentations."""
    paths = []

    def walk(at, used, lp):
        if at == len(word):
            paths.append((lp, used))
        for j in range(at + 1, len(word) + 1):
            if word[at:j] in scores:
                walk(j, [*used, word[at:j]], lp + scores[word[at:j]])

    walk(0, [], 0.0)
    total = sum(math.exp(lp) for lp, _ in paths)
    out = {}
    for lp, used in paths:
        for p in used:
            out[p] = out.get(p, 0.0) + math.exp(lp) / total
    best = max(paths)[1] if paths else []
    return out, best


def test_expected_counts_match_all_segmentations(spark):
    scores = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.1, "bc": -3.3, "abc": -4.0, "ca": -4.2}
    words = {"abcabc": 3, "cab": 2, "bbb": 1, "axb": 5, "a": 7}   # "axb" has no segmentation
    w = spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(words.items())], "wid long, word string, freq long")
    v = spark.createDataFrame([(10 * i, p, s) for i, (p, s) in enumerate(scores.items())], "pid long, piece string, logp double")
    lattice = unigram.build_lattice(w, v, max_piece_len=3)
    got = {r.piece: (r.expected, r.vfreq) for r in unigram.expected_counts(lattice, v, True).join(v, "pid").collect()}
    want, vit = {}, {}
    for t, n in words.items():
        e, best = _forward_backward(t, scores)
        for p, x in e.items():
            want[p] = want.get(p, 0.0) + n * x
        for p in best:
            vit[p] = vit.get(p, 0.0) + n
    assert set(got) == set(want)
    assert all(got[p][0] == pytest.approx(x) and got[p][1] == vit.get(p, 0.0) for p, x in want.items())
    lattice.drop()


def test_long_words_in_segments(spark):
    """Segments of any length give the counts of the unsplit word."""
    rng = random.Random(3)
    pieces = ["a", "b", "c", "ab", "bc", "cab", "abca", "aa", "bbbb"]
    v = spark.createDataFrame([(i, p, -1.0 - rng.random() * len(p)) for i, p in enumerate(pieces)], "pid long, piece string, logp double")
    texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (700, 9, 64, 31, 1)] + ["ab" * 200, "abc" * 5 + "x" + "abc" * 20]
    w = spark.createDataFrame([(i, t, 1 + i) for i, t in enumerate(texts)], "wid long, word string, freq long")
    results = []
    for segment in (4096, 16, 50):
        lattice = unigram.build_lattice(w, v, max_piece_len=4, segment=segment)
        assert (lattice.cut is not None) == (segment < 4096)
        results.append({r.pid: (r.expected, r.vfreq) for r in unigram.expected_counts(lattice, v, True).collect()})
        lattice.drop()
    for other in results[1:]:
        assert set(other) == set(results[0])
        for pid, (e, f) in results[0].items():
            assert other[pid][0] == pytest.approx(e, rel=1e-9)
        # between best paths of equal score any may be counted
        assert sum(f * len(pieces[p]) for p, (_, f) in other.items()) == sum(f * len(pieces[p]) for p, (_, f) in results[0].items())


def test_one_very_long_word(spark):
    """A word of 100,000 characters is many rows; its counts are those of its repeated part."""
    v = spark.createDataFrame([(0, "a", -1.0), (1, "b", -1.5), (2, "ab", -1.2)], "pid long, piece string, logp double")
    n = 50_000
    w = spark.createDataFrame([(0, 1)], "wid long, freq long").select("wid", F.repeat(F.lit("ab"), n).alias("word"), "freq")
    lattice = unigram.build_lattice(w, v, max_piece_len=2)
    assert lattice.cut.rows.select(F.sum(F.length("size") / 4)).first()[0] > 20   # segments
    got = {r.pid: (r.expected, r.vfreq) for r in unigram.expected_counts(lattice, v, True).collect()}
    pair = math.exp(-1.2) / (math.exp(-1.2) + math.exp(-2.5))
    assert got[2] == (pytest.approx(n * pair, rel=1e-6), n)
    assert got[0][0] == pytest.approx(n * (1 - pair), rel=1e-6) and got[0][1] == 0.0
    lattice.drop()


def test_pieces_of_a_bucket_move_as_arrays(spark):
    """Buckets ask for their pieces and scores block by block, not piece by piece; the edges are all occurrences."""
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("abç😀\u0301") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    pieces = sorted({t[i:i + n] for t in texts for i in range(len(t)) for n in (1, 2, 3)})[::2]
    w = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "wid long, word string, freq long")
    v = spark.createDataFrame([(7 * i, p) for i, p in enumerate(pieces)], "pid long, piece string")
    for proper in (False, True):
        lattice = unigram.build_lattice(w, v, max_piece_len=3, bucket_edges=500, proper=proper)
        got = []
        rows = lattice.whole.rows.collect()
        for r in rows:
            a = {c: np.frombuffer(r[c], t) for c, t in unigram._ARRAYS.items()}
            word = np.repeat(a["wid"], a["n"])
            got += zip(word.tolist(), a["st"].tolist(), a["en"].tolist(), a["pids"][a["code"]].tolist())
        ids = {p: 7 * i for i, p in enumerate(pieces)}
        assert sorted(got) == sorted((i, s, s + n, ids[t[s:s + n]]) for i, t in enumerate(texts) for s in range(len(t))
                                     for n in (1, 2, 3) if t[s:s + n] in ids and s + n <= len(t) and not (proper and n == len(t)))
        used = lattice.whole.used
        assert used.count() <= len(rows) * lattice.tasks
        assert used.select(F.sum(F.length("pids") / 8)).first()[0] > used.count()   # more pieces than rows
        lattice.drop()


def _lattice_row(rng, texts, pieces):
    """One bucket's arrays: the words by size, their edges by start and length, pieces by id."""
    texts = sorted(texts, key=len)
    edges = [[(i, i + n, pieces[t[i:i + n]]) for i in range(len(t)) for n in range(1, 5) if t[i:i + n] in pieces and i + n <= len(t)] for t in texts]
    st, en, code = (np.array([e[c] for w in edges for e in w], np.int64) for c in range(3))
    return {"st": st, "en": en, "code": code, "n": np.array([len(w) for w in edges]), "size": np.array([len(t) for t in texts], np.int32),
            "freq": np.array([rng.randint(1, 9) for _ in texts], np.int64), "wid": np.arange(len(texts)), "seg": np.zeros(len(texts), np.int32),
            "pids": np.arange(max(pieces.values()) + 1)}


@pytest.mark.parametrize("worst", [3.0, 90.0])
def test_short_words_as_cells(worst):
    """Cells give the counts, best paths and best scores of the edges, for all words that fit; dead pieces have no part."""
    rng = random.Random(7)
    texts = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(300)}
    pieces = {p: i for i, p in enumerate(["a", "b", "c", "ab", "bc", "cab", "abca", "aa", "bbbb", "ca", "x"])}
    row = _lattice_row(rng, texts, pieces)
    value = np.array([-worst * rng.random() for _ in pieces])
    value[[2, 7]] = -np.inf   # words with a "c" outside "bc", "cab", "abca", "ca" have no path
    value[0] = -worst
    got, seen, scale = [np.zeros(len(value)), np.zeros(len(value)), []], 0, row["freq"].astype(float)
    for x, y, cells in unigram._short_words(row, value):
        assert x == seen
        seen = y
        got[0] += cells.expected(value, scale[x:y], len(value))
        got[1] += cells.viterbi(value, scale[x:y], len(value))
        got[2] += cells.best(value)[0].tolist()
    assert seen == (row["size"] <= min(32, 650 / worst)).sum() and 0 < seen < len(texts)
    rest, every = unigram._edges(row, value, seen), unigram._edges(row, value)
    assert got[0] == pytest.approx(every.expected(len(value)) - rest.expected(len(value)), rel=1e-9, abs=1e-6)
    assert (got[1] == every.viterbi(len(value)) - rest.viterbi(len(value))).all()
    assert got[2] == every.forward(best=True)[every.last][:seen].tolist()


def test_equal_pieces_are_read_as_edges():
    """Cells hold one piece each; words with two pieces of the same text are left to the edges."""
    row = _lattice_row(random.Random(1), ["ab"], {"a": 0, "b": 1})
    row = row | {"st": np.array([0, 0, 1]), "en": np.array([1, 1, 2]), "code": np.array([0, 2, 1]), "n": np.array([3]), "pids": np.arange(3)}
    assert list(unigram._short_words(row, np.array([-1.0, -1.0, -2.0]))) == []
    assert unigram._edges(row, np.array([-1.0, -1.0, -2.0])).expected(3).sum() == pytest.approx(2.0 * row["freq"][0])


def test_state_is_a_row_per_block(spark):
    """A step reads and writes arrays of pieces, and starts no job of its own for their number and total."""
    pieces = ["a", "b", "ab", "aba", "ba", "x"]
    w = spark.createDataFrame([(0, "abab", 4), (1, "aba", 3), (2, "b", 1)], "wid long, word string, freq long")
    v = spark.createDataFrame([(i, p, len(p) == 1, -1.0 - i / 10) for i, p in enumerate(pieces)], "pid long, piece string, is_char boolean, logp double")
    lattice = unigram.build_lattice(w, v, max_piece_len=3, blocks=2)
    state = unigram.Pieces(v.drop("piece").withColumn("block", unigram._block(2)).groupBy("block")
                           .applyInArrow(unigram._state_fn, unigram._STATE_TYPE))
    assert state.rows.count() == 2
    want = {r.pid: r.expected for r in unigram.expected_counts(lattice, v).collect()}
    after, n = unigram._m_step(state, unigram._block_counts(lattice, state, True))
    assert after.rows.count() <= 2
    kept = {i: max(want.get(i, 0.0), 0.5) if len(p) == 1 else want.get(i, 0.0) for i, p in enumerate(pieces)}
    kept = {i: c for i, c in kept.items() if c >= 0.5}
    got = {r.pid: r.logp for r in after.table().collect()}
    assert set(got) == set(kept) and n == len(kept) and 5 in kept   # a character without counts stays
    total = unigram.digamma(sum(kept.values()), math.log)
    assert all(got[i] == pytest.approx(unigram.digamma(c, math.log) - total) for i, c in kept.items())
    # of the others, those above the cut and, at its value, up to its id
    cost = {"a": 0.0, "b": 0.0, "x": 0.0, "ab": 2.0, "aba": 2.0, "ba": 1.0}
    rows = [unigram._state_row(b, **{c: np.array([x[j] for x in own]) for j, c in enumerate(("pid", "is_char", "logp", "cost"))})
            for b in (0, 1) for own in [[(i, len(p) == 1, -1.0, cost[p]) for i, p in enumerate(pieces) if i % 2 == b]]]
    cut = unigram.Pieces(spark.createDataFrame(pa.concat_tables(rows).to_pandas(), unigram._STATE_TYPE), 0.0, (2.0, 2))
    assert {pieces[r.pid] for r in cut.table().collect()} == {"a", "b", "x", "ab"}
    lattice.drop()


def test_digamma(spark):
    got = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 10.0, 1e6)], "x double").select(unigram.digamma(F.col("x")).alias("d")).collect()
    want = [-1.9635100260214235, -0.5772156649015329, 0.42278433509846713, 2.251752589066721, 13.815510057964274]
    assert [r.d for r in got] == pytest.approx(want, abs=1e-10)


@pytest.mark.parametrize("few", [5, 20_000])
def test_best_rows(spark, monkeypatch, few):
    monkeypatch.setattr(unigram, "_FEW", few)
    rng = random.Random(1)
    rows = [(i, rng.choice([0.0, 1.0, 2.5, rng.random(), 1e300])) for i in range(300)] + [(1000 + i, 7.0) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "pid long, key double").cache()
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (0, 1, 40, 130, 300, 420, 500, 900):
        assert {r.pid for r in unigram.best_rows(df, "key", k).collect()} == {r[0] for r in order[:k]}, k
