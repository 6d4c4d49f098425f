"""Ball-tree search against plain scoring."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs, empty  # noqa: F401
from tokenmill.llm import ball_tree

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in WORD.findall(text or "")]


def plain(rows, items, top=10):
    """``(item_id, rank, doc_id, score)`` by the definition."""
    bags = [(i, Counter(words(t)), len(words(t))) for i, t in rows if words(t)]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(w for _, bag, _ in bags for w in bag)
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(words(t))
    out = []
    for i, own in terms.items():
        ranked = []
        for d, bag, n in bags:
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10 ** 9 * bag[w]) // (1000 * bag[w] + 8 * m))
                    for w in own if w in bag)
            if s > 0:
                ranked.append((-s, d is None, d or 0))
        out += [(i, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(ranked)[:top])]
    return out


def key(r):
    return tuple((x is not None, x) for x in r)


@pytest.mark.parametrize("limits", [{}, {"pass_terms": 7, "block_terms": 3, "block_items": 2}])
def test_edges(spark, docs, empty, limits):  # noqa: F811
    """Nulls, empty and long texts, repeated rows and ids, clashing columns, many passes and blocks."""
    items = [(1, "alpha1 ALPHA2 alpha60 alpha2"), (2, "one two"), (2, "Ünïcode"), (3, None), (4, ""), (5, "nowhere"),
             (None, "a b c z"), (7, "word5 other3 漢字"), (8, " ".join(f"alpha{k}" for k in range(40)))]
    bench = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, rank int, terms int")
    odd = docs.withColumn("n", F.lit(1)).withColumn("terms", F.lit("x")).withColumn("item_id", F.lit(9)).repartition(3)
    got = [tuple(r) for r in ball_tree.search(odd, bench, **limits).collect()]
    assert sorted(got, key=key) == sorted(plain([(r.doc_id, r.text) for r in docs.collect()], items), key=key)
    assert ball_tree.search(empty, bench).isEmpty() and ball_tree.search(docs, bench.limit(0)).isEmpty()


def random_tree(seed, n=700, dims=60, copies=300):
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(dims, rng.integers(1, 12), replace=False)) for _ in range(n)]
    rows += [rows[0]] * copies
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    ids = np.concatenate(rows)
    values = rng.integers(0, 10 ** 9, len(ids))
    for k in range(n, n + copies):
        values[ptr[k]:ptr[k + 1]] = values[:ptr[1]]
    has = rng.random((9, dims)) < 0.1
    has[0] = True
    has[:, 0] = True
    return ptr, ids, values, ball_tree.Items(np.arange(dims), has, list(range(9)))


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_and_search_is_exact(seed):
    ptr, ids, values, items = random_tree(seed)
    tree = ball_tree.BallTree(ptr, ids, values, len(items.numbers), leaf=16)
    n = len(ptr) - 1
    bound = tree.bounds(*items.terms())
    exact = np.stack([np.add.reduceat(np.where(row[ids], values, 0), ptr[:-1]) for row in items.has], 1)
    for k, (a, b) in enumerate(tree.range):
        assert (exact[tree.order[a:b]].max(0) <= bound[k]).all()
    opened = 0
    for k, row in enumerate(items.has):
        best = ball_tree.Best(10)
        best.ids = list(range(n))
        opened += tree.search(row, bound[:, k], best)
        want = sorted((-int(s), False, d) for d, s in enumerate(exact[:, k]) if s > 0)[:10]
        assert best.rows == want
    leaves = sum(c is None for c in tree.children)
    assert 0 < opened < leaves * len(items.has)   # subtrees are pruned
    assert sorted(tree.order.tolist()) == list(range(n))


def test_terms_compare_bytes():
    terms = ball_tree.Terms([b"abc", "ñé".encode(), b"1"])
    raw = np.frombuffer("ABC abd 1 Ñé ñé x".encode(), np.uint8)
    s, e, h, first = ball_tree.terms_of(raw, np.array([0, len(raw)]))
    assert first.tolist() == [0, 6]
    hit, number = terms.match(raw, s, e, h)
    assert (hit.tolist(), number.tolist()) == ([0, 2, 4], [0, 2, 1])
    forged = np.full(len(h), terms.hash[0])   # equal fingerprints of other words
    assert terms.match(raw, s, e, forged)[0].tolist() in ([0], [2], [4])
