import pytest

from tokenmill.operators import examples

S, PAD = 8, 3


def ref_pair(ids, s=S, pad=PAD):
    t = list(ids)
    if len(t) <= s:
        t = t + [pad] * (s - len(t) + 1)
    return t[:s], t[1:s + 1]


@pytest.mark.parametrize("L", [0, 1, S - 1, S, S + 1, 3 * S])
def test_shift_pair_matches_definition(spark, L):
    ids = list(range(10, 10 + L))
    df = spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>")
    r = examples.shift_pair(df, S, PAD).collect()[0]
    x, y = ref_pair(ids)
    assert (list(r.x), list(r.y)) == (x, y)
    assert len(r.x) == len(r.y) == S


def test_loss_tokens_and_check(spark):
    rows = [(i, list(range(10, 10 + L))) for i, L in enumerate([0, 1, 7, 8, 9, 24])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    pairs = examples.shift_pair(df, S, PAD, keep_ids=True)
    lt = {r.doc_id: (r.n_targets, r.n_cut) for r in examples.loss_tokens(pairs, S, PAD).collect()}
    for i, ids in rows:
        _, y = ref_pair(ids)
        assert lt[i] == (sum(1 for t in y if t != PAD), max(0, len(ids) - (S + 1)))
    chk = examples.check_examples(pairs, S).collect()[0]
    assert (chk.n_pairs, chk.n_bad, chk.n_misaligned) == (6, 0, 0)


def test_build_batches_orders_by_slot(spark):
    df = spark.createDataFrame([(0, 0, s, 100 + s, [s], [s]) for s in [3, 1, 2, 0]],
                               "epoch int, batch_id long, slot long, doc_id long, x array<int>, y array<int>")
    r = examples.build_batches(df).collect()[0]
    assert list(r.doc_id) == [100, 101, 102, 103] and r.n_pairs == 4


def test_packed_ids_come_back(spark):
    from tokenmill.functions.exprs import pack_ids, unpack_ids
    lists = [[], None, [0], [0, 127, 128, 0], [1, 16383, 16384, 2 ** 21 - 1], [2 ** 21, 1], [-1, 5], [None, 3],
             [None], [10, 13, 0, 92, 34], list(range(300)), [2 ** 31 - 1]]
    for kind in ("int", "long"):
        df = spark.createDataFrame(list(enumerate(lists)), f"k long, ids array<{kind}>")
        d = df.select("k", pack_ids("ids").alias("p"))
        got = d.select("k", "p", unpack_ids(d.p, df.schema["ids"].dataType).alias("back"))
        assert got.schema["back"].dataType.elementType == df.schema["ids"].dataType.elementType
        rows = {r.k: r for r in got.collect()}
        assert [rows[k].back for k in range(len(lists))] == lists
        assert rows[2].p.tinyint == [0] and rows[2].p.smallint is None and rows[2].p.raw is None
        assert rows[3].p.smallint == lists[3] and rows[3].p.tinyint is None and rows[3].p.raw is None
        assert rows[11].p.raw == lists[11]


def test_epoch_batches_move_packed_lists(spark):
    rows = [(k, [4 + (k * j) % 200 for j in range(k % 7 * 5)]) for k in range(60)] + [(60, [None, 9]), (61, [-3, 70_000_000])]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    bb = examples.epoch_batches(df, ["doc_id"], 2, 8, 16, 3)
    want = {k: (ids[:17] + [3] * 17)[:17] for k, ids in rows}
    seen = [(r.epoch, d, x, y) for r in bb.collect() for d, x, y in zip(r.doc_id, r.x, r.y, strict=True)]
    assert len(seen) == 2 * len(rows)
    assert all(x == want[d][:16] and y == want[d][1:] for _, d, x, y in seen)
    assert "array<tinyint>" in bb._jdf.queryExecution().optimizedPlan().toString()
