import datetime
import os
import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tokenmill.operators import columns, gate, runlog
from tokenmill.session import scratch_path
from tokenmill.sources import io
from tokenmill.streaming import gate_stream


def test_csv_round_trip_edge_rows(spark):
    rows = ['a "q", b\nline2', "", "  lead ", "NA", "back\\slash"]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)], "id string, text string")
    path = io.write_text_csv(df, scratch_path(spark, "t_csv"))
    back = {r.id: r.text for r in io.read_text_csv(spark, path, columns=["id", "text"]).collect()}
    assert back == {str(i): t for i, t in enumerate(rows)}
    # pandas reads the same file equally (dtype=str, no NA parsing)
    files = [os.path.join(path, f) for f in os.listdir(path) if f.endswith(".csv")]
    pdf = pd.concat([pd.read_csv(f, dtype=str, na_filter=False) for f in files])
    assert dict(zip(pdf.id, pdf.text)) == back


def test_read_lines_keeps_line_ends(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    with open(f"{d}/a.txt", "w") as f:
        f.write("one\ntwo\n\nthree")
    with open(f"{d}/b.txt", "w") as f:
        f.write("x\n")
    got = sorted((os.path.basename(r.file), r.line_no, r.line) for r in io.read_lines(spark, d).collect())
    with open(f"{d}/a.txt") as f:
        a = f.readlines()
    assert [x[2] for x in got if x[0] == "a.txt"] == a
    assert [x[2] for x in got if x[0] == "b.txt"] == ["x\n"]


def test_word_list_last_duplicate_wins(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    with open(f"{d}/w.csv", "w") as f:
        f.write("word,a,b\ncat,1,x\ndog,2,y\ncat,3,z\n")
    got = {r.word: list(r.attrs) for r in io.read_word_list(spark, d).collect()}
    assert got == {"cat": ["3", "z"], "dog": ["2", "y"]}


def test_drop_strict_and_union(spark):
    a = spark.createDataFrame([(1, "x")], "id long, t string")
    with pytest.raises(KeyError):
        columns.drop_columns_strict(a, "nope")
    b = spark.createDataFrame([("y", 2.0)], "t string, extra double")
    u = columns.union_all_by_name(a, b)
    assert u.columns == ["id", "t", "extra"] and u.count() == 2


def test_words_regex(spark):
    df = spark.createDataFrame([(0, "Été déjà x_1")], "k long, text string")
    assert list(gate.split_words(df).collect()[0].words) == ["été", "déjà", "x", "1"]


def test_flag_prompts_and_stream(spark):
    prompts = spark.createDataFrame([(i, t, i // 2) for i, t in enumerate(["the cat", "a dog ran", "cat cat", "zebra"])],
                                    "conv_id long, text string, batch_id long")
    wl = spark.createDataFrame([("the",), ("cat",), ("a",), ("dog",)], "word string")
    got = {r.conv_id: (r.status, list(r.missing)) for r in gate.flag_prompts(prompts, wl, "conv_id").collect()}
    assert got == {0: ("clear", []), 1: ("flagged", ["ran"]), 2: ("clear", []), 3: ("flagged", ["zebra"])}
    src = scratch_path(spark, "t_src")
    prompts.repartition(2, "batch_id").write.parquet(src)
    sink, ck = scratch_path(spark, "t_sink"), scratch_path(spark, "t_ck")
    q = gate_stream.start_gate_stream(spark, src, prompts.schema, wl, sink, ck, "conv_id")
    q.awaitTermination()
    s = {r.conv_id: r.status for r in gate_stream.read_gate_sink(spark, sink).collect()}
    assert s == {k: v[0] for k, v in got.items()}


def test_stopword_coverage(spark):
    stop = spark.createDataFrame([("the",), ("it",), ("isn't",)], "word string")
    wl = spark.createDataFrame([("the",)], "word string")
    r = gate.stopword_coverage(stop, wl).collect()[0]
    assert (r.n_stop, r.n_missing, list(r.missing)) == (3, 2, ["isn't", "it"])


def _log(spark, losses, run=1):
    return spark.createDataFrame([(run, e, float(v)) for e, v in enumerate(losses)], "run int, epoch int, val_loss double")


@pytest.mark.parametrize("losses,want", [
    ([5, 4, 3, 2, 1, 0.5, 0.4], None),                  # strictly falling
    ([1, 1, 1, 1, 1, 1, 1, 1], 5),                      # constant: stops after 5 checks
    ([3, 4, 4, 4, 4, 2.9, 4, 4], None),                 # improves on the last allowed check
])
def test_early_stop(spark, losses, want):
    r = runlog.early_stop_epoch(_log(spark, losses), patience=5).collect()[0]
    assert r.stop_epoch == want


def test_early_stop_matches_loop(spark):
    import random
    rnd = random.Random(3)
    for run in range(20):
        losses = [rnd.choice([1.0, 2.0, 3.0, 0.5]) for _ in range(15)]
        best, wait, stop = float("inf"), 0, None
        for e, v in enumerate(losses):
            if v < best:
                best, wait = v, 0
            else:
                wait += 1
                if wait >= 3:
                    stop = e
                    break
        r = runlog.early_stop_epoch(_log(spark, losses, run), patience=3).collect()[0]
        assert r.stop_epoch == stop


def test_best_checkpoints_ties_and_names(spark):
    b = runlog.best_checkpoints(_log(spark, [2.0, 1.0, 1.0, 3.0, 1.005]), k=3)
    rows = sorted((r.rank, r.epoch) for r in b.collect())
    assert rows == [(1, 1), (2, 2), (3, 4)]
    names = {r.epoch: r.ckpt_name for r in runlog.checkpoint_name(b).collect()}
    assert names[4] == f"model-epoch=4-val_loss={1.005:.2f}"


def test_run_stamp(spark):
    df = spark.createDataFrame([(datetime.datetime(2022, 5, 7, 20, 31, 12),)], "ts timestamp")
    assert runlog.run_stamp(df).collect()[0].stamp == "2022-05-07-08:31:12_PM"


def test_lr_schedule(spark):
    r = runlog.lr_schedule(spark.range(3).withColumnRenamed("id", "epoch")).orderBy("epoch").collect()
    assert [x.lr for x in r] == pytest.approx([1e-4, 1e-4 * 0.85, 1e-4 * 0.85 ** 2])


def test_read_tokenized_and_token_column(spark):
    good = scratch_path(spark, "t_tok")
    spark.createDataFrame([(1, [1, 5, 2])], "doc_id long, ids array<int>").write.parquet(good)
    df = io.read_tokenized(spark, good)
    assert df.select(columns.token_column(df, "ids")).first()[0] == [1, 5, 2]
    assert df.select(columns.token_column(df, None, position=1)).first()[0] == [1, 5, 2]
    with pytest.raises(TypeError):
        columns.token_column(df, None, position=0)
    bad = scratch_path(spark, "t_tok_bad")
    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(bad)
    with pytest.raises(ValueError):
        io.read_tokenized(spark, bad)


def test_land_if_absent_keeps_first(spark):
    path = scratch_path(spark, "t_land")
    io.land_if_absent(spark.range(3), path)
    io.land_if_absent(spark.range(10), path)
    assert spark.read.parquet(path).count() == 3


@pytest.fixture()
def small_ranges(spark):
    """Byte ranges of 150 bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "150" if "max" in k else "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_read_lines_by_ranges_as_text_mode(spark, small_ranges):
    d = tempfile.mkdtemp(dir="/tmp")
    rng = random.Random(7)
    files = ["", "a", "a\n", "\n", "\r", "a\r", "a\r\r\n", "\r\n\r\n", "\ufeffx\ny", "\ufeff\n", "é\u2028z\r\nq"]
    files += ["".join(rng.choice(["word ", "\n", "\r\n", "\r", "ñ", "\t", "long" * 15]) for _ in range(400)) for _ in range(6)]
    for k, t in enumerate(files):
        with open(f"{d}/{k}.txt", "wb") as f:
            f.write(t.encode())
    df = io.read_lines(spark, d)
    got = {}
    for r in df.collect():
        got.setdefault(os.path.basename(r.file), {})[r.line_no] = r.line
    for k in range(len(files)):
        with open(f"{d}/{k}.txt", encoding="utf-8") as f:
            want = f.readlines()
        assert got.get(f"{k}.txt", {}) == dict(enumerate(want)), files[k]
    assert spark.read.option("lineSep", "\n").text(f"{d}/16.txt").rdd.getNumPartitions() > 4


def test_csv_by_ranges_equals_pandas(spark, small_ranges):
    rng = random.Random(3)
    cells = ["", "x", "NA", '"', '""', "a,b", "line1\nline2", "\n", '"\n"', " lead ", "back\\slash", "ü" * 9, "t\r\nu",
             "\n".join(f"row {i}, \"q\"" for i in range(40))]
    pdf = pd.DataFrame({c: [rng.choice(cells) for _ in range(120)] for c in ("a", "b c")})
    pdf.insert(0, "id", [str(i) for i in range(120)])
    d = tempfile.mkdtemp(dir="/tmp")
    pdf[:80].to_csv(f"{d}/1.csv", index=False)
    pdf[80:].to_csv(f"{d}/2.csv", index=False, lineterminator="\r\n")
    want = pd.concat([pd.read_csv(f"{d}/{k}.csv", dtype=str, na_filter=False) for k in (1, 2)])
    for columns in (None, ["id", "a", "b c"]):
        df = io.read_text_csv(spark, d, columns=columns)
        assert df.columns == ["id", "a", "b c"]
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.values.tolist()))
    one = io.read_csv_records(spark, f"{d}/1.csv")
    assert one.count() == 81


def test_csv_header_only_and_empty_cells(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    with open(f"{d}/h.csv", "w") as f:
        f.write("a,b\n")
    assert io.read_text_csv(spark, d).count() == 0
    with open(f"{d}/i.csv", "w") as f:
        f.write('a,b\n\n"",\n')
    assert [tuple(r) for r in io.read_text_csv(spark, d).collect()] == [("", "")]


def test_land_if_absent_lands_half_written_target_again(spark):
    path = scratch_path(spark, "t_half")
    spark.range(5).write.parquet(path)
    os.unlink(f"{path}/_SUCCESS")           # as a failed job leaves it
    io.land_if_absent(spark.range(3), path)
    assert spark.read.parquet(path).count() == 3
    io.land_if_absent(spark.range(10), path)
    assert spark.read.parquet(path).count() == 3
    assert [f for f in os.listdir(os.path.dirname(path)) if f.startswith(".t_half")] == []


def test_gate_progress_every_n_prompts(spark):
    """Steps go on over batches and restarts; a replayed batch writes nothing twice."""
    rows = [(f"p{i}", "the cat" if i % 3 else f"zebra {i}", i) for i in range(40)]
    wl = spark.createDataFrame([("the",), ("cat",)], "word string")
    src, sink, ck = (scratch_path(spark, n) for n in ("t_psrc", "t_psink", "t_pck"))
    schema = "prompt_id string, text string, part long"

    def more(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        gate_stream.start_gate_stream(spark, src, schema, wl, sink, ck, "prompt_id", every=4).awaitTermination()
        return gate_stream.read_gate_sink(spark, sink)

    for upto, part in ((17, rows[:17]), (18, rows[17:18]), (40, rows[18:])):      # the middle one has no clear prompt or no flagged one
        got = more(part)
        assert got.count() == upto == got.select("prompt_id").distinct().count()
    flagged = sum(t.startswith("zebra") for _, t, _ in rows)
    want = {s: [4] * (n // 4) + ([n % 4] if n % 4 else []) for s, n in (("flagged", flagged), ("clear", 40 - flagged))}
    steps = {s: [r.n_prompts for r in gate_stream.gate_progress(got, 4).filter(F.col("status") == s).orderBy("progress").collect()]
             for s in want}
    assert steps == want
    before = sorted(map(tuple, got.collect()))
    last = got.agg(F.max("batch_id")).first()[0]
    assert last == 2
    gate_stream.write_gate_batch(spark.createDataFrame(rows[18:], schema), last, wl, sink, "prompt_id", every=4)
    assert sorted(map(tuple, gate_stream.read_gate_sink(spark, sink).collect())) == before
    gate_stream.write_gate_batch(spark.createDataFrame([], schema), 3, wl, sink, "prompt_id", every=4)
    gate_stream.write_gate_batch(spark.createDataFrame([("new", "the", 0)], schema), 4, wl, sink, "prompt_id", every=4)
    assert gate_stream.read_gate_sink(spark, sink).filter("prompt_id = 'new'").first().position == 40 - flagged
