"""Plan checks: the physical plans are the ones we want at scale."""

import re

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_global_index_single_partition_only_over_bucket_counts(spark):
    plan = _plan(E.queries()["exact_split"](spark, SF_SMALL))
    lines = plan.split("\n")
    single = [i for i, l in enumerate(lines) if "Exchange SinglePartition" in l]
    assert single, plan
    for i in single:
        assert re.search(r"HashAggregate\(keys=\[_b", lines[i + 1]), lines[i + 1]
    assert re.search(r"Exchange hashpartitioning\(_b", plan)


def test_scan_prunes_columns_and_pushes_filters(spark):
    plan = _plan(E.queries()["read_parquet"](spark, SF_SMALL))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "text" not in schema and "n_chars" in schema
    plan = _plan(E.queries()["flag_prompts"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in plan


def test_codec_is_one_arrow_map_and_no_row_udf(spark):
    plan = _plan(E.queries()["shift_pair"](spark, SF_SMALL))
    assert plan.count("MapInArrow") == 1
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize("key", ["cross_entropy", "softmax", "repetition_penalty", "pad_or_cut", "loss_tokens",
                                 "early_stop", "best_checkpoints", "length_filter", "split_words",
                                 "checkpoint_name"])
def test_expression_operators_stay_in_the_jvm(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert not re.search(r"Python|ArrowEval|MapInArrow|MapInPandas", plan), plan


@pytest.mark.parametrize("key", ["global_index", "exact_split", "epoch_shuffle", "rank_shards", "length_summary",
                                 "length_histogram", "add_tokens", "check_added", "lookup_piece", "stopword_coverage",
                                 "flag_prompts", "force_prompt", "nucleus_filter", "sample_token", "build_batches"])
def test_no_cartesian_or_nested_loop_join(spark, key):
    plan = _plan(E.queries()[key](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, plan


def test_stored_length_filter_reaches_the_scan(spark):
    from tokenmill.operators import codec, columns, vocab
    from tokenmill.plans import fixtures as fx
    from tokenmill.session import scratch_path
    docs = fx.text(spark, SF_SMALL)
    v = fx.charvocab(spark, SF_SMALL)
    path = scratch_path(spark, "t_len")
    codec.tokenize_text(docs, v, out="ids", length_col="n_tokens").write.parquet(path)
    f = columns.length_filter(spark.read.parquet(path), "ids", 0, 2000, length_col="n_tokens")
    plan = _plan(f)
    assert "GreaterThanOrEqual(n_tokens,0)" in plan and "LessThanOrEqual(n_tokens,2000)" in plan
    assert f.count() == spark.read.parquet(path).filter("size(ids) <= 2000").count()
