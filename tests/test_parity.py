"""Every registered query against its SQL, and the skew paths against the same SQL."""

import pytest

from stepfold.suite import ORACLES, QUERIES
from tests.oracle import compare

ITERATIVE = {"ordered_merges", "ordered_merge_library", "plan_merges", "reduce_to_limit", "step_groups_similar"}  # tested in test_algorithms
SPLIT = [
    "discounted_returns", "gigpo_advantage", "grpo_advantage", "passk_advantage", "reinforce_pp", "gae", "place_reward",
    "pairwise_accuracy", "latency_report_interpolated", "best_worst_at_n", "stratified_split", "expand_sqrt", "pad_to_divisor",
    "recent_history", "token_budget_prefix", "balanced_partitions", "kl_controller", "renumber_by_string", "resolve_category",
    "infer_benchmark", "pass_at_k", "loss_spans", "dense_batch_topk", "purchase_reward",
]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ITERATIVE))
def test_query(spark, con, name):
    assert compare(spark, con, name, "0.001") is None


@pytest.mark.parametrize("name", SPLIT)
def test_split_groups(spark, con, hot, name):
    assert compare(spark, con, name, "0.001") is None


def test_contract():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
