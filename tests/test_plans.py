"""Scale guards on physical plans: native queries stay in the JVM, big windows are bucketed, scans are pruned."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
PYTHON_NODES = ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonMapInArrow")

NATIVE = ["balanced_split", "slice_metrics", "freq_distance", "fingerprint", "merge_log_metrics", "first_writer_wins",
          "jaccard_exact", "diff_histogram", "binned_density", "dense_uid", "run_average", "flags_canonical",
          "fk_orphans", "pk_duplicates", "all_pairs", "align_pa", "exact_duplicates"]


def _plan(spark, name):
    df = entry.queries()[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_native_queries_have_no_python(spark, name):
    plan = _plan(spark, name)
    assert not any(n in plan for n in PYTHON_NODES), name


def test_rank_window_is_bucketed(spark):
    plan = _plan(spark, "shuffled_rank")
    assert "hashpartitioning(stratum" in plan and "_bucket" in plan


def test_scan_prunes_columns(spark):
    df = entry.queries()["entities_of_group"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source,src3)" in plan and "text" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["group_id", "entity", "partner", "score"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
