"""Plan shapes that must hold at any scale."""

import re

import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
BATCH = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline", n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, ROOT))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|BatchEvalPython|ArrowEvalPython", text)


def test_columns_are_pruned_and_filters_pushed(spark):
    text = plan(entry.queries()["ag5_window_changes"](spark, ROOT))
    assert "value" not in re.findall(r"ReadSchema: (\S+)", text)[0]
    assert re.search(r"PushedFilters: \[.*c_mktsegment", text)


def test_rank_limits_run_before_the_shuffle(spark):
    for name in ("wn2_recent_list", "wn4_filing_page", "ag18_weekly_themes"):
        assert "WindowGroupLimit" in plan(entry.queries()[name](spark, ROOT)), name


def test_classification_is_a_projection(spark):
    assert "Exchange" not in plan(entry.queries()["fn4_classify_titles"](spark, ROOT))


def test_an_upsert_reads_only_open_days(spark, tmp_path, monkeypatch):
    from docketry.sources import partitions as pt

    rows = spark.createDataFrame([(f"2026-01-0{d}", d, d) for d in range(1, 6)], "day string, k int, seq int")
    pt.upsert_day(spark, str(tmp_path), rows, "k", "seq", "2026-01-01")
    plans, inner = [], pt.cut_lineage
    monkeypatch.setattr(pt, "cut_lineage", lambda df, label: plans.append(plan(df)) or inner(df, label))
    pt.upsert_day(spark, str(tmp_path), rows.where("day = '2026-01-05'"), "k", "seq", "2026-01-05")
    assert re.search(r"PartitionFilters: \[[^\]]*day#\d+ >= 2026-01-05", plans[-1])
