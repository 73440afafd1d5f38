"""No plan pairs rows without a key, runs Python row by row, or scans columns it does not need."""

import pytest

from gitstrata.operators import occurrences as occ
from gitstrata.plans import catalog
from gitstrata.sources.bindings import Tables

RUNS_ON_BUILD = ("stream_", "append_log", "copy_tables")
NAMES = [n for n in sorted(catalog.QUERIES) if not n.startswith(RUNS_ON_BUILD)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_pairing_and_no_row_python(name, spark, sf):
    text = plan(catalog.QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert "ArrowEvalPython" not in text and "InPandas" not in text


def test_scan_reads_only_what_it_needs(spark, sf):
    t = Tables(spark, sf)
    text = plan(occ.pattern_stats_light(t.f_occurrences, t.f_patterns))
    schema = [line for line in text.splitlines() if "ReadSchema" in line]
    assert schema and all("props" not in line for line in schema)


def test_filter_reaches_the_scan(spark, sf):
    t = Tables(spark, sf)
    assert "PushedFilters: [IsNotNull(ts)" in plan(t.events.filter("ts > timestamp_ntz'2024-01-20'"))


@pytest.mark.parametrize("method", ["confidence", "majority", "weighted", "best"])
def test_votes_are_dealt_once_into_parts_of_a_fixed_number(spark, sf, method):
    text = plan(catalog.QUERIES[f"consensus_{method}"](spark, sf))
    dealt = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)
