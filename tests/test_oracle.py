"""Queries against their SQL twins. ``GITSTRATA_ALL=1`` runs every one of them."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from gitstrata.plans import catalog
from gitstrata.sources.bindings import BASE

SOME = """global_pattern_stats pattern_stats pattern_summary pattern_timeline pattern_trends trend_summary model_performance top_detected
models_by_repository rerun_decision consensus_weighted parse_completions commit_rollup classify_commits normalize_git_url language_commit
merge_technologies append_commits simple_tags quality_report security_report performance_metrics line_patterns consolidate_evidence
all_dependencies identify_dependencies image_tools architecture_style architecture_quality import_edges diff_snapshots reanalysis_decision
compare_repositories relevant_repositories moving_average status_changes similar_vectors insights heuristic_scores heatmap dashboard
stream_timeline stream_alerts longest_candidates""".split()
NAMES = sorted(catalog.ORACLE) if os.environ.get("GITSTRATA_ALL") else SOME


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    mine = sorted(repr(tuple(plain(v) for v in row)) for row in df.select(sorted(df.columns)).collect())
    cur = duck.execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = sorted(repr(tuple(plain(row[i]) for i in order)) for row in cur.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert mine == theirs


def test_contract(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
