"""Registered queries against their SQL on the smallest tables, and the plans of the main ones."""

from __future__ import annotations

import check_queries
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
HEAVY = {"lane_build", "ingest_faces", "review_list", "best_head", "privacy_summary"}


@pytest.fixture(scope="module")
def con(sf):
    return check_queries.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    result = check_queries.compare(QUERIES[name](spark, sf), con, ORACLES[name])
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - HEAVY))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


NO_PAIRS = ["merged_person_ranges", "frames_to_mask", "points_in_ranges", "range_overlap_score", "nearest_anchor", "lane_at_time",
            "nearest_gap", "active_clips", "preserved_anti", "box_overlap_pairs", "infer_source", "recover_jobs", "combine"]


@pytest.mark.parametrize("name", [n for n in NO_PAIRS if n in QUERIES])
def test_no_nested_loops(spark, sf, name):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_merge_takes_two_shuffles(spark, sf):
    plan = QUERIES["merged_person_ranges"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
