"""Registered queries against their SQL oracles at the smallest scale. TIDEWHEEL_ALL=1 runs every one."""

import os

import pytest
from oracle_check import compare, connect, load_entry

SF = "/root/testdata/sf0.001"
ENTRY = load_entry()
QUERIES, ORACLES = ENTRY.queries(), ENTRY.oracle_sql()
QUICK = ("energy_jumps", "onset_strength", "quiet_passages", "percentile_normalize", "exponential_smooth", "tile_means", "top_k_per_group",
         "asof_last_event", "nearest_event", "sample_linear", "offset_curve", "best_match", "cut_boundaries", "spec_findings", "next_setting",
         "rule_breaks", "scrub_text", "note_pairing", "tempo_map", "chord_lookup", "stream_levels", "vector_novelty")
NAMES = sorted(ORACLES) if os.environ.get("TIDEWHEEL_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_oracle(spark, con, name):
    ok, note, _, _ = compare(spark, con, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def test_entry_runs(spark):
    df = ENTRY.entry(spark)
    assert df.columns == ["series_id", "frame", "onset", "z"] and df.count() > 0


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)
