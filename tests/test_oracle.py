"""Registered queries against their SQL on the smallest tables. A selection by default; SIGFRAME_ALL=1 runs all."""

import os

import duckdb
import pytest

from sigframe import catalog
from verify import TABLES, compare

SMALL = "/root/testdata/sf0.001"
PICK = """clicks_per_stream rms_envelope pcm_convert shrink change_mask duplicate_patterns timeline next_on_free_row ensure_unique
visit_scan archive_candidates collect_outputs validate_cue tree_signature polar_slerp ulaw_alaw decode_bytes running_limiter resample_sinc
argmin_bin eq6 cross_echo route_controls envelope_at append_cells meter reblock late_rows enhance decode_layout probe_heads decode_more_headers
effect_previous_row effect_converted volume_effect_converted follower_blocks running_status_blocks sessions nearest_direction dft_any_length resonant_classic""".split()
catalog.load()
NAMES = list(catalog.QUERIES) if os.environ.get("SIGFRAME_ALL") else PICK


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    status, _, note = compare(spark, con, name, SMALL)
    assert status in ("OK", "ROWS", "OK-EMPTY"), note


def test_registry_is_complete():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) == len(catalog.SURVEY_IDS)
