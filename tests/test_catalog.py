"""A sample of the catalog against DuckDB on the smallest tables (check.py runs all of it)."""

import duckdb
import pytest

from check import TABLES, rows_of
from conftest import SMALL
from driftloom import catalog

SAMPLE = ["txt_tokens", "txt_unescape", "src_raw_corpus", "src_parse", "num_label_flip", "str_time_order", "str_stratified_sample",
          "str_scenarios", "eng_blocked_prefix", "det_signals", "lam_SlowIncreaseFastReset", "nb_informed_rebuild",
          "nb_replay_slice", "snk_two_streams", "fus_and_cooldown", "fus_fast_set", "eva_metrics_row", "rpt_main_table", "flx_moving_average", "ss_hourly_counts"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SMALL)
    cursor = duck.execute(catalog.ORACLES[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
