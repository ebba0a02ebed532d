"""Registered queries against their SQL twins in DuckDB, on the smallest tables."""

import datetime
import math
from collections import Counter

import duckdb
import pytest

from barwright.plans.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.8g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


#: A spread over the modules; the whole registry is compared at a larger scale outside the unit tests.
CHOSEN = [
    "flagship", "cln2_forward_fill", "cln4_time_interpolation", "val1_validate_bars", "jn1_asof_join", "jn1_asof_forward_chunked", "jn7_9_event_flags", "agg1_ohlcv", "agg2_filled_grid", "win2_ewm",
    "win3_ema_sma_seed", "win9_adx", "win16_rolling_corr", "book1_rebuild", "book8_ofi", "book13_walk", "lab1_triple_barrier", "spl2_walk_forward", "btk1_extract_trades", "btk2_next_open", "btk3_same_open",
    "prf1_performance", "prf3_psr", "prf8_hotswap", "rst4_cost_grid", "rst5_gauntlet_report", "rsk1_circuit_breaker", "rsk6_exit_reason", "xas1_corr_edges", "ml6_conformal", "ml7_niche_share",
]


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    rows = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    assert got == rows


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
