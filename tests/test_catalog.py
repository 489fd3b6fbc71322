"""A few registered queries against their oracle SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quantloom.plans import catalog

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")


def clean(v):
    return (None if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


SMALL = ["bars", "ret_w", "winsor_z", "triple_barrier", "rank_ls_weights", "ic_momentum", "factor_sweep", "oscillators", "overfit_probability", "risk_summary", "ridge_walk_forward", "walk_forward_metrics", "split_gains", "bootstrap_summary", "permutation_summary", "har_forecasts", "variance_losses", "rolling_exposures", "label_variants", "diagnostics_summary", "monthly_table", "deflated_sharpe", "market_risk_free", "factor_attribution", "backtest_book", "stored_run_metrics"]
TABLES = ["ladder_table", "fold_ic", "prediction_metrics", "ic_hac", "name_correlation", "trading_costs", "mean_losses", "signal_zscore", "mean_scores", "aligned_benchmark"]


@pytest.mark.parametrize(("data", "name"), [(DATA, n) for n in SMALL + TABLES] + [(LARGER, "winsor_z"), (LARGER, "feature_table")])
def test_oracle(spark, data, name):
    con = duckdb.connect()
    for t in ("region", "nation", "supplier", "lineitem", "part", "events"):
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted((tuple(map(clean, r)) for r in want.fetchall()), key=str)
    assert sorted((tuple(map(clean, r)) for r in got.select(*want.columns).collect()), key=str) == rows
