"""Vendor files with failures, tables of pages, configurations and the run store."""

import datetime
import json

import pytest

from quantloom.sources import panel, runs, vendor


def test_vendor_files(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02 00:00:00-05:00,1,2,1,1.5,10\n2020-01-03,1,2,1,2.5,10\n2020-01-03,1,2,1,2.0,11\n2020-01-06,1,2,1,0,10\n2020-01-07,1,2,1,3,-1\nbad,1,1,1,1,1\n2020-01-08,1,2,1,,5\n")
    (tmp_path / "BBB.csv").write_text(" date ,OPEN,high,low,Adj Close,volume\n2019-05-01,1,1,1,7,0\n2020-02-03,1,1,1,8,0\n")
    (tmp_path / "CCC.csv").write_text("Date,Open,Close\n2020-01-02,1,2\n")
    (tmp_path / "DDD.csv").write_text("\n")
    (tmp_path / "EEE.csv").write_text("Date,Open,High,Low,Close,Volume\n2010-01-04,1,1,1,1,1\n")
    (tmp_path / "ZZZ.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,1,1,1,1\n")
    (tmp_path / "note.txt").write_text("no prices")
    wanted = spark.createDataFrame([(t,) for t in ("AAA", "BBB", "CCC", "DDD", "EEE", "GONE", "AAA")], "ticker string")
    rows, report = vendor.vendor_prices(spark, str(tmp_path), wanted, "2020-01-01", "2020-12-31")
    d = datetime.date
    assert sorted(map(tuple, rows.select("ticker", "date", "close", "volume").collect())) == [("AAA", d(2020, 1, 2), 1.5, 10.0), ("AAA", d(2020, 1, 3), 2.0, 11.0), ("BBB", d(2020, 2, 3), 8.0, 0.0)]
    got = {r["ticker"]: r for r in report.collect()}
    assert {t: r["status"] for t, r in got.items()} == {"AAA": "read", "BBB": "read", "CCC": "failed", "DDD": "failed", "EEE": "failed", "GONE": "absent"}
    assert "missing columns: high, low, volume" in got["CCC"]["error"] and "EmptyData" in got["DDD"]["error"] and got["EEE"]["error"] == "no rows in the range"
    assert (got["AAA"]["n_rows"], got["AAA"]["first"], got["AAA"]["last"], got["AAA"]["error"]) == (2, d(2020, 1, 2), d(2020, 1, 3), None)
    one = vendor.coverage(report).first()
    assert (one["n_requested"], one["n_read"], one["n_failed"], one["coverage"], one["failed_tickers"]) == (6, 2, 4, 0.3333, ["CCC", "DDD", "EEE", "GONE"])


PAGE = """<html><table class=x><tr><th>Symbol<th>Security</th><th>GICS Sector</th></tr>
<tr><td><a href=/>BRK.B</a></td><td>Berk &amp; Co<br>Inc</td><td rowspan=2>Finance</td></tr><tr><td> aapl </td><td>Apple</td></tr><tr><td>NEW</td><td>N<table><tr><td>inner</td></tr></table></td><td>Tech</td></tr></table>
<table><thead><tr><th rowspan="2">Date</th><th colspan="2">Added</th><th colspan="2">Removed</th><th rowspan=2>Reason</th></tr><tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr></thead>
<tr><td rowspan="2">March 5, 2021</td><td>NEW</td><td>New Co</td><td>OLD.A</td><td>Old Co</td><td>size</td></tr><tr><td></td><td></td><td>GONE</td><td>Gone Co</td><td>bought</td></tr>
<tr><td>soon</td><td>XX</td></tr><tr><td>2020-06-01</td><td>AAPL</td><td>a</td><td>not a ticker!</td><td>b</td><td>c</td></tr></table>"""


def test_tables_of_pages(spark, tmp_path):
    names, grid = vendor.table_grids(PAGE)[0]
    assert names == ["Symbol", "Security", "GICS Sector"] and grid[1] == ["aapl", "Apple", "Finance"] and grid[0][1] == "Berk & Co Inc"
    assert vendor.table_grids(PAGE)[1] == (["0"], [["inner"]])
    names, grid = vendor.table_grids(PAGE)[2]
    assert names == ["Date", "Added_Ticker", "Added_Security", "Removed_Ticker", "Removed_Security", "Reason"]
    assert grid[1] == ["March 5, 2021", "", "", "GONE", "Gone Co", "bought"] and grid[2] == ["soon", "XX", None, None, None, None]
    assert vendor.table_grids("<table><tr><td rowspan=0>a<td>b<tr><td>c</table>")[0][1] == [["a", "b"], ["a", "c"]]
    assert vendor.table_grids("no table") == [] and vendor.table_grids("<table></table>") == [([], [])]
    (tmp_path / "page.html").write_text(PAGE.replace("N<table><tr><td>inner</td></tr></table>", "N"))
    current, changes = vendor.constituents(vendor.page_tables(spark, str(tmp_path / "page.html")))
    assert sorted(map(tuple, current.collect())) == [("AAPL", "Apple", "Finance"), ("BRK-B", "Berk & Co Inc", "Finance"), ("NEW", "N", "Tech")]
    assert sorted(map(tuple, changes.collect()), key=str) == [(datetime.date(2020, 6, 1), "AAPL", None), (datetime.date(2021, 3, 5), "NEW", "OLD-A"), (datetime.date(2021, 3, 5), None, "GONE")]
    snaps = spark.createDataFrame([(datetime.date(2020, 1, 1),), (datetime.date(2021, 1, 1),), (datetime.date(2022, 1, 1),)], "date date")
    members = {}
    for r in panel.membership(current, changes, snaps).collect():
        members.setdefault(r["date"].year, set()).add(r["ticker"])
    assert members == {2020: {"BRK-B", "OLD-A", "GONE"}, 2021: {"BRK-B", "AAPL", "OLD-A", "GONE"}, 2022: {"BRK-B", "AAPL", "NEW"}}


def test_configurations(tmp_path):
    (tmp_path / "c.toml").write_text('[run]\nname = "mine"\n[validation]\nn_splits = 3\n[models.trees]\nrounds = 10\n[backtest]\ncost_bps = 4\n')
    config = runs.load_config(str(tmp_path / "c.toml"))
    assert config["run"] == {"name": "mine", "seed": 42} and config["validation"]["n_splits"] == 3 and config["models"]["trees"] == {"rounds": 10} and config["backtest"]["cost_bps"] == 4
    small = runs.smoke(config)
    assert small["run"]["name"] == "mine_smoke" and small["validation"]["n_splits"] == 2 and small["models"]["trees"]["rounds"] == 60 and config["validation"]["n_splits"] == 3
    (tmp_path / "c.json").write_text(json.dumps({"data": {"max_assets": 20}}))
    assert runs.smoke(runs.load_config(str(tmp_path / "c.json")))["data"]["max_assets"] == 20
    for bad, words in (({"data": {"universe": 1}}, "data.universe"), ({"run": 3}, "run"), ({"label": {"horizon": "long"}}, "label.horizon"), ({"data": {"max_assets": True}}, "max_assets")):
        with pytest.raises(ValueError, match=words):
            runs.merged(runs.DEFAULTS, bad)


def test_run_store(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "runs"))
    data = tmp_path / "in"
    spark.range(5).write.parquet(str(data))
    config, calls = runs.merged(runs.DEFAULTS, {}), []

    def build():
        calls.append(1)
        return {"predictions": spark.read.parquet(str(data)).selectExpr("id", "id * 2 as score")}, {"rows": 5}

    key = store.run(config, [str(data)], build)
    assert store.run(config | {"run": {"name": "other", "seed": 42}}, [str(data)], build) == key and len(calls) == 1
    assert store.table(key, "predictions").count() == 5 and store.manifest(key)["facts"] == {"rows": 5} and store.manifest(key)["tables"]["predictions"] == ["id bigint", "score bigint"]
    other = store.run(runs.merged(config, {"label": {"horizon": 5}}), [str(data)], build)
    assert other != key and len(calls) == 2 and {m["key"] for m in store.runs("baseline")} == {key, other} and store.runs("none") == []
    assert store.reevaluated(key, lambda rows: rows.groupBy().sum("score")).first()[0] == 20

    def failing():
        return {"a": spark.range(3), "b": spark.range(1).selectExpr("assert_true(id > 5)")}, {}

    with pytest.raises(Exception):
        store.run(runs.merged(config, {"label": {"horizon": 7}}), [str(data)], failing)
    assert len(store.runs()) == 2 and not any(p.name.startswith(store.key(runs.merged(config, {"label": {"horizon": 7}}), [str(data)])) for p in (tmp_path / "runs").iterdir())
    spark.range(9).write.mode("overwrite").parquet(str(data))
    assert store.run(config, [str(data)], build) != key and len(calls) == 3  # other input files, another run
    with pytest.raises(KeyError):
        store.table(key, "weights")
    with pytest.raises(FileNotFoundError):
        store.manifest("nothing")


def test_models_as_files(spark, tmp_path):
    import numpy as np

    from quantloom.operators import boosting, models, recurrent
    from quantloom.sources import artifacts

    rng = np.random.default_rng(1)
    rows = [(datetime.date(2020, 1, 1) + datetime.timedelta(days=i // 4), f"T{i % 4}", float(a), float(b), float(2 * a - b)) for i, (a, b) in enumerate(rng.normal(size=(160, 2)))]
    df = spark.createDataFrame(rows, "date date, ticker string, a double, b double, y double").cache()
    fitted = [models.Ridge(["a", "b"]).fit(df, "y"), models.ElasticNet(["a", "b"]).fit(df, "y"), models.Composite(["a"], {"a": -1.0}), boosting.LeafTrees(["a", "b"], rounds=3, least=10, depth=3).fit(df, "y"), recurrent.Recurrent(["a", "b"], length=2, hidden=3, epochs=1, batch=80).fit(df, "y")]
    for k, model in enumerate(fitted):
        artifacts.save_model(spark, model, str(tmp_path / f"m{k}"), {"k": k})
        again, known = artifacts.load_model(spark, str(tmp_path / f"m{k}"))
        assert type(again) is type(model) and known == {"k": k}
        p, q = ([r["p"] for r in m.predict(df, "p").orderBy("date", "ticker").collect()] for m in (model, again))
        assert p == q and len(set(p)) > 1
    for bad in ('{"kind": "Ridge", "state": {}}', "not json", '{"kind": "Other"}', "[]"):
        spark.createDataFrame([(bad,)], "value string").write.mode("overwrite").text(str(tmp_path / "bad"))
        with pytest.raises(ValueError, match="holds no model"):
            artifacts.load_model(spark, str(tmp_path / "bad"))


def test_experiment_and_report(spark, tmp_path, capsys):
    import os

    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test data")
    from quantloom import cli
    from quantloom.plans import experiment

    config = {"run": {"name": "small"}, "label": {"horizon": 4}, "validation": {"n_splits": 2, "train_window_days": 60, "test_window_days": 20}, "models": {"enabled": ["factor_composite", "ridge", "ensemble"]}, "portfolio": {"n_long": 5, "n_short": 5}, "evaluation": {"bootstrap_samples": 50, "pbo_splits": 2}}
    config = runs.merged(runs.DEFAULTS, config)
    store = runs.RunStore(spark, str(tmp_path / "runs"))
    key = experiment.run(spark, "/root/testdata/sf0.01", config, store)
    assert experiment.run(spark, "/root/testdata/sf0.01", config, store) == key and len(store.runs("small")) == 1
    found = experiment.bundle(store, key)
    assert {r["model"] for r in found["performance"]} == {"factor_composite", "ridge", "ensemble"} == {r["model"] for r in found["metrics"]}
    text = experiment.report(store, key)
    assert all(f"## {s}" in text for s in ("Forecasts", "Books after costs", "Significance", "Features", "Folds")) and "Verdict:" in text and "| ridge |" in text
    cli.main(["runs", str(tmp_path / "runs")])
    assert key in capsys.readouterr().out


def test_small_helpers(spark):
    from quantloom.operators import quality, serving

    rows = spark.createDataFrame([("r", "A", {"x": 1.0}), ("r", "B", {"y": 2.0}), ("s", "C", {"x": 1.0, "y": 1.0})], "request string, ticker string, features map<string,double>")
    got = sorted(tuple(r) for r in serving.score_warnings(serving.batch_score(rows, {"x": 2.0, "y": 1.0}), 2).collect())
    assert got == [("r", "A: 1 of 2 features missing, filled with 0"), ("r", "B: 1 of 2 features missing, filled with 0"), ("s", "a single score has no rank: the model orders names of a date")]
    day = datetime.date(2020, 1, 1)
    table = spark.createDataFrame([(day, "A", 1.0), (day, "B", None), (day + datetime.timedelta(days=1), "A", None)], "date date, ticker string, x double")
    assert sorted(tuple(r) for r in quality.names_mask(table, "x", 1).collect()) == [(day, True), (day + datetime.timedelta(days=1), False)]
    assert tuple(quality.feature_summary(table, ["x"]).first()) == (3, 1, 2, day, day + datetime.timedelta(days=1), 1.5)
    with pytest.raises(ValueError):
        panel.resolve_universe("index")
    assert [r[0] for r in panel.resolve_universe("file", spark.createDataFrame([("A",), ("A",)], "ticker string"))[0].collect()] == ["A"]
    factors = spark.createDataFrame([(day, 0.1, 0.001), (day + datetime.timedelta(days=2), 0.2, 0.002)], "date date, mkt double, rf double")
    momentum = spark.createDataFrame([(day, 0.5)], "date date, mom double")
    assert [tuple(r)[1:] for r in panel.factor_returns(factors, momentum, "2020-01-01", "2020-01-02").collect()] == [(0.1, 0.001, 0.5)]
    market = spark.createDataFrame([(day + datetime.timedelta(days=k), 0.0) for k in (-1, 0, 1, 2)], "date date, mkt_return double")
    assert [r["rf_rate"] for r in panel.with_risk_free(market, factors).orderBy("date").collect()] == [0.0, 0.001, 0.001, 0.002]
    assert {r["rf_rate"] for r in panel.with_risk_free(market).collect()} == {0.02 / 252}
