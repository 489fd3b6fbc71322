"""Run configurations and the store of runs.

A run is known by a digest of its configuration and of the files that it reads, so the same question finds the same run.  Its tables are written
to a pending folder and the whole is renamed once the manifest is there: a run is either complete or absent, on any file system
with an atomic rename of folders.  A finished run is read, not computed; its evaluation can be made again from the stored predictions.
"""

from __future__ import annotations

import copy
import hashlib
import json
import time
import tomllib
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .sinks import config_key

#: The settings of a run and their defaults.
DEFAULTS = {
    "run": {"name": "baseline", "seed": 42},
    "data": {"start": "2010-01-01", "end": "2026-06-30", "max_assets": 250, "min_price": 5.0, "min_history_days": 500, "min_names_per_date": 30},
    "features": {"winsorize_q": 0.01, "standardise": "zscore", "neutralise": "none"},
    "label": {"type": "forward_excess_return", "horizon": 21, "scale_by_volatility": False, "beta_adjusted": False},
    "validation": {"n_splits": 6, "embargo_days": 21, "train_window_days": 1260, "test_window_days": 252, "expanding": False},
    "models": {"enabled": ["factor_composite", "ridge", "elasticnet", "trees", "ensemble"], "ridge": {"alpha": 10.0}, "elasticnet": {"alpha": 0.001, "l1": 0.5}, "trees": {}},
    "portfolio": {"method": "rank_long_short", "n_long": 25, "n_short": 25, "max_weight": 0.06, "vol_target": 0.10, "rebalance_days": 21},
    "backtest": {"cost_bps": 5.0, "slippage_bps": 2.0, "borrow_bps": 50.0, "turnover_cap": 0.25},
    "evaluation": {"trials": 60, "bootstrap_samples": 1000, "pbo_splits": 8},
}
#: What a smoke run changes.
SMOKE = {"data": {"max_assets": 30, "start": "2019-01-01"}, "validation": {"n_splits": 2, "train_window_days": 400, "test_window_days": 126}, "models": {"trees": {"rounds": 60}}, "evaluation": {"bootstrap_samples": 100}, "portfolio": {"n_long": 6, "n_short": 6}}
#: Settings whose entries are free.
_FREE = ("ridge", "elasticnet", "trees", "gru")


def merged(base: dict, more: dict, where: str = "") -> dict:
    """``base`` with the settings of ``more``; an unknown one, or one of another kind, is an error that names it."""
    out = copy.deepcopy(base)
    for key, value in more.items():
        name = f"{where}{key}"
        if key not in base and where.rstrip(".").rsplit(".", 1)[-1] not in _FREE and key not in _FREE:
            raise ValueError(f"unknown setting {name}")
        old = base.get(key)
        if isinstance(old, dict) != isinstance(value, dict) and key in base:
            raise ValueError(f"setting {name} is {'a group' if isinstance(old, dict) else 'a value'}")
        if isinstance(value, dict):
            out[key] = merged(old or {}, value, f"{name}.") if isinstance(old, dict) else copy.deepcopy(value)
        else:
            numbers = isinstance(old, (int, float)) and isinstance(value, (int, float)) and isinstance(old, bool) == isinstance(value, bool)
            if old is not None and not numbers and type(old) is not type(value):
                raise ValueError(f"setting {name} should be {type(old).__name__}, is {type(value).__name__}")
            out[key] = value
    return out


def load_config(path: str) -> dict:
    """The defaults with the settings of a TOML or JSON file."""
    text = Path(path).read_text(encoding="utf-8")
    return merged(DEFAULTS, json.loads(text) if path.endswith(".json") else tomllib.loads(text))


def smoke(config: dict) -> dict:
    """A small run of the same kind, under a name of its own."""
    out = merged(config, SMOKE)
    for section, key in (("data", "max_assets"),):
        out[section][key] = min(config[section][key], SMOKE[section][key])
    out["run"]["name"] = f"{config['run']['name']}_smoke"
    return out


class RunStore:
    """Runs below a folder, on the file system of its path."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def fingerprint(self, inputs: list[str]) -> str:
        """A digest of the names, sizes and times of the files of the inputs."""
        seen = []
        for name in inputs:
            top = self._path(name)
            found = top.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(top, True)
            while found.hasNext():
                f = found.next()
                seen.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:16]

    def key(self, config: dict, inputs: list[str]) -> str:
        return config_key({"config": {k: v if k != "run" else {x: y for x, y in v.items() if x != "name"} for k, v in config.items()}, "inputs": self.fingerprint(inputs)})

    def exists(self, key: str) -> bool:
        return self._files.exists(self._path(f"{self.folder}/{key}/manifest.json"))

    def run(self, config: dict, inputs: list[str], build: Callable[[], tuple[dict[str, DataFrame], dict]]) -> str:
        """The key of the run; ``build`` (its tables, and facts for the manifest) is called only if the store has no complete one.

        Of two that finish at once the first to rename stays, and the other's tables are dropped.
        """
        key = self.key(config, inputs)
        if self.exists(key):
            return key
        began, pending = time.time(), f"{self.folder}/_pending-{key}-{time.time_ns()}"
        tables, facts = build()
        for name, table in tables.items():
            table.write.parquet(f"{pending}/{name}")
        manifest = {"key": key, "name": config["run"]["name"], "config": config, "inputs": inputs, "tables": {n: [f"{f.name} {f.dataType.simpleString()}" for f in t.schema] for n, t in tables.items()}, "facts": facts, "seconds": round(time.time() - began, 3), "finished": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
        out = self._files.create(self._path(f"{pending}/manifest.json"))
        out.write(bytearray(json.dumps(manifest, indent=2, sort_keys=True, default=str).encode()))
        out.close()
        if self.exists(key) or not self._files.rename(self._path(pending), self._path(f"{self.folder}/{key}")):
            self._files.delete(self._path(pending), True)
            if not self.exists(key):
                raise RuntimeError(f"run {key} could not be committed")
        return key

    def manifest(self, key: str) -> dict:
        if not self.exists(key):
            raise FileNotFoundError(f"no complete run {key} in {self.folder}")
        return json.loads("\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.folder}/{key}/manifest.json").collect()))

    def table(self, key: str, name: str) -> DataFrame:
        known = self.manifest(key)["tables"]
        if name not in known:
            raise KeyError(f"run {key} has no table {name!r}; it has {sorted(known)}")
        return self.spark.read.parquet(f"{self.folder}/{key}/{name}")

    def runs(self, name: str | None = None) -> list[dict]:
        """Manifests of the complete runs, the last finished first."""
        if not self._files.exists(self._path(self.folder)):
            return []
        keys = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder))]
        found = [self.manifest(k) for k in keys if not k.startswith("_") and self.exists(k)]
        return sorted((m for m in found if name in (None, m["name"])), key=lambda m: (m["finished"], m["key"]), reverse=True)

    def reevaluated(self, key: str, evaluate: Callable[[DataFrame], DataFrame], table: str = "predictions") -> DataFrame:
        """An evaluation of a stored table; nothing is fitted."""
        return evaluate(self.table(key, table))
