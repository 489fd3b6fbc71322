"""Models as files: one JSON document a model, written and read by Spark, on any file system that it knows."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import SparkSession

from ..operators.boosting import LeafTrees, Tree
from ..operators.models import Composite, ElasticNet, Model, Ridge
from ..operators.recurrent import Recurrent

_KINDS = {c.__name__: c for c in (Composite, Ridge, ElasticNet, LeafTrees, Recurrent)}
#: What a kind is made of; the rest of its fields are settings of a fit.
_STATE = {"Composite": ("features", "weights"), "Ridge": ("features", "alpha", "coef", "intercept"), "ElasticNet": ("features", "alpha", "l1", "coef", "intercept"), "LeafTrees": ("features", "rate", "base", "edges", "trees"), "Recurrent": ("features", "kind", "length", "hidden", "scale", "weights")}


def _plain(value):
    if isinstance(value, np.ndarray):
        return [None if v == -np.inf else v for v in value.tolist()]
    if isinstance(value, Tree):
        return {k: _plain(v) for k, v in vars(value).items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _tree(cells: dict) -> Tree:
    return Tree(**{k: np.array([-np.inf if x is None else x for x in v], np.int64 if k in ("feature", "bin") else float) for k, v in cells.items()})


def save_model(spark: SparkSession, model: Model, path: str, metadata: dict | None = None) -> None:
    kind = type(model).__name__
    if kind not in _KINDS:
        raise ValueError(f"no file form of {kind}")
    state = {k: _plain(getattr(model, k)) for k in _STATE[kind]}
    spark.createDataFrame([(json.dumps({"kind": kind, "state": state, "metadata": metadata or {}}),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> tuple[Model, dict]:
    """(model, metadata); a file of another layout is an error that says what is wrong."""
    text = "".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    try:
        found = json.loads(text)
    except ValueError as error:
        raise ValueError(f"{path} holds no model: {error}") from error
    if not isinstance(found, dict) or found.get("kind") not in _KINDS or set(found.get("state", {})) != set(_STATE[found["kind"]]):
        raise ValueError(f"{path} holds no model of this package's layout")
    state = found["state"]
    if found["kind"] == "LeafTrees":
        state |= {"edges": [np.array(e) for e in state["edges"] or []], "trees": [_tree(t) for t in state["trees"]]}
    if found["kind"] == "Recurrent":
        state["weights"] = np.array(state["weights"])
    return _KINDS[found["kind"]](**state), found["metadata"]
