"""Writers and readers of run artifacts."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, is_dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def downcast(df: DataFrame) -> DataFrame:
    """Doubles as floats, for files that are only read by models."""
    return df.withColumns({f.name: F.col(f.name).cast("float") for f in df.schema if f.dataType.simpleString() == "double"})


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None, compact: bool = False) -> None:
    writer = (downcast(df) if compact else df).write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One file with a header, for small report tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_document(value, path: str) -> None:
    """A small nested document; dates and numpy scalars as text and numbers."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    plain = asdict(value) if is_dataclass(value) else value
    Path(path).write_text(json.dumps(plain, indent=2, sort_keys=True, default=lambda x: x.item() if hasattr(x, "item") else str(x)))


def config_key(config) -> str:
    """A short digest of a configuration: caches are keyed by it, not by a run's name."""
    plain = asdict(config) if is_dataclass(config) else config
    return hashlib.sha256(json.dumps(plain, sort_keys=True, default=str).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, config, build) -> DataFrame:
    """The table of this configuration: read if it is there, else built and written."""
    path = f"{folder}/{config_key(config)}"
    try:
        return spark.read.parquet(path)
    except Exception as absent:
        if "PATH_NOT_FOUND" not in str(absent):
            raise
    write_parquet(build(), path)
    return spark.read.parquet(path)


def markdown(rows: list[dict], digits: int = 4) -> str:
    """A markdown table of a few collected rows."""
    if not rows:
        return ""
    show = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    names = list(rows[0])
    return "\n".join(["| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows)])
