"""Session settings for panel work."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quantloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; on a cluster leave ``master`` and the partition count to the submitter."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: the one the cluster names in spark.checkpoint.dir; a new local one only where the master is local (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, dealt: bool = False) -> DataFrame:
    """The same rows, computed once and kept in the shared checkpoint folder, where they survive the loss of any executor; a plan of many steps is planned in parts.

    With ``dealt`` Spark goes on knowing how the rows are partitioned, so what is next done by the same key needs no shuffle; adaptive execution would hide it.
    """
    spark = df.sparkSession
    shared_folder(spark)
    # The constraints of what is cut off are of no use later, and inferring them takes time that doubles with every join.
    conf = {"spark.sql.constraintPropagation.enabled": "false"} | ({"spark.sql.adaptive.enabled": "false"} if dealt else {})
    before = {key: spark.conf.get(key, "true") for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        return (df.select("*") if dealt else df).checkpoint(eager=True)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
