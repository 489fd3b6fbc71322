"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All but the last
return the columns of ``documents``; the last returns the packed pieces.

Defined results of every stage: a null text is empty (it is not toxic by words it lacks, near to nothing, clean of
benchmark and secrets, and packs as its end mark); a very long text is judged as a whole; extra columns stay, whatever
their names and types; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.decontamination import contaminated
from quantloom.llm.minhash_dedup import near_duplicates
from quantloom.llm.packing import pack
from quantloom.llm.secret_scan import redact
from quantloom.llm.toxicity import production_model, without_toxic
from quantloom.session import shared_folder


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; rows are judged each, with a null doc_id too. The model learns from the training folds of the original table."""
    return without_toxic(docs, production_model(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, as one row; rows without a doc_id stay.

    Of rows that share a doc_id and differ the one whose text has the least hash (of equal ones the least row) stays.
    """
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    named, columns = left.where("doc_id is not null"), [F.col(f"`{c}`") for c in docs.columns]
    # Maps and variants have no order; their rows are compared as JSON.
    unordered = any(kind in f.dataType.simpleString() for f in docs.schema for kind in ("map<", "variant"))
    order = F.to_json(F.struct(*columns)) if unordered else F.struct(*columns)
    least = F.min_by(F.struct(*columns), F.struct(F.xxhash64("text"), order)) if unordered else F.min(F.struct(F.xxhash64("text").alias("hash"), order.alias("row"))).getField("row")
    one = named.groupBy("doc_id").agg(least.alias("least")).select("least.*")
    return one.union(left.where("doc_id is null"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a copy of a benchmark item go, each by its own text, with a null doc_id too."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # A row is known by its text: equal texts are contaminated alike.
    key = "text_key"
    while key in docs.columns:
        key += "_"
    rows = docs.withColumn(key, F.xxhash64("text"))
    found = contaminated(rows.select(F.col(key).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(key)).distinct()
    return rows.join(found, key, "left_anti").drop(key)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, repeated ones too; its secrets are replaced by a mark, and n_chars is counted anew where there were some."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, repeated ones each, with their sequences and places."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", near_dedup), ("benchmark_decontamination", decontaminate), ("secret_scans", secrets), ("best_fit_packing", packing)]

#: None: SQL can't express the stages; tests/llm/test_pipeline.py holds them against a brute-force version.
ORACLE_SQL = None


def inputs(spark: SparkSession, sf_dir: str) -> str:
    """A hash of the names, sizes and times of the files of the tables that the stages read."""
    path, seen = spark._jvm.org.apache.hadoop.fs.Path, hashlib.sha256()
    for table in ("documents", "labels", "benchmark"):
        top = path(f"{sf_dir}/{table}.parquet")
        files = top.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(top, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        seen.update(repr(sorted(found)).encode())
    return seen.hexdigest()[:16]


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again.

    A run that was given a ``name`` and failed goes on, if started again on the same input files, behind the last stage
    that it had written: its folder is named by a hash of the files of the tables, their sizes and times.
    Once the last stage is written the results before it are deleted.
    """
    folder = f"{shared_folder(spark)}/pipeline-{f'{name}-{inputs(spark, sf_dir)}' if name else uuid.uuid4()}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (stage_name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{stage_name}"
        if not files.exists(path(f"{out}/_SUCCESS")):
            if any(files.exists(path(f"{folder}/{later}-{n}/_SUCCESS")) for later, (n, _) in enumerate(STAGES) if later > k):
                continue
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(out)
        docs = spark.read.parquet(out)
    for k, (stage_name, _) in enumerate(STAGES[:-1]):
        files.delete(path(f"{folder}/{k}-{stage_name}"), True)
    return docs
