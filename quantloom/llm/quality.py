"""Quality scores from compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text.  Every passage of a text (``CHUNK``
bytes, so that the dictionaries matter all along a long text) is compressed with both; the difference of the sizes,
over the bytes of the whole text, is the feature, and a logistic curve fitted on other labelled rows turns it
into a probability.

The fit uses bounded samples of labelled rows: ``per_label`` documents of each label for the dictionaries and
``calibration`` others for the curve, each of them whole, with at most ``most_bytes`` of text a label and purpose.

Defined results: a null or empty text has feature 0; a null doc_id stays null and is not learnt from, nor are labels
other than 0 and 1; of contradicting labels of a doc_id 1 counts; repeated rows are scored each.  Without rows of both
labels every score is the share of label 1 (0.5 without labels).  An empty table gives no rows; extra columns are
ignored, whatever their names; of a very long text all passages count, one after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, platt, sampled, texts_of, within
from .textkernel import mix64, string_bytes

CHUNK = 512


def _passages(text: bytes) -> list[bytes]:
    return [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]


@dataclass(frozen=True)
class CompressionModel:
    """The dictionaries of bad and good text, and the curve."""

    bad: bytes
    good: bytes
    slope: float
    intercept: float
    level: int = 3

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        plain = {"level": self.level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (self.bad, self.good)]

    def feature(self, compressors: list[zstandard.ZstdCompressor], text: bytes) -> float:
        if not text:
            return 0.0
        bad, good = compressors
        return sum(len(bad.compress(p)) - len(good.compress(p)) for p in _passages(text)) / len(text)


def _features(model: CompressionModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors() if model.good else None
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            raw = data.tobytes()
            rows = [model.feature(compressors, raw[a:b]) if compressors else 0.0 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.float64())], names=["doc_id", "feature"])

    return run


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 1500, calibration: int = 4000, most_bytes: int = 32 << 20, size: int = 1 << 16) -> CompressionModel:
    """A model from ``labels`` (doc_id, label 0 or 1; other values and nulls are ignored)."""
    labels = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = {q: sampled(labels.where(F.col("label") == q), per_label + calibration // 2) for q in (0, 1)}
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    flat = CompressionModel(b"", b"", 0.0, math.log((share + 1e-6) / (1 - share + 1e-6)))
    # Of few rows, two thirds go to the dictionaries.
    cut = {q: min(per_label, (2 * len(x) + 2) // 3) for q, x in ids.items()}
    train = {i: q for q, x in ids.items() for i in within(docs, x[: cut[q]], most_bytes)}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            raw = data.tobytes()
            parts = [_passages(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            of = np.repeat(batch.column(2).to_numpy(), [len(p) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array([x for p in parts for x in p], pa.binary())], names=["label", "passage"])

    if not ids[0] or not ids[1]:
        return flat
    rows = texts_of(docs, train).select("doc_id", "text", "label").mapInArrow(pick, "label int, passage binary").collect()
    dictionaries = []
    for q in (0, 1):
        parts = sorted(bytes(r["passage"]) for r in rows if r["label"] == q)
        # Neighbours in the order of texts go apart, so that the trainer sees all kinds of text early.
        parts = [parts[k] for k in np.argsort(mix64(np.arange(len(parts), dtype=np.uint64)), kind="stable").tolist()]
        try:
            dictionaries.append(zstandard.train_dictionary(size, parts, level=3).as_bytes())
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            dictionaries.append(b"".join(parts)[-size:] or b"\x00" * 8)
    raw = CompressionModel(*dictionaries, 1.0, 0.0)
    rest = {i: q for q, x in ids.items() for i in within(docs, x[cut[q] : cut[q] + calibration // 2], most_bytes)}
    if len(set(rest.values())) < 2:
        rest = train
    # The samples hold equal numbers of both labels at most; weights by repetition would be the same as this shift of the intercept.
    rows = texts_of(docs, rest).select("doc_id", "text").mapInArrow(_features(raw), "doc_id long, feature double").collect()
    if not rows:
        return flat
    y = np.array([rest[r["doc_id"]] for r in rows], float)
    slope, intercept = platt(np.array([r["feature"] for r in rows]), y)
    if 0 < y.mean() < 1:
        intercept += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return CompressionModel(*dictionaries, slope, intercept)


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_features(model), "doc_id long, feature double")
    return found.select("doc_id", (1 / (1 + F.exp(-(F.col("feature") * model.slope + model.intercept)))).alias("score"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(3) != 1).select("doc_id", F.col("quality").alias("label"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
