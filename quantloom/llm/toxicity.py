"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear in the presence of words (64-bit hashes), trained in numpy from confirmed
toxic documents and unlabelled ones.  With class prior pi, positives P and unlabelled rows U the risk is
``pi * E_P[loss(f)] + max(0, E_U[loss(-f)] - pi * E_P[loss(-f)])`` with the logistic loss; where the second
part falls below zero its gradient is reversed, so the fit can't drive the estimated risk of
negatives below zero.

The model has a weight for each word whose share among positives is above that among unlabelled rows by ``screen``
standard errors, seen in ``least`` sampled documents (two of them toxic): with some ten thousand distinct words for each
thousand documents, the rest are noise that a linear model would learn by heart.  If no word passes, the 50 of the
largest difference are in it.  This decides what the model knows, not which rows or texts are read or scored.

The fit uses bounded samples: ``positives`` toxic and ``unlabelled`` arbitrary documents of the training folds, whole,
with at most ``most_bytes`` of text each.  The prior is the share of toxic rows among the labelled ones.  The intercept is
at most that of the prior, so a text of which no word is known scores the prior or less, also where a sample is too
small to learn from.

Defined results: a null or wordless text has no words and gets the intercept's score; a null doc_id stays null and is not
learnt from, nor are labels other than 0 and 1; of contradicting labels of a doc_id 1 counts; repeated rows are scored
each.  Without confirmed examples every score is 0.  An empty table gives no rows; extra columns are ignored by
``score`` and kept by ``without_toxic``, whatever their names; of a very long text all words count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import cut
from .labelled import fold, sampled, sigmoid, texts_of, within
from .textkernel import distinct, text_chunks, words

#: The score from which a document counts as toxic.
THRESHOLD = 0.3


@dataclass(frozen=True)
class WordModel:
    words: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        out = []
        for a, b, data, offsets in text_chunks(batch):
            margin = np.full(b - a, self.intercept)
            if len(self.words):
                hashes, _, _, bounds = words(data, offsets)
                at = np.searchsorted(self.words, hashes)
                at[at == len(self.words)] = 0
                hit = np.flatnonzero(self.words[at] == hashes)
                row = np.searchsorted(bounds, hit, "right") - 1
                pairs = np.unique(row * np.int64(len(self.words)) + at[hit])
                np.add.at(margin, pairs // len(self.words), self.weights[pairs % len(self.words)])
            out.append(sigmoid(margin))
        return np.concatenate(out) if out else np.zeros(0)


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for _, _, data, offsets in text_chunks(batch):
            hashes, _, _, bounds = words(data, offsets)
            sets += [distinct(hashes[a:b]).tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), batch.column("label")], names=["doc_id", "words", "mark"])


def risk(margin: np.ndarray, n_positive: int, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of margins, first those of positives, and the direction that a step goes against: its gradient, or, where the estimated risk of negatives is below zero, that risk's gradient reversed."""
    on_p, on_u = margin[:n_positive], margin[n_positive:]
    negative = np.logaddexp(0, on_u).mean() - prior * np.logaddexp(0, on_p).mean()
    slope = np.concatenate([-prior * sigmoid(on_p) / len(on_p), sigmoid(on_u) / len(on_u)])
    if negative < 0:
        slope = -slope
    else:
        slope[:n_positive] -= prior * sigmoid(-on_p) / len(on_p)
    return float(prior * np.logaddexp(0, -on_p).mean() + max(0.0, negative)), slope


def screened(sample: DataFrame, n_positive: int, n_unlabelled: int, screen: float = 5.0, least: int = 4, few: int = 50) -> np.ndarray:
    """The words that the model has weights for, ascending, from (toxic, free, words) rows; counts are summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column("words")]
            size = [len(x) for x in sets]
            word, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
            flags = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), size) for c in ("toxic", "free")]
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), *(pa.array(np.bincount(at, weights=f, minlength=len(word)).astype(np.int64)) for f in flags)], names=["word", "toxic", "other"])

    counts = sample.mapInArrow(count, "word long, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    share = F.col("other") / n_unlabelled
    z = (F.col("toxic") / n_positive - share) / F.sqrt((share + 1 / n_unlabelled) * F.greatest(1 - share, F.lit(1e-3)) / n_positive)
    counts = counts.withColumn("z", z)
    found = counts.where((F.col("z") >= screen) & (F.col("toxic") + F.col("other") >= least) & (F.col("toxic") >= 2)).select("word").collect()
    if not found:
        found = counts.orderBy(F.desc("z"), "word").select("word").limit(few).collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


def train_nnpu(rows: list[np.ndarray], n_positive: int, prior: float, vocabulary: np.ndarray, ridge: float = 1e-4, epochs: int = 200, rate: float = 0.05) -> WordModel:
    """A model from sets of words, given by their places in ``vocabulary``; the first ``n_positive`` of confirmed toxic documents and the others unlabelled."""
    if not n_positive or n_positive == len(rows) or not prior:
        return WordModel(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    owner, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    n = len(vocabulary)
    weights, bias = np.zeros(n), math.log(prior / (1 - prior)) if prior < 1 else 5.0
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, epochs + 1):
        margin = np.bincount(owner, weights=weights[column], minlength=len(rows)) + bias
        slope = risk(margin, n_positive, prior)[1]
        grad = np.append(np.bincount(column, weights=slope[owner], minlength=n) + ridge * weights, slope.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        weights, bias = weights - step[:-1], bias - step[-1]
    # A document without a known word is no likelier toxic than any other.
    most = math.log(prior / (1 - prior)) if prior < 1 else float(bias)
    return WordModel(vocabulary, weights, min(float(bias), most))


def fit(docs: DataFrame, labels: DataFrame, pool: DataFrame, positives: int = 3000, unlabelled: int = 9000, most_bytes: int = 64 << 20) -> WordModel:
    """A model from ``labels`` (doc_id, label 0 or 1) and, as unlabelled rows, the doc_ids of ``pool``."""
    labels = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
    toxic = within(docs, sampled(labels.where("label = 1"), positives), most_bytes)
    free = within(docs, sampled(pool, unlabelled), most_bytes)
    if not toxic or not free:
        return train_nnpu([], 0, 0.0, np.zeros(0, np.uint64))
    # An id may be in both samples: it is then fetched once and used in both (bit 1: toxic, bit 2: unlabelled).
    marks = {i: (i in t) + 2 * (i in f) for t, f in [(set(toxic), set(free))] for i in [*toxic, *free]}
    sample = cut(texts_of(docs, marks).mapInArrow(_word_sets, "doc_id long, words binary, mark int"))
    sample = sample.withColumns({"toxic": F.col("mark").bitwiseAND(1) > 0, "free": F.col("mark").bitwiseAND(2) > 0})
    vocabulary = screened(sample, len(toxic), len(free))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.flatnonzero(np.isin(vocabulary, np.frombuffer(x.as_py(), np.uint64))).tobytes() for x in batch.column("words")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "words"])

    sets = {r["doc_id"]: np.frombuffer(bytes(r["words"]), np.int64) for r in sample.mapInArrow(known, "doc_id long, words binary").collect()}
    return train_nnpu([sets[i] for i in toxic] + [sets[i] for i in free], len(toxic), counts.get(1, 0) / max(1, sum(counts.values())), vocabulary)


def score(docs: DataFrame, model: WordModel) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(batch), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: WordModel) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.scores(batch) < THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def production_model(spark, docs: DataFrame, sf_dir: str) -> WordModel:
    """The model of the registered query: learnt from the training folds only."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(4) != 2).select("doc_id", F.col("toxic").alias("label"))
    return fit(docs, labels, docs.where(fold(4) != 2).select("doc_id"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, production_model(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
