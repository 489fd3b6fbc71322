"""Threshold-scaled document fingerprints.

A fingerprint keeps every five-word shingle hash below a fixed fraction (``1/SCALE``) of the hash space,
so sketches of texts of any lengths can be compared, and merged by union.  It is written as
``<set size>.<set digest>.<base64 of the kept hashes>``: texts with equal shingle sets, and so equal
texts, have equal fingerprints.

Defined results: a null text is empty; an empty or wordless text has ``0.0.``, which is like itself (1)
and unlike anything else (0).  Where both sketches kept nothing, likeness is 1 for equal sets and else 0.  Rows are
ordered by doc_id, a null one last, rows of one doc_id by a hash of their text; each row that repeats is
fingerprinted, and a single row is its own next one.  An empty table gives no rows; extra columns are ignored, whatever
their names; a very long text is hashed in windows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import distinct, set_digest, shingles, text_chunks, words

SCALE = 4
#: Text bytes in a range of doc_ids, about, and the most ranges.
SLOT_BYTES, MOST_SLOTS = 16 << 20, 100_000
#: Sampled ids a range.
SAMPLED = 64
_KEPT = np.uint64((1 << 64) // SCALE)
#: Kept hashes are written with so many bytes; the top bits of a 64-bit hash, less than 2**-30 of them alike within two documents.
_BYTES = 5


class Fingerprint:
    """The kept hashes, ascending, with the size and digest of the whole set."""

    __slots__ = ("digest", "kept", "size", "_text")

    def __init__(self, size: int, digest: int, kept: np.ndarray) -> None:
        self.size, self.digest, self.kept, self._text = size, digest, kept, None

    @staticmethod
    def of(ordered: np.ndarray) -> Fingerprint:
        kept = ordered[: np.searchsorted(ordered, _KEPT)] >> np.uint64(64 - 8 * _BYTES)
        return Fingerprint(len(ordered), set_digest(ordered)[0] & 0xFFFFFFFF, distinct(kept))

    @staticmethod
    def parse(text: str) -> Fingerprint:
        size, digest, kept = text.split(".")
        raw = np.frombuffer(base64.b64decode(kept), np.uint8).reshape(-1, _BYTES).astype(np.uint64)
        return Fingerprint(int(size), int(digest, 16), (raw << (np.arange(_BYTES - 1, -1, -1, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64))

    def __str__(self) -> str:
        if self._text is None:
            raw = self.kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BYTES :]
            self._text = f"{self.size}.{self.digest:x}.{base64.b64encode(raw.tobytes()).decode()}"
        return self._text

    def likeness(self, other: Fingerprint) -> float:
        """Estimated Jaccard similarity of the two sets."""
        if self.size == other.size and self.digest == other.digest:
            return 1.0
        both = self._shared(other)
        union = len(self.kept) + len(other.kept) - both
        return both / union if union else 0.0

    def containment(self, other: Fingerprint) -> float:
        """Estimated share of this set that the other holds; 0 for an empty sketch."""
        return self._shared(other) / len(self.kept) if len(self.kept) else float(self.size == other.size and self.digest == other.digest)

    def _shared(self, other: Fingerprint) -> int:
        return len(np.intersect1d(self.kept, other.kept, assume_unique=True)) if len(self.kept) and len(other.kept) else 0

    def merged(self, other: Fingerprint) -> Fingerprint:
        """The sketch of the union; its set size is an estimate and its digest void."""
        kept = np.union1d(self.kept, other.kept)
        return Fingerprint(len(kept) * SCALE, 0, kept)


def fingerprints(texts: list[str]) -> list[Fingerprint]:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    out = []
    for _, _, data, offsets in text_chunks(batch):
        hashes, _, _, bounds = words(data, offsets)
        out += [Fingerprint.of(distinct(s)) for s in shingles(hashes, bounds)]
    return out


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(str, found), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _cuts(docs: DataFrame, n: int, ids: int) -> np.ndarray:
    """Ends of n ranges of doc_id with about as many rows each, from the ids of lowest hash, about ``SAMPLED`` a range: rows of an id are all in the sample or none."""
    if n < 2 or not ids:
        return np.zeros(0, np.int64)
    share = min(1 << 30, int((1 << 30) * SAMPLED * n / ids) + 1)
    some = docs.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)).select("doc_id").toArrow()
    some = np.sort(some.column(0).to_numpy())
    return np.unique(some[(np.arange(1, n) * len(some)) // n]) if len(some) else np.zeros(0, np.int64)


def with_next(docs: DataFrame, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """The rows (doc_id, text) dealt by ranges of doc_id, sorted, with the row that follows each range.

    Ranges go by quantiles of a sample of doc_ids and stand for about ``slot_bytes`` of text (``MOST_SLOTS`` ranges at most; a task
    streams its range, so a larger one takes longer, not more memory).  Each range's largest document is also sent to
    the range above, as the one after that range's last, and the largest of all to the lowest range; so one shuffle
    of the texts is enough, and no task needs another's rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("doc_id").alias("ids")).first()
    n = min(MOST_SLOTS, max(1, -(-(known["bytes"] or 0) // slot_bytes)))
    cuts = _cuts(docs, n, known["ids"])

    # Range k holds the ids above cuts[k-1], up to cuts[k]; nulls are in the lowest.  Only ids travel to Python.
    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = np.zeros(len(ids), np.int32)
        out[known] = np.searchsorted(cuts, ids[known].to_numpy().astype(np.int64), "left")
        return pd.Series(out)

    # Ids as text, so that pandas doesn't make floats of them where some are null.
    placed = docs.withColumn("slot", place(F.col("doc_id").cast("string")) if len(cuts) else F.lit(0))
    tops = {r[0]: r[1] for r in placed.groupBy("slot").agg(F.max("doc_id")).collect()}
    ranked = sorted(tops, reverse=True)
    above = [(tops[low], high) for high, low in zip(ranked, ranked[1:], strict=False) if tops[low] is not None]
    goes = F.array(F.struct("slot", F.lit(0).alias("extra")))
    if ranked and tops[ranked[0]] is not None:
        carried = spark.createDataFrame([*above, (tops[ranked[0]], ranked[-1])], "top long, slot int").groupBy("top").agg(F.collect_list(F.struct("slot", F.lit(1).alias("extra"))).alias("more"))
        rows = placed.join(F.broadcast(carried), F.col("doc_id") == F.col("top"), "left")
        goes = F.concat(goes, F.coalesce("more", F.array().cast("array<struct<slot:int,extra:int>>")))
    else:
        rows = placed
    rows = rows.select("doc_id", "text", F.explode(goes).alias("to")).select("to.slot", "to.extra", "doc_id", "text")
    rows = rows.repartitionById(len(cuts) + 1, F.col("slot")) if len(cuts) else rows.repartition(1)
    return rows.sortWithinPartitions("slot", "extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), "text")


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    held = first = None  # (slot, extra, doc_id, text, fingerprint) of the last row and of the slot's first

    def emit(pairs: list[tuple]) -> pa.RecordBatch:
        edited = []
        for (_, _, _, text, _), (_, _, _, after, _) in pairs:
            k = len(text) // 3
            edited.append(text[: len(text) - k] + after[:k])
        rows = []
        for (one, two), text, mark in zip(pairs, edited, fingerprints(edited), strict=True):
            rows.append((one[2], len(one[3]), hashlib.sha256(text.encode()).hexdigest(), str(one[4]), str(mark), one[4].likeness(mark), one[4].likeness(two[4])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            texts = batch.column(3).to_pylist()
            rows = list(zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), texts, fingerprints(texts), strict=True))
            pairs = []
            for row in rows:
                if held is not None and held[1] == 0:
                    if row[0] == held[0]:
                        pairs.append((held, row))
                    else:
                        pairs.append((held, first))
                if held is None or row[0] != held[0]:
                    first = row
                held = row
            if pairs:
                yield emit(pairs)
    if held is not None and held[1] == 0:
        yield emit([(held, first)])


def edited_fingerprints(docs: DataFrame, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, slot_bytes).mapInArrow(_edit, schema)


def op6_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
