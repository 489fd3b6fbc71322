"""MinHash near-duplicate detection with odd sketches.

Method
------
1. A document's set is its distinct five-word shingles (64-bit hashes).  Documents with equal sets
   form a class (grouped by a 128-bit digest, aggregated before the shuffle); only one
   representative of a class goes on, so thousands of exact copies cost one row.
2. A representative gets ``bands * rows`` MinHash minima for banding and an odd sketch: a finer
   one-permutation MinHash sample (the lowest hash of each of ``bins`` ranges of the hash space),
   each sample folded into a parity bitmap of ``bits`` bits.  The population count of the XOR of two
   bitmaps estimates how many samples differ, precisely so for high similarities.
3. Candidates come from equal bands.  First each member of a bucket is compared with the bucket's
   hub (its smallest id): a number of pairs linear in the rows.  Pairs whose sketches allow the
   threshold are confirmed on the full sets.
4. Members of a bucket that are then still outside its largest component meet all of it in blocks of
   bounded size: sketches first, then the full sets, which the block holds.  A block joins what it has
   linked, so it returns at most one link less than it has components.  So no link is lost to the hub
   shortcut, and pairs are never listed.
5. Components by distributed hooking and contraction.

Defined results: a null or wordless text has an empty set and is linked with nothing.  Rows with a
null ``doc_id`` are linked with nothing, have a null component and are kept.  Rows that repeat a
``doc_id`` count as one document.  Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import apart, connected_components, cut, sorted_groups
from .textkernel import distinct, jaccard, minhash, mix64, set_digest, shingles, text_chunks, words

BANDS, ROWS = 24, 4
BINS, BITS = 8192, 4096
#: A pair is confirmed on full sets if its sketches put it at most this many standard deviations below the threshold.
DEVIATIONS = 5
#: 64-bit words (sets and sketches) of a bucket's rows outside its main component, and of all its rows, that are compared at once.
BLOCK, REST = 1 << 18, 1 << 20
#: Shingles of one set's partners that are compared at once.
GATHER = 1 << 20

_SIGNATURE = "doc_id long, n_shingles long, d1 long, d2 long, occupied int, bands array<long>, odd array<long>"


def odd_sketch(ordered: np.ndarray, bins: int = BINS, bits: int = BITS) -> tuple[int, np.ndarray]:
    """(number of samples, parity bitmap as int64 words) of a set given as sorted distinct hashes."""
    place = ordered >> np.uint64(64 - bins.bit_length() + 1)
    first = np.ones(len(ordered), bool)
    np.not_equal(place[1:], place[:-1], out=first[1:])
    sample = ordered[first]
    spot = (mix64(sample + np.uint64(0x632BE59BD9B4E019)) % np.uint64(bits)).astype(np.int64)
    parity = (np.bincount(spot, minlength=bits) & 1).astype(np.uint8)
    return len(sample), np.packbits(parity, bitorder="little").view(np.int64)


def document_sets(batch: pa.RecordBatch, k: int = 5) -> Iterator[np.ndarray]:
    for _, _, data, offsets in text_chunks(batch):
        hashes, _, _, bounds = words(data, offsets)
        for s in shingles(hashes, bounds, k):
            yield distinct(s)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix64(np.arange(BANDS, dtype=np.uint64))
    empty = np.zeros(0, np.int64)
    for batch in batches:
        size, d1, d2, occupied, bands, odd = [], [], [], [], [], []
        for s in document_sets(batch):
            a, b = set_digest(s)
            size.append(len(s))
            d1.append(a)
            d2.append(b)
            if len(s):
                low = minhash(s, BANDS * ROWS).reshape(BANDS, ROWS)
                key = salt.copy()
                for r in range(ROWS):
                    key = mix64(key * np.uint64(0xD1B54A32D192ED03) + low[:, r])
                n, sketch = odd_sketch(s)
                occupied.append(n)
                bands.append(key.view(np.int64))
                odd.append(sketch)
            else:
                occupied.append(0)
                bands.append(empty)
                odd.append(empty)
        lists = lambda rows: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)), pa.array(np.concatenate([empty, *rows])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(occupied, pa.int32()), lists(bands), lists(odd)],
            names=["doc_id", "n_shingles", "d1", "d2", "occupied", "bands", "odd"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """One row per document: set size, set digest, band keys and odd sketch."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_sign, _SIGNATURE)


def _least_same(total, similarity: float, exp, sqrt):
    """The least estimate of equal samples of two sets with ``total`` shingles together that are at least this similar.

    A range's lowest hash is equal with a chance of the similarity.  Where a shingle is alone in its range that is settled by
    the sets; only which shingles are alone varies (as a draw without replacement), and the ranges that several share vary
    binomially.  How many ranges are filled varies as balls in bins do.  With m samples in the odd bitmap the number of
    ones has the variance bits (1 - q (1 + l)) / 4, l = 4 m / bits, q = exp(-l), and the derivative exp(-l / 2); the estimate
    of equal samples is half that of m.
    """
    union = total / (1 + similarity)
    load = union / BINS
    filled, alone = BINS * (1 - exp(-load)), union * exp(-load)
    several = alone * (1 - exp(-load)) + filled - alone
    empty = BINS * exp(-load) * (1 - (1 + load) * exp(-load))
    l4 = 4 * (2 * (1 - similarity) * filled) / BITS
    q = exp(-l4)
    spread = sqrt(similarity * (1 - similarity) * several + similarity**2 * empty + BITS * (1 - q * (1 + l4)) / (16 * q))
    return similarity * filled - DEVIATIONS * spread - 1


def _filtered(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose set sizes and odd sketches allow the similarity; built-in functions only."""
    side = lambda n: reps.select(F.col("doc_id").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in ("n_shingles", "occupied", "odd")])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(F.least("a_n_shingles", "b_n_shingles") >= similarity * F.greatest("a_n_shingles", "b_n_shingles"))
    ones = F.aggregate(F.zip_with("a_odd", "b_odd", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)
    both = both.withColumn("ones", ones)
    apart = F.when(F.col("ones") * 2 < BITS - 8, -BITS / 2 * F.log(1 - 2.0 * F.col("ones") / BITS)).otherwise(F.lit(4.0 * BITS))
    same = (F.col("a_occupied") + F.col("b_occupied") - apart) / 2
    return both.where(same >= _least_same(F.col("a_n_shingles") + F.col("b_n_shingles"), similarity, F.exp, F.sqrt)).select("a", "b")


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            one = document_sets(batch.select(["a_text"]).rename_columns(["text"]))
            two = document_sets(batch.select(["b_text"]).rename_columns(["text"]))
            for x, y in zip(one, two, strict=True):
                both, union = jaccard(x, y)
                keep.append(both > 0 and 100 * both >= percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that reach the similarity on their full sets."""
    side = lambda n: texts.select(F.col("doc_id").alias(n), F.col("text").alias(f"{n}_text"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_text", "b_text").mapInArrow(_confirm(round(100 * similarity)), "a long, b long")


def _full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketch and whole set of each text."""
    for batch in batches:
        sets = list(document_sets(batch.select(["text"])))
        sketches = [odd_sketch(s) for s in sets]
        lists = lambda rows: pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate([np.zeros(0, np.int64), *rows])).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([n for n, _ in sketches], pa.int32()), lists([odd for _, odd in sketches]), lists([s.view(np.int64) for s in sets])],
            names=["doc_id", "n_shingles", "occupied", "odd", "shingles"],
        )


def _partners(own: np.ndarray, values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets (places in ``values``) reach the similarity with the sorted set ``own``."""
    begin = np.cumsum(sizes) - sizes
    other = values[np.arange(sizes.sum()) + np.repeat(starts - begin, sizes)]
    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
    both = np.add.reduceat((own[place] == other).astype(np.int64), begin)
    return (both > 0) & (100 * both >= percent * (len(own) + sizes - both))


def _across(similarity: float):
    """For pairs of blocks of a bucket, sorted by them: links between different components, one for each two that become one."""
    percent = round(100 * similarity)

    def compare(rows: pa.RecordBatch) -> list[tuple[int, int]]:
        get = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        ids, comp, n, occ, left, minor = (get(c) for c in ("doc_id", "component", "n_shingles", "occupied", "left", "minor"))
        odd = rows.column("odd").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(ids), -1)
        values = rows.column("shingles").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        starts = np.cumsum(n) - n
        comp = np.unique(comp, return_inverse=True)[1]
        right, out = np.flatnonzero(~left), []
        for x in np.flatnonzero(left).tolist():
            # Of two rows outside the main component the larger id is on the left.
            at = right[(comp[right] != comp[x]) & (~minor[right] | (ids[right] < ids[x]))]
            at = at[np.minimum(n[at], n[x]) >= similarity * np.maximum(n[at], n[x])]
            if not len(at):
                continue
            ones = np.bitwise_count(odd[at] ^ odd[x]).sum(axis=1, dtype=np.int64)
            apart = np.where(ones * 2 < BITS - 8, -BITS / 2 * np.log(np.maximum(1 - 2.0 * ones / BITS, 1e-9)), 4.0 * BITS)
            ok = (occ[at] + occ[x] - apart) / 2 >= _least_same(n[at] + n[x], similarity, np.exp, np.sqrt)
            at = at[ok][np.argsort(ones[ok], kind="stable")]
            own, most = values[starts[x] : starts[x] + n[x]], 16
            while len(at):
                # The likeliest first: what they join needs no further comparison.
                some = at[: max(1, min(most, int(np.searchsorted(np.cumsum(n[at]), GATHER, "right"))))]
                for y in some[_partners(own, values, starts[some], n[some], percent)].tolist():
                    if comp[x] != comp[y]:
                        out.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                        comp[comp == comp[y]] = comp[x]
                at = at[len(some) :]
                at, most = at[comp[at] != comp[x]], 4 * most
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["key", "i", "j"]):
            if out := compare(rows):
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (columns doc_id and text are used)."""
    sig = cut(signatures(docs))
    linked = sig.where("n_shingles > 0 and doc_id is not null")
    reps = cut(linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n_shingles", "occupied", "bands", "odd"), "doc_id").alias("s")).select("d1", "d2", "doc_id", "s.*"))
    buckets = reps.select("doc_id", "n_shingles", F.explode("bands").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).where("n > 1 ")
    members = cut(buckets.join(hubs, "key"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(members.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    texts = cut(texts)
    slim = reps.select("doc_id", "n_shingles", "occupied", "odd")

    star = members.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    edges = cut(_confirmed(_filtered(star, slim, similarity), texts, similarity))
    labels = connected_components(edges)

    # Members of a bucket that its hub has not joined.
    rest = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    rest = cut(apart(cut(rest), "key", "doc_id", F.col("n_shingles") + BITS // 64, BLOCK, REST).select("key", "i", "j", "left", "minor", "doc_id", "component"))
    full = texts.join(rest.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_full, "doc_id long, n_shingles long, occupied int, odd array<long>, shingles array<long>")
    met = rest.join(full, "doc_id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = cut(met.mapInArrow(_across(similarity), "a long, b long").distinct())
    if not more.isEmpty():
        labels = connected_components(edges.union(more))

    classes = reps.select("d1", "d2", F.col("doc_id").alias("node")).join(labels, "node", "left").select("d1", "d2", F.coalesce("component", "node").alias("component_id"))
    found = linked.join(classes, ["d1", "d2"]).select("doc_id", "n_shingles", "component_id")
    alone = sig.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same result by joining documents on every shingle that they share.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS seen FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.seen),
lowest AS (SELECT doc_id, min(seen) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""
