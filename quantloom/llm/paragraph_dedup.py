"""Repeated passages across documents, by MinHash banding of paragraphs.

A paragraph is a line as a whole.  A long line also has pieces, so that a passage that is copied into the middle of
other text is found: the line is cut before each word whose hashed three words are lowest within ``REACH`` words to
either side.  Such cuts depend on nearby words only, so a copied passage is cut alike there.

1. Lines and pieces of equal words form a class; classes that at least two documents hold are duplicates.  A task
   first combines what its chunk of documents repeats, so a class that fills the corpus sends two rows a chunk.
2. A line's set is its distinct five-word shingles (with fewer words, the whole line).  Its MinHash minima are banded,
   ``BANDS`` bands of ``ROWS`` rows: a pair at the threshold of 0.75 shares a bucket with a chance of 99.9 %.  Lines that
   no other of their bucket can reach by set size and by a parity bitmap of 64 bits are left out first: two sets differ
   in at least as many shingles as their bitmaps in bits, so no link is lost.  In a bucket every line is paired with the
   smallest, its hub, a number of pairs linear in the rows; Jaccard similarity is confirmed on the full sets, which
   a second pass fetches for the candidates only (through a bitmap sized by their number, 128 MB at most; where
   it is full, it lets more sets through, and a join drops them).
3. Members of a hub's buckets that are then still outside its largest component are compared with all of them, on the
   full sets, in pairs of blocks of bounded size.  So no link is lost to the hub shortcut.
4. Confirmed pairs are clustered by connected components.  Pieces of a line that is itself a removal are not
   reported again; pieces of other reported lines are, so rows may overlap.  Of each reported cluster the first
   occurrence, by doc_id and place, is kept; the others are removals.

A repeated passage is a run of neighbouring repeated paragraphs that has ``least_words`` words (the operator's definition
of a passage, as a copyright line or a greeting is none); 1 reports every repeated line and piece.

Defined results: null and wordless texts have no paragraphs; rows with a null doc_id are left out; rows that repeat a
doc_id count as one document, so equal paragraphs at one place of them are one; extra columns are ignored, whatever
their names; a very long text is worked on in windows.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import apart, connected_components, cut, sorted_groups
from .textkernel import jaccard, minhash_family, mix64, powers, shingle_sets, text_chunks, words

REACH, BANDS, ROWS = 5, 8, 2
LEAST_WORDS = 16
#: Text bytes that a part stands for, about.
PART_BYTES = 16 << 20
#: Tasks that parts are dealt to, at most; a task handles its parts one by one.
MOST_TASKS = 100_000
#: KB of sets outside a hub's main component, and of all its sets, that are compared at once.
BLOCK, REST = 2048, 4096
#: In larger groups all classes count as reachable.
PAIRED = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(0xD1B54A32D192ED03)
_MEMBERS = "digest long, doc_id long, start long, length long, other long"


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first word of each piece and the end, first word of each line and the end, first word of each text and the end)."""
    hashes, start, _, bounds = words(data, offsets)
    n = len(hashes)
    if not n:
        return hashes, np.zeros(1, np.int64), np.zeros(1, np.int64), bounds
    lines = np.flatnonzero(data == 10)
    new = np.zeros(n + 1, bool)
    new[bounds] = True
    new[np.searchsorted(start, lines)] = True
    rolled = hashes.copy()
    for j in (1, 2):
        rolled[:-j] = rolled[:-j] * _SHIFT + hashes[j:]
    rolled = mix64(rolled)
    lowest = np.ones(n, bool)
    for j in range(1, REACH + 1):
        lowest[:-j] &= rolled[:-j] < rolled[j:]
        lowest[j:] &= rolled[j:] < rolled[:-j]
    # A cut near the end of a line, within reach of which the words after it matter, is no cut.
    edge = np.flatnonzero(new)
    to_next = edge[np.searchsorted(edge, np.arange(n), "right")] - np.arange(n)
    since = np.arange(n) - edge[np.searchsorted(edge, np.arange(n), "right") - 1]
    new[:n] |= lowest & (to_next > REACH + 2) & (since > REACH)
    return hashes, np.flatnonzero(new), edge, bounds


def _digests(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """64 bits that identify each word sequence from ``first`` up to ``last``."""
    power, inverse = powers(len(hashes))
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(hashes ^ _GOLD) * power[: len(hashes)])])
    return mix64((total[last] - total[first]) * inverse[first] ^ (last - first).astype(np.uint64) * _GOLD)


def _units(hashes: np.ndarray, cuts: np.ndarray, lines: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first word in it, length, digest) of all lines, then of the pieces of lines that have several.

    A length is twice the number of words, plus one for a line.
    """
    several = np.diff(np.searchsorted(cuts, lines)) > 1
    piece = np.flatnonzero(several[np.searchsorted(lines, cuts[:-1], "right") - 1]) if len(cuts) > 1 else np.zeros(0, np.int64)
    first = np.concatenate([lines[:-1], cuts[:-1][piece]])
    last = np.concatenate([lines[1:], cuts[1:][piece]])
    text = np.searchsorted(bounds, first, "right") - 1
    length = (last - first) * 2 + (np.arange(len(first)) < len(lines) - 1)
    return text, first - bounds[text], length, _digests(hashes, first, last)


def _deal(parts: int):
    add, mult = minhash_family(BANDS * ROWS, 7)

    def place(keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch):
                hashes, cuts, lines, bounds = paragraphs(data, offsets)
                text, start, count, digest = _units(hashes, cuts, lines, bounds)
                if not len(digest):
                    continue
                doc = ids[a:b].astype(np.int64)[text]
                order = np.lexsort((start, doc, digest))
                digest_, doc_ = digest[order], doc[order]
                first = np.flatnonzero(np.concatenate([[True], digest_[1:] != digest_[:-1]]))
                last = np.append(first[1:], len(order)) - 1
                many = doc_[first] != doc_[last]
                known = np.repeat(many, np.diff(np.append(first, len(order))))
                sent = ~known
                sent[first] = sent[last] = True
                # kind 0: an occurrence to look up; 1: one whose class is known to be in several documents, so it is a member as it is.
                rows = []
                for kind, pick in ((0, order[sent]), (1, order[known])):
                    to = place(digest[pick]) if kind == 0 else (mix64(doc[pick].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
                    rows += _packed(kind, to, digest[pick], doc[pick], start[pick].astype(np.int32), count[pick].astype(np.int32))
                flat, edge = shingle_sets(hashes, lines)
                own = np.unique(digest[: len(lines) - 1], return_index=True)[1]
                size = np.diff(edge)
                parity = np.bitwise_xor.reduceat(np.uint64(1) << (flat & np.uint64(63)), edge[:-1])
                for band in range(BANDS):
                    key = np.full(len(own), band, np.uint64)
                    for r in range(band * ROWS, band * ROWS + ROWS):
                        key = mix64(key * _SHIFT + np.minimum.reduceat((flat ^ add[r]) * mult[r], edge[:-1])[own])
                    rows += _packed(2, place(key), key, digest[own].view(np.int64), size[own].astype(np.int32), parity[own])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["part", "kind", "x", "y", "start", "count"])

    return run


def _packed(kind: int, place: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    order = np.argsort(place, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0, [True]])) if len(place) else [0]
    return [(int(place[order[i]]), kind, *(c[order[i:j]].tobytes() for c in columns)) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _members(digest, doc, start, count, other) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).astype(np.int64)) for c in (digest.view(np.int64), doc, start, count, other)], names=["digest", "doc_id", "start", "length", "other"])


def _reachable(key: np.ndarray, digest: np.ndarray, size: np.ndarray, parity: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of its group, digest), sorted, of the classes that may have a partner: groups are buckets, split where no set size of one side allows any of the other."""
    order = np.lexsort((digest, size, key))
    key, digest, size, parity = key[order], digest[order], size[order], parity[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])])
    key, digest, size, parity = key[once], digest[once], size[once], parity[once]
    group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (100 * size[:-1] < percent * size[1:])]))
    n = np.bincount(group)
    may = n[group] > PAIRED
    for step in range(1, PAIRED):
        a = np.flatnonzero((group[step:] == group[:-step]) & (n[group[step:]] <= PAIRED))
        if not len(a):
            break
        b = a + step
        good = (100 * size[a] >= percent * size[b]) & ((100 + percent) * np.bitwise_count(parity[a] ^ parity[b]).astype(np.int64) <= (100 - percent) * (size[a] + size[b]))
        may[a[good]] = may[b[good]] = True
    group, digest = group[may], digest[may]
    order = np.lexsort((digest, group))
    return np.unique(group[order], return_inverse=True)[1], digest[order]


def _group(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of classes in several documents (length > 0), and candidate pairs of classes (digest, other; length 0)."""
        for rows in sorted_groups(batches, ["part", "kind"]):
            kind = rows.column("kind")[0].as_py()
            get = lambda c, t, rows=rows: np.concatenate([np.frombuffer(v.as_py(), t) for v in rows.column(c)])
            x, y = get("x", np.uint64), get("y", np.int64)
            if kind == 2:
                x, y = _reachable(x, y, get("start", np.int32).astype(np.int64), get("count", np.uint64), percent)
                hub = y[np.flatnonzero(np.diff(x, prepend=-1))[x]] if len(x) else y
                apart = hub != y
                if apart.any():
                    pairs = np.unique(np.stack([hub[apart], y[apart]]), axis=1)
                    zero = np.zeros(pairs.shape[1], np.int64)
                    yield _members(pairs[0], zero, zero, zero, pairs[1])
                continue
            start, count = get("start", np.int32), get("count", np.int32)
            if kind == 0:
                order = np.lexsort((start, y, x))
                x, y, start, count = x[order], y[order], start[order], count[order]
                first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
                sizes = np.diff(np.append(first, len(x)))
                several = np.repeat(y[first] != y[first + sizes - 1], sizes)
                x, y, start, count = (c[several] for c in (x, y, start, count))
            if len(x):
                yield _members(x, y, start, count, np.zeros(len(x)))

    return run


def _slots(digest: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte, bit) of each digest in a bitmap."""
    slot = mix64(digest.view(np.uint64)) % np.uint64(bits)
    return (slot >> np.uint64(3)).astype(np.int64), (slot & np.uint64(7)).astype(np.uint8)


def _bitmap(digests: DataFrame) -> np.ndarray:
    """Which slots some distinct digests have, in at least 16 bits for each up to 2**30 in all; a task sends the bytes that it sets, and Spark combines them."""
    bits = 1 << min(30, max(16, (16 * digests.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            byte, bit = _slots(batch.column(0).to_numpy(), bits)
            np.bitwise_or.at(seen, byte, np.uint8(1) << bit)
        lanes = seen.view(np.int64)
        some = np.flatnonzero(lanes)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(lanes[some])], names=["lane", "bits"])

    out = np.zeros(bits // 64, np.int64)
    found = digests.mapInArrow(run, "lane long, bits long").groupBy("lane").agg(F.bit_or("bits").alias("bits")).toArrow()
    out[found.column("lane").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _fetch(bitmap):
    """Occurrences of lines that may be wanted; of those with equal words in a chunk the first has the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bitmap.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_chunks(batch):
                hashes, _, lines, bounds = paragraphs(data, offsets)
                text, start, count, digest = _units(hashes, lines, lines, bounds)
                byte, bit = _slots(digest, len(wanted) * 8)
                at = np.flatnonzero(wanted[byte] >> bit & 1)
                if len(at):
                    flat, edge = shingle_sets(hashes, lines, at)
                    first = set(np.unique(digest[at], return_index=True)[1].tolist())
                    sets = pa.array([flat[edge[i] : edge[i + 1]].tobytes() if i in first else None for i in range(len(at))], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(digest[at].view(np.int64)), pa.array(ids[a:b].astype(np.int64)[text[at]]), pa.array(start[at]), pa.array(count[at]), sets], names=["digest", "doc_id", "start", "length", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both, union = jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                keep.append(100 * both >= percent * union)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Index:
    """Which of some sets hold a shingle."""

    def __init__(self, sets: list[np.ndarray], at: np.ndarray) -> None:
        flat = np.concatenate([sets[k] for k in at.tolist()]) if len(at) else np.zeros(0, np.uint64)
        owner = np.repeat(at, [len(sets[k]) for k in at.tolist()])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner, self.n = flat[order], owner[order], len(sets)

    def shared(self, x: np.ndarray) -> np.ndarray:
        """How many shingles each set has in common with ``x``."""
        low, high = np.searchsorted(self.flat, x, "left"), np.searchsorted(self.flat, x, "right")
        reps = high - low
        at = np.repeat(low - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
        return np.bincount(self.owner[at], minlength=self.n)


def _across(percent: int):
    """For pairs of blocks of a hub's members, sorted by them: confirmed pairs in different components, of a left row one with each component."""

    def compare(rows: pa.RecordBatch) -> Iterator[tuple[int, int]]:
        ids, comp, left, minor = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "left", "minor"))
        sets = [np.frombuffer(v.as_py(), np.uint64) for v in rows.column("shingles")]
        size = np.array([len(s) for s in sets])
        index = _Index(sets, np.flatnonzero(~left))
        for x in np.flatnonzero(left).tolist():
            both = index.shared(sets[x])
            # Of two members outside the main component the larger is on the left.
            good = np.flatnonzero((both > 0) & (comp != comp[x]) & (~minor | (ids < ids[x])) & (100 * both >= percent * (size + size[x] - both)))
            for y in good[np.unique(comp[good], return_index=True)[1]].tolist():
                yield min(ids[x], ids[y]), max(ids[x], ids[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sorted_groups(batches, ["hub", "i", "j"]):
            if out := list(compare(rows)):
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _joined(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes by confirmed pairs: first of hubs (a) with their members (b), then between members still apart."""
    side = lambda n: sets.select(F.col("digest").alias(n), F.col("shingles").alias(f"{n}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    edges = cut(both.select("a", "b", "a_set", "b_set").mapInArrow(_confirm(percent), "a long, b long"))
    labels = connected_components(edges)
    size = sets.select(F.col("digest").alias("node"), F.greatest(F.lit(1.0), F.octet_length("shingles") / 1024).alias("kb"))
    rest = pairs.select(F.col("a").alias("hub"), F.col("b").alias("node")).join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rest = apart(cut(rest.join(size, "node")), "hub", "node", F.col("kb"), BLOCK, REST).select("hub", "i", "j", "left", "minor", "node", "component")
    rest = rest.join(sets.withColumnRenamed("digest", "node"), "node").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    more = cut(rest.mapInArrow(_across(percent), "a long, b long").distinct())
    return labels if more.isEmpty() else connected_components(edges.union(more))


def repeated_paragraphs(docs: DataFrame, similarity: float = 0.75, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, start and end word, cluster_id and kept of every paragraph that other documents repeat."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    percent = round(100 * similarity)
    dealt = docs.mapInArrow(_deal(parts), "part int, kind int, x binary, y binary, start binary, count binary")
    found = cut(dealt.repartition(min(parts * 3, MOST_TASKS), "part", "kind").sortWithinPartitions("part", "kind").mapInArrow(_group(percent), _MEMBERS))
    exact = found.where("length > 0").select("digest", "doc_id", "start", "length")

    pairs = cut(found.where("length = 0").select(F.col("digest").alias("a"), F.col("other").alias("b")).distinct())
    wanted = cut(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).distinct())
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted))
    near = docs.mapInArrow(_fetch(bitmap), "digest long, doc_id long, start long, length long, shingles binary")
    near = cut(near.join(wanted, "digest", "left_semi"))
    sets = near.where("shingles is not null").groupBy("digest").agg(F.first("shingles").alias("shingles"))
    labels = cut(_joined(pairs, sets, percent).select(F.col("node").alias("digest"), F.col("component").alias("cluster")))

    linked = near.join(labels, "digest").select("digest", "doc_id", "start", "length", "cluster")
    alone = exact.join(labels, "digest", "left").select("digest", "doc_id", "start", "length", F.coalesce("cluster", "digest").alias("cluster"))
    members = linked.union(alone).dropDuplicates(["doc_id", "start", "length"])
    # Of occurrences at one word the longest is first.
    place = F.struct("doc_id", "start", -F.col("length"))
    spread = members.groupBy("cluster").agg(F.min(place).alias("first"), F.max("doc_id").alias("last"))
    members = members.join(spread, "cluster").where(F.col("first.doc_id") < F.col("last"))
    members = members.withColumns({"line": F.col("length") % 2 == 1, "end": F.col("start") + F.shiftright("length", 1), "removed": F.col("first") < place})
    order = Window.partitionBy("doc_id").orderBy("start", F.desc("length"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.when(F.col("line") & F.col("removed"), F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    members = members.withColumn("covered", covered).where("not covered").select("doc_id", "start", "length", "end", "cluster")
    joins = F.coalesce(F.max("end").over(before) >= F.col("start"), F.lit(False))
    runs = members.withColumn("run", F.sum(F.when(joins, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("doc_id", "run")
    runs = cut(runs.withColumn("run_words", F.max("end").over(run) - F.min("start").over(run)).where(F.col("run_words") >= least_words).select("doc_id", "start", "length", "end", "cluster"))
    firsts = runs.groupBy("cluster").agg(F.min(place).alias("first"))
    return runs.join(firsts, "cluster").select(
        "doc_id",
        F.col("start").alias("start_word"),
        F.col("end").alias("end_word"),
        F.col("cluster").alias("cluster_id"),
        (F.col("first") == place).alias("kept"),
    )


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
