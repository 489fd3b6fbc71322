"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. The word n-grams of an item are its seeds; of an item of under ``MIDDLE`` words each pair of words is one, as a copy with
   enough words replaced one by one for the threshold always keeps a pair; of one of under ``SHORT`` each word.  A document that holds
   a seed of an item is joined to it, however many documents hold the seed (of a short item as many words as the
   threshold asks for).
2. Around the seeds' diagonals in a document, the words that it has in common with the item, wherever they
   are, bound the alignment's score from above: first by a count over all such windows at once, then, repeats
   included, window by window.  Where the bound allows the threshold the document is aligned with the item: local
   alignment of lower-case words (match 2, mismatch -1, gap -1).  The score is divided by that of the whole item; from
   ``THRESHOLD`` a document counts as contaminated by the item.

A copy of a longer item is found if it has ``GRAM`` words in a row unchanged, also where the item is copied very often
or its phrases are common.  The benchmark is handled in blocks of at most ``BLOCK_BYTES`` of text, each with a pass of
its own over the documents, so what is sent to the executors is bounded whatever the benchmark's size.

Defined results: a null or wordless item or document matches nothing; rows with a null doc_id or item_id are compared
and carry the null; rows that repeat an item_id or doc_id are compared each; an empty table on either side gives no
rows; a very long text is worked on in windows of the word kernel and listed hits; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import mix64, text_chunks, words

GRAM = 3
#: Items of fewer words have pairs of words, or single words, as seeds.
MIDDLE, SHORT = 16, 8
#: Seed hits that are listed at once, about.
HITS = 1 << 20
THRESHOLD = 0.5
BLOCK_BYTES = 4 << 20
_FOUND = "doc_id long, item_id long, score double, first_word long, last_word long"


def lowered(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with lower-case texts, in all scripts."""
    at = batch.schema.get_field_index("text")
    return batch.set_column(at, "text", pc.utf8_lower(batch.column(at)))


def grams(hashes: np.ndarray, bounds: np.ndarray, n: int = GRAM) -> np.ndarray:
    """The hash of the n-gram that starts at each word, with zeros where a text ends before it does."""
    out = np.zeros(len(hashes), np.uint64)
    if len(hashes) >= n:
        rolled = hashes[: len(hashes) - n + 1].copy()
        for j in range(1, n):
            rolled = rolled * np.uint64(0xD1B54A32D192ED03) + hashes[j : len(hashes) - n + 1 + j]
        out[: len(rolled)] = mix64(rolled) | np.uint64(1)
    for k in range(1, n):  # the last n-1 words of a text start none
        at = bounds[1:] - k
        out[at[at >= bounds[:-1]]] = 0
    return out


def _single(hashes: np.ndarray) -> np.ndarray:
    """The key of each word as a seed by itself."""
    return mix64(hashes + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


@dataclass(frozen=True)
class Item:
    item_id: int
    words: np.ndarray
    #: Keys and places of its seeds.
    seeds: np.ndarray
    places: np.ndarray


def _items(rows: list) -> list[Item]:
    found = []
    for item_id, text in rows:
        batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["text"])
        _, _, data, offsets = next(text_chunks(lowered(batch)))
        hashes, _, _, bounds = words(data, offsets)
        if len(hashes):
            keys = _single(hashes) if len(hashes) < SHORT else grams(hashes, bounds, 2 if len(hashes) < MIDDLE else GRAM)
            places = np.flatnonzero(keys)
            found.append(Item(item_id, hashes, keys[places], places))
    return found


def align(document: np.ndarray, item: np.ndarray, match: int = 2, miss: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """(score, first, last word) of the best local alignment of ``item`` within ``document``, both as word hashes.

    Row by row over the item; a gap within a row is a running maximum, as its cost is linear.
    """
    n = len(document)
    ramp = np.arange(n + 1) * -gap
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    start = np.arange(n + 1)
    begin = 0
    for w in item:
        diagonal = row[:-1] + np.where(document == w, match, miss)
        up = row[1:] + gap
        cell = np.zeros(n + 1, np.int64)
        cell[1:] = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.arange(n + 1)
        origin[1:] = np.where(cell[1:] == 0, origin[1:], np.where(diagonal >= up, start[:-1], start[1:]))
        lifted = cell + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        cell, origin = top - ramp, np.where(top - ramp > cell, origin[source], origin)
        zero = cell <= 0
        cell[zero] = 0
        origin[zero] = np.arange(n + 1)[zero]
        row, start = cell, origin
        k = int(row.argmax())
        if row[k] > best:
            best, end, begin = int(row[k]), k, int(start[k])
    return best, begin, end - 1


def _in_common(part: np.ndarray, kinds: np.ndarray, counts: np.ndarray) -> int:
    """How many words a text and an item, given by its distinct words and their counts, have in common, repeats included."""
    at = np.searchsorted(kinds, part)
    at[at == len(kinds)] = 0
    return int(np.minimum(np.bincount(at[kinds[at] == part], minlength=len(kinds)), counts).sum())


@dataclass(frozen=True)
class Seeds:
    """The seeds of some items: distinct keys, ascending, with where the entries of each begin; of each entry the item and the place there."""

    keys: np.ndarray
    bounds: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    single: bool
    pairs: bool

    @staticmethod
    def of(items: list[Item]) -> Seeds:
        keys = np.concatenate([i.seeds for i in items])
        owner = np.repeat(np.arange(len(items)), [len(i.seeds) for i in items])
        place = np.concatenate([i.places for i in items])
        order = np.argsort(keys, kind="stable")
        distinct, first = np.unique(keys[order], return_index=True)
        return Seeds(distinct, np.append(first, len(keys)), owner[order], place[order], any(len(i.words) < SHORT for i in items), any(SHORT <= len(i.words) < MIDDLE for i in items))

    def hits(self, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, number of its key) of each seed in some texts, by word."""
        found = []
        for keys in (grams(hashes, bounds), *([grams(hashes, bounds, 2)] if self.pairs else []), *([_single(hashes)] if self.single else [])):
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            word = np.flatnonzero(self.keys[at] == keys)
            found.append((word, at[word]))
        word, at = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        return word[order], at[order]


@dataclass(frozen=True)
class Vocabulary:
    """The distinct words of some items: keys of (item, word), ascending."""

    keys: np.ndarray

    @staticmethod
    def _keys(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        return mix64(hashes ^ mix64(owner.astype(np.uint64) + np.uint64(1)))

    @staticmethod
    def of(items: list[Item]) -> Vocabulary:
        owner = np.repeat(np.arange(len(items)), [len(i.words) for i in items])
        return Vocabulary(np.unique(Vocabulary._keys(owner, np.concatenate([i.words for i in items]))))

    def counts(self, hashes: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many words of each range low to high are the owner's, repeats and all."""
        out, a = np.zeros(len(low), np.int64), 0
        total = np.concatenate([[0], np.cumsum(high - low)])
        while a < len(low):
            b = max(a + 1, int(np.searchsorted(total, total[a] + HITS, "right")) - 1)
            size = high[a:b] - low[a:b]
            which = np.repeat(np.arange(a, b), size)
            place = np.arange(len(which)) + np.repeat(low[a:b] - (total[a:b] - total[a]), size)
            keys = self._keys(owner[which], hashes[place])
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            out[a:b] = np.bincount(which - a, self.keys[at] == keys, b - a)
            a = b
        return out


def _ranges(at: np.ndarray, row: np.ndarray, owner: np.ndarray, place: np.ndarray, size: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, owner, first and end word) of the windows around seeds, those of a document and item joined where they meet."""
    spare = size[owner] // 2 + 4
    low = np.maximum(at - place - spare, bounds[row])
    high = np.minimum(at - place + size[owner] + spare, bounds[row + 1])
    order = np.lexsort((low, owner, row))
    row, owner, low, high = row[order], owner[order], low[order], high[order]
    # Within a document and item both ends ascend.
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (low[1:] > high[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    return row[first], owner[first], low[first], high[last]


def _search(items: list[Item], seeds: Seeds, threshold: float):
    vocabulary, size = Vocabulary.of(items), np.array([len(i.words) for i in items])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        needed = np.where(size < SHORT, np.ceil(threshold * size), 1)
        for batch in batches:
            out: list[tuple] = []
            for first, _, data, offsets in text_chunks(lowered(batch)):
                hashes, _, _, bounds = words(data, offsets)
                hit, key = seeds.hits(hashes, bounds)
                reps = np.diff(seeds.bounds)[key]
                # Whole documents at a time, so that the pairs listed at once are few.
                total = np.concatenate([[0], np.cumsum(reps)])
                ends = np.searchsorted(hit, bounds)
                row_a = 0
                while row_a < len(bounds) - 1:
                    row_b = max(row_a + 1, int(np.searchsorted(total[ends], total[ends[row_a]] + HITS, "right")) - 1)
                    x, y = ends[row_a], ends[row_b]
                    row_a = row_b
                    if x == y:
                        continue
                    at = np.repeat(hit[x:y], reps[x:y])
                    seed = np.repeat(seeds.bounds[key[x:y]] - (total[x:y] - total[x]), reps[x:y]) + np.arange(len(at))
                    owner, place = seeds.owner[seed], seeds.place[seed]
                    row = np.searchsorted(bounds, at, "right") - 1
                    pair = row * np.int64(len(items)) + owner
                    order = np.lexsort((place, pair))
                    new = np.concatenate([[True], np.diff(pair[order]) != 0])
                    begin = np.flatnonzero(new)
                    places = np.add.reduceat(new | np.concatenate([[True], np.diff(place[order]) != 0]), begin, dtype=np.int64)
                    good = np.repeat(places >= needed[owner[order[begin]]], np.diff(np.append(begin, len(order))))
                    pick = order[good]
                    if not len(pick):
                        continue
                    rows, owners, low, high = _ranges(at[pick], row[pick], owner[pick], place[pick], size, bounds)
                    likely = vocabulary.counts(hashes, owners, low, high) >= threshold * size[owners]
                    found: dict[tuple[int, int], tuple[int, int, int]] = {}
                    for r, o, u, v in zip(*(c[likely].tolist() for c in (rows, owners, low, high)), strict=True):
                        if o not in bags:
                            bags[o] = np.unique(items[o].words, return_counts=True)
                        text = hashes[u:v]
                        if _in_common(text, *bags[o]) >= threshold * size[o]:
                            score, one, two = align(text, items[o].words)
                            if score > found.get((r, o), (0, 0, 0))[0]:
                                found[r, o] = score, one + u - int(bounds[r]), two + u - int(bounds[r])
                    for (r, o), (score, one, two) in found.items():
                        if (share := score / (2 * int(size[o]))) >= threshold:
                            out.append((batch.column(0)[first + r].as_py(), items[o].item_id, share, one, two))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return run


def _blocks(benchmark: DataFrame) -> Iterator[list]:
    """The benchmark's rows in blocks of bounded bytes: as many passes as its size asks for, each holding only its own block."""
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // BLOCK_BYTES)
    for k in range(parts):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(parts)) == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and benchmark item of which it holds a copy: score (1: word for word) and the words it spans."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = docs.sparkSession.createDataFrame([], _FOUND)
    for rows in _blocks(benchmark):
        items = _items(rows)
        if items:
            found = found.union(docs.mapInArrow(_search(items, Seeds.of(items), threshold), _FOUND))
    return found


def op1_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
