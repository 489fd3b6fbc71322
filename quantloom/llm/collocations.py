"""Collocations: phrases of two to four words that occur together more than their parts do, mined by pivot partitioning.

Words are ordered by frequency.  Every occurrence of a frequent word, as the pivot, becomes a fragment: up to three words on
either side, cut where a piece ends or a word is rarer than the pivot (or, on the left, the pivot again).  Fragments are
routed to their pivot's bucket, equal ones as one with a number, and every phrase is counted where the fragments of its rarest
word are, once for each occurrence; a bucket sees all occurrences of the phrases that it owns, so what is rare is dropped there and never
shuffled.  A pivot with over ``SHARE`` occurrences is split by the word next to it, so that each phrase still has one owner; a bucket
that is yet too large for memory is counted in parts, whose sums Spark adds up.

The broadcast is bounded: (id, count) of at most ``RANKED`` words, those that are most frequent, and a bitmap
of 2 ** ``BITS`` bits that tells which others may be frequent.  Words beyond ``RANKED`` are rarer than all of these and ordered by
their ids.  Words are compared as 62-bit hashes of (lang, word), phrases in a bucket as 64-bit hashes of those.

Defined results: a null lang is ``und``, a null text is empty; repeated rows count each; a text of any length is cut into windows
between words; an empty table gives no rows; columns other than lang and text are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .textkernel import _LOWER, mix64, text_chunks, words

#: Fewest occurrences of a phrase, words of the longest, hundredths of a phrase's count that a longer one must have to cover it, phrases a language.
LEAST, LONGEST, COVER, TOP = 30, 4, 80, 2000
REACH = LONGEST - 1
RANKED, BITS = 1 << 20, 23
#: Occurrences of a pivot in one share; fragments that a map task collects before it sends them; that a bucket's task holds; distinct words that a task holds.
SHARE, SENT, HELD, KEPT = 1 << 20, 1 << 18, 1 << 21, 1 << 19
TAIL = 1 << 62
SALTS = 32
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True
#: (words left of the pivot, words right of it) of every phrase around it.
SPANS = [(a, n - 1 - a) for n in range(2, LONGEST + 1) for a in range(n)]


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of chunks of whole texts: languages, and of each word the index of its language, its id, piece, start and end, and the chunk's bytes."""
    for batch in batches:
        langs = batch.column(0).fill_null("und").dictionary_encode()
        names, of_row = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        seeds = np.array([_lang_hash(x) for x in names], np.uint64)
        for a, b, data, offsets in text_chunks(batch):
            hashes, start, end, bounds = words(data, offsets, sep=_GAP)
            if not len(hashes):
                continue
            row = np.repeat(np.arange(b - a), np.diff(bounds))
            lang = of_row[a:b][row]
            ids = (mix64(hashes ^ seeds[lang]) >> np.uint64(2)).astype(np.int64)
            # Breaks and texts before a word number its piece.
            piece = np.cumsum(_BREAK[data], dtype=np.int64)[start] + row
            yield names, lang, ids, piece, start, end, data


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The lower-cased words as an Arrow array."""
    size = end - start
    ends = np.concatenate([[0], np.cumsum(size)])
    flat = _LOWER[data[np.arange(ends[-1]) + np.repeat(start - ends[:-1], size)]].astype(np.uint8)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, id, word, n) of a task's words, and (lang, null, null, n) of all words of a language."""
    held: list[tuple] = []
    total: dict[str, int] = {}

    def combined() -> list[tuple]:
        langs, ids, n = (np.concatenate([h[k] for h in held]) for k in (0, 1, 2))
        texts = pa.concat_arrays([h[3] for h in held])
        _, first, inverse = np.unique(ids, return_index=True, return_inverse=True)
        return [(langs[first], ids[first], np.bincount(inverse, n).astype(np.int64), texts.take(pa.array(first)))]

    def out() -> Iterator[pa.RecordBatch]:
        for langs, ids, n, texts in held:
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(ids), texts, pa.array(n)], names=["lang", "id", "word", "n"])

    for names, lang, ids, _, start, end, data in _worded(batches):
        distinct, first, n = np.unique(ids, return_index=True, return_counts=True)
        held.append((np.array(names, object)[lang[first]], distinct, n, _texts(data, start[first], end[first])))
        for k, count in enumerate(np.bincount(lang, minlength=len(names)).tolist()):
            total[names[k]] = total.get(names[k], 0) + count
        if sum(len(h[1]) for h in held) > KEPT:
            held = combined()
            if len(held[0][1]) > KEPT // 2:
                yield from out()
                held = []
    if held:
        held = combined()
        yield from out()
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.nulls(len(total), pa.int64()), pa.nulls(len(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["lang", "id", "word", "n"])


def frequent_words(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, id, word, n) of the words with ``least`` occurrences and, with null id and word, of all words of each language."""
    texts = docs.select("lang", "text")
    found = texts.mapInArrow(_counted, "lang string, id long, word string, n long")
    return cut(found.groupBy("lang", "id").agg(F.min("word").alias("word"), F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("id").isNull()))


class Ranks:
    """Codes of words: the rank of a ranked one, ``TAIL`` + id of one that may be frequent beside these, -1 of others."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, tail: np.ndarray):
        order = np.lexsort((ids, -n))
        self.ids, self.shares = ids[order], np.maximum(1, -(-n[order] // SHARE))
        self.rank = np.argsort(self.ids)
        self.sorted, self.tail = self.ids[self.rank], tail

    def code(self, ids: np.ndarray) -> np.ndarray:
        code = np.full(len(ids), -1, np.int64)
        if len(self.tail):
            bit = ids & ((1 << BITS) - 1)
            may = self.tail[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
            code[may] = ids[may] + TAIL
        if len(self.sorted):
            at = np.searchsorted(self.sorted, ids)
            at[at == len(self.sorted)] = 0
            hit = self.sorted[at] == ids
            code[hit] = self.rank[at[hit]]
        return code

    def id(self, codes: np.ndarray) -> np.ndarray:
        out = codes - TAIL
        ranked = codes < TAIL
        out[ranked] = self.ids[codes[ranked]]
        return out

    def share(self, pivot: np.ndarray) -> np.ndarray:
        out = np.ones(len(pivot), np.int64)
        ranked = pivot < TAIL
        out[ranked] = self.shares[pivot[ranked]]
        return out


def ranks(frequent: DataFrame, most: int = RANKED) -> Ranks:
    """The ``most`` most frequent words, found by a histogram of counts, and a bitmap of the others."""
    known = frequent.where("id is not null").select("id", "n", F.floor(F.log2("n") * 16).alias("level"))
    room, low = most, None
    for level, count in sorted(((r["level"], r["count"]) for r in known.groupBy("level").count().collect()), reverse=True):
        if count > room:
            break
        room, low = room - count, level
    top = (known.where(F.col("level") >= low) if low is not None else known.limit(0)).select("id", "n").toArrow()
    tail = np.zeros(0, np.uint8)
    rest = known.where(F.col("level") < low) if low is not None else known
    place = F.expr(f"id & {(1 << BITS) - 1}") + 1
    parts = rest.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    if parts:
        tail = np.zeros(1 << BITS - 3, np.uint8)
        for k, bits in parts:
            tail[(k - 1) * len(bits) : k * len(bits)] = np.frombuffer(bits, np.uint8)
    return Ranks(top["id"].to_numpy(), top["n"].to_numpy(), tail)


def _around(code: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pivots, a matrix of their neighbours (-1 where there is none; the pivot in column ``REACH``) and the words left and right, of those with any."""
    n = len(code)
    padded = np.full(n + 2 * REACH, -1, np.int64)
    padded[REACH : REACH + n] = code
    where = np.full(n + 2 * REACH, -1, np.int64)
    where[REACH : REACH + n] = piece
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    open_l = open_r = code >= 0
    for j in range(1, REACH + 1):
        other, same = padded[REACH - j : REACH - j + n], where[REACH - j : REACH - j + n] == piece
        open_l = open_l & same & (other >= 0) & (other < code)
        left += open_l
        other, same = padded[REACH + j : REACH + j + n], where[REACH + j : REACH + j + n] == piece
        open_r = open_r & same & (other >= 0) & (other <= code)
        right += open_r
    pick = np.flatnonzero((left > 0) | (right > 0))
    matrix = padded[pick[:, None] + np.arange(2 * REACH + 1)]
    return pick, matrix, left[pick], right[pick]


def _cleared(matrix: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    column = np.arange(2 * REACH + 1) - REACH
    return np.where((column >= -left[:, None]) & (column <= right[:, None]), matrix, -1)


def _packed(matrix: np.ndarray, head: np.ndarray, count: np.ndarray) -> bytes:
    """Fragments as compressed byte planes: heads, numbers, then the codes that are there."""
    codes = matrix[matrix >= 0]
    planes = [head.tobytes(), count.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), codes.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()]
    return struct.pack("<ii", len(head), len(codes)) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, m = struct.unpack_from("<ii", packed)
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[8:], max_output_size=n + 8 * (n + m)), np.uint8)
    head = flat[:n]
    count = np.ascontiguousarray(flat[n : 9 * n].reshape(8, -1).T).view("<i8").ravel()
    codes = np.ascontiguousarray(flat[9 * n :].reshape(8, -1).T).view("<i8").ravel()
    column = np.arange(2 * REACH + 1) - REACH
    there = (column >= -(head & 3).astype(np.int8)[:, None]) & (column <= (head >> 2 & 3).astype(np.int8)[:, None])
    matrix = np.full(there.shape, -1, np.int64)
    matrix[there] = codes
    return matrix, head, count


def _row_hash(matrix: np.ndarray) -> np.ndarray:
    h = np.full(len(matrix), matrix.shape[1], np.uint64)
    for k in range(matrix.shape[1]):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + matrix[:, k].astype(np.uint64))
    return h


def _fragments(batches: Iterator[pa.RecordBatch], known: Broadcast, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, lang, packed fragments) of a task's texts."""
    table: Ranks = known.value
    held: list[tuple] = []
    names: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        lang, matrix, head = (np.concatenate([h[k] for h in held]) for k in range(3))
        pivot = matrix[:, REACH]
        split = np.flatnonzero(table.share(pivot) > 1)
        # Fragments of a frequent pivot: phrases with its right neighbour, and those that end at it, by that neighbour.
        left, right = head & 3, head >> 2 & 3
        with_right, with_left = split[right[split] > 0], split[left[split] > 0]
        whole = np.setdiff1d(np.arange(len(head)), split)
        take = np.concatenate([whole, with_right, with_left])
        next_to = np.concatenate([np.zeros(len(whole), np.int64), matrix[with_right, REACH + 1], matrix[with_left, REACH - 1]])
        head = np.concatenate([head[whole], head[with_right] | 16, left[with_left]]).astype(np.uint8)
        matrix = _cleared(matrix[take], (head & 3).astype(np.int8), (head >> 2 & 3).astype(np.int8))
        lang, pivot = lang[take], pivot[take]
        share = (mix64(next_to.astype(np.uint64)) % table.share(pivot).astype(np.uint64)).astype(np.uint64)
        bucket = (mix64(mix64(pivot.astype(np.uint64)) + share) % np.uint64(buckets)).astype(np.int64)
        key = _row_hash(np.column_stack([matrix, head]))
        order = np.lexsort((key, pivot, lang, bucket))
        bucket, lang, key = bucket[order], lang[order], key[order]
        new = np.ones(len(order), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(order)))
        matrix, head, bucket, lang = matrix[order[first]], head[order[first]], bucket[first], lang[first]
        edge = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1])]))
        label = list(names)
        rows = [(bucket[a], label[lang[a]], _packed(matrix[a:b], head[a:b], count[a:b])) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(head)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["bucket", "lang", "packed"])

    for some, lang, ids, piece, _, _, _ in _worded(batches):
        pick, matrix, left, right = _around(table.code(ids), piece)
        here = np.array([names.setdefault(x, len(names)) for x in some])
        held.append((here[lang[pick]], matrix, (left | right << 2).astype(np.uint8)))
        if sum(len(h[2]) for h in held) >= SENT:
            yield out()
            held = []
    if any(len(h[2]) for h in held):
        yield out()


def _mined(batches: Iterator[pa.RecordBatch], known: Broadcast, least: int) -> Iterator[pa.RecordBatch]:
    """(lang, ids, a, whole) of the phrases whose pivots are in a bucket; a stream sorted by bucket, of which one bucket's fragments, up to ``HELD``, are held.

    ``whole``: a counts all occurrences; else a part of them.
    """
    table: Ranks = known.value
    held: list[tuple] = []
    names: dict[str, int] = {}

    def out(whole: bool) -> Iterator[pa.RecordBatch]:
        matrix, head, count, lang = (np.concatenate([h[k] for h in held]) for k in range(4))
        label = np.array(list(names), object)
        for n in range(2, LONGEST + 1):
            rows, keys, sizes, langs = [], [], [], []
            for a, b in SPANS:
                if a + b + 1 == n:
                    pick = np.flatnonzero(((head & 3) >= a) & ((head >> 2 & 3) >= b) & ((head < 16) | (b > 0)))
                    part = matrix[pick, REACH - a : REACH + b + 1]
                    rows.append(part)
                    keys.append(_row_hash(part))
                    sizes.append(count[pick])
                    langs.append(lang[pick])
            rows, keys, sizes, langs = map(np.concatenate, (rows, keys, sizes, langs))
            if not len(keys):
                continue
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            total = np.add.reduceat(sizes[order], first)
            keep = total >= (least if whole else 1)
            at, total = order[first[keep]], total[keep]
            for k in range(0, len(at), 1 << 16):
                some = at[k : k + (1 << 16)]
                ids = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * n), pa.array(table.id(rows[some].ravel())))
                yield pa.RecordBatch.from_arrays([pa.array(label[langs[some]], pa.string()), ids, pa.array(total[k : k + (1 << 16)]), pa.array(np.full(len(some), whole))], names=["lang", "ids", "a", "whole"])

    bucket, whole = None, True
    for batch in batches:
        for b, lang, packed in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
            if b != bucket:
                if held:
                    yield from out(whole)
                bucket, whole, held = b, True, []
            matrix, head, count = _unpacked(packed)
            held.append((matrix, head, count, np.full(len(head), names.setdefault(lang, len(names)))))
            if sum(len(h[1]) for h in held) > HELD:
                whole = False
                yield from out(whole)
                held = []
    if held:
        yield from out(whole)


def frequent_phrases(docs: DataFrame, frequent: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, ids, a): phrases of two to ``LONGEST`` words with ``least`` occurrences; ids of their words in order."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(ranks(frequent))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = frequent.where("id is null").agg(F.sum("n")).first()[0] or 0
    buckets = max(parts, -(-total // (HELD // 2)))
    sent = docs.select("lang", "text").mapInArrow(lambda it: _fragments(it, known, buckets), "bucket long, lang string, packed binary")
    sent = sent.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket")
    found = cut(sent.mapInArrow(lambda it: _mined(it, known, least), "lang string, ids array<long>, a long, whole boolean"))
    parted = found.where("not whole").groupBy("lang", "ids").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return found.where("whole").select("lang", "ids", "a").union(parted)


def _cut_score(k: int) -> Column:
    """(score, k, l, r) of the cut behind the first k words; decimals, as products may pass 64 bits."""
    score = F.expr(f"(cast(a as decimal(20,0)) * cast(2000000 as decimal(18,0))) div (cast(l{k} as decimal(20,0)) + r{k})")
    return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))


def scored_phrases(phrases: DataFrame, frequent: DataFrame, cover: int = COVER) -> DataFrame:
    """(lang, ids, a, l, r, score) of the phrases that no longer one covers."""
    phrases = cut(phrases)
    known = phrases.select(F.col("ids").alias("part"), F.col("a").alias("f")).union(frequent.where("id is not null").select(F.array("id"), "n"))
    cuts = range(1, LONGEST)
    sides = [f"named_struct('side', '{s}{k}', 'part', slice(ids, {a}, {n}))" for k in cuts for s, a, n in (("l", 1, k), ("r", k + 1, f"greatest(size(ids) - {k}, 0)"))]
    asked = phrases.select("lang", "ids", "a", F.explode(F.expr(f"filter(array({', '.join(sides)}), x -> size(x.part) > 0 and size(x.part) < size(ids))")).alias("x")).select("lang", "ids", "a", "x.side", "x.part")
    asked = asked.where(F.expr(f"cast(substr(side, 2) as int) < size(ids)")).join(known, "part")
    found = asked.groupBy("lang", "ids", "a").agg(*[F.max(F.when(F.col("side") == f"{s}{k}", F.col("f"))).alias(f"{s}{k}") for k in cuts for s in "lr"])
    inner = ", ".join(f"slice(ids, {a}, {n})" for n in range(2, LONGEST) for a in range(1, LONGEST - n + 2))
    inner = phrases.where(F.size("ids") > 2).select("a", "ids", F.explode(F.array_distinct(F.expr(f"filter(array({inner}), x -> size(x) >= 2 and size(x) < size(ids))"))).alias("part"))
    longer = inner.groupBy(F.col("part").alias("ids")).agg(F.max("a").alias("most"))
    left = found.join(longer, "ids", "left").where(F.expr(f"most is null or cast(most as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * {cover}"))
    best = F.array_min(F.array_compact(F.array(*[_cut_score(k) for k in cuts]))).alias("best")
    return left.select("lang", "ids", "a", best).select("lang", "ids", "a", "best.l", "best.r", F.col("best.score").cast("long").alias("score"))


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """The query's columns: the first ``top`` phrases of each language by score, count and text.

    Ranks by score and count are taken in ``SALTS`` shares of a language first, ties kept; only what is left gets its text.
    """
    frequent = frequent_words(docs, least)
    scored = scored_phrases(frequent_phrases(docs, frequent, least), frequent, cover)
    order = [F.desc("score"), F.desc("a")]
    share = scored.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)))
    some = share.withColumn("place", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    some = cut(some.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("salt", "place"))
    texts = frequent.where("id is not null").select("id", "word")
    spelt = some.select("ids", F.posexplode("ids").alias("at", "id")).join(texts, "id").groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    total = frequent.where("id is null").select("lang", "n")
    rows = some.join(spelt, "ids").join(F.broadcast(total), "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM lists, (SELECT unnest(range(1, 5)) AS m) WHERE len(w) >= m),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND a >= 30),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[:k], ' ') AS lp, array_to_string(w[k + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
scores AS (SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, 2000000::HUGEINT * c.a // (l.a + r.a) AS score FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM cand WHERE m > 2))),
longer AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL),
kept AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, b.a DESC, phrase) AS rank FROM best b LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM kept JOIN totals USING (lang) WHERE rank <= 2000"""
