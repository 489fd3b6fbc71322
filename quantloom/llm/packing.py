"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Tokens are those of a byte-level BPE vocabulary file.  Texts are split into pre-tokens by numpy over code
points, each distinct pre-token of a batch is encoded once (and remembered), and the ids of a text are
gathered from them.  A document's ids and an end mark are cut, only where they are too long, into full
sequences; the first piece takes the remainder, so each document has at most one piece that needs
packing.  Pieces are dealt by a hash of id and text into groups of bounded size; a group packs on its own: fill a bin
greedily with the largest piece that fits, then replace the bin's smallest piece by two unpacked pieces
that fill the expanded gap more tightly.  A group wastes at most part of its last bins, so the total is
within a few bins per ``GROUP`` documents of packing everything at once.

Defined results: a null or empty text has the end mark alone; a null doc_id stays null; repeated rows are packed
each; an empty table gives no rows; a very long text is tokenised in windows; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .cluster import sorted_groups
from .textkernel import mix64, powers, text_chunks

CAPACITY, END = 1024, 2
#: Documents in a group that is packed by one call.
GROUP = 16384
_CACHE = 1 << 17
#: Characters that are tokenised at once, about; numpy temporaries are about 60 times as large in bytes.
_WINDOW = 1 << 20
#: Pieces of a group that are packed by one call, at most; a larger group (many equal rows) is packed in parts.
MOST = 1 << 17

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """White space, letter, number or other, of every code point."""
    out = np.full(0x110000, _OTHER, np.uint8)
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4").tobytes().decode("utf-32-le")
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = (x if x < 0xD800 else x + 0x800 for x in m.span())
            out[a:b] = kind
    return out


def pre_tokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of some texts start, in code points.

    The rules of the vocabulary's pattern: runs of letters, of numbers and of other signs, each with one
    space before it; the contractions 's 't 're 've 'm 'll 'd; white space without its last character if
    something follows.
    """
    n = len(points)
    kind = _kinds()[points]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    new = np.ones(n, bool)
    new[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    space = kind == _SPACE
    # A run of white space that something follows gives its last character away: a plain space to what follows, any other to a token of its own.
    follows = np.zeros(n, bool)
    follows[:-1] = space[:-1] & ~space[1:] & ~edge[1:n]
    last = np.flatnonzero(follows)
    plain = last[points[last] == 32]
    new[last] = True
    new[plain + 1] = False
    # Contractions: an apostrophe that starts a token and is the whole run of signs.
    mark = np.flatnonzero((points == 39) & new)
    if len(mark):
        padded = np.concatenate([points, np.zeros(3, points.dtype)])
        ends = offsets[np.searchsorted(offsets, mark, "right")]
        one, two = padded[mark + 1], padded[mark + 2]
        letter = (mark + 1 < ends) & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = (mark + 2 < ends) & (((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108))
        for size, at in ((1, mark[letter]), (2, mark[pair])):
            new[at + 1] = False
            rest = at + 1 + size
            rest = rest[rest < n]
            new[rest] |= ~edge[rest] & (kind[rest] == _LETTER)
    return np.flatnonzero(new)


def _windows(text: str) -> Iterator[str]:
    """A long text in parts that are tokenised like the whole: each ends before a single space between two letters or digits, where the next pre-token starts."""
    a = 0
    while a < len(text):
        b = a + _WINDOW
        while b < len(text):
            b = text.find(" ", b)
            if b < 0 or b + 1 >= len(text):
                b = len(text)
            elif text[b - 1].isalnum() and text[b + 1].isalnum():
                break
            else:
                b += 1
        yield text[a:b]
        a = b


class Encoder:
    """ids of texts by a byte-level BPE vocabulary."""

    def __init__(self, name: str = "byte_bpe_50k") -> None:
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.words = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[int, list[int]] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. One in which the name of a special token stands, which is then that token, is left to the tokenizer itself."""
        odd = {i for i, t in enumerate(texts) if any(s in t for s in self.special)}
        long = {i for i, t in enumerate(texts) if len(t) > _WINDOW} - odd
        out = self._encode(["" if i in odd or i in long else t for i, t in enumerate(texts)])
        for i in long:
            out[i] = np.concatenate([ids for part in _windows(texts[i]) for ids in self._encode([part])])
        for i in odd:
            out[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        sizes = np.array([len(t) for t in texts])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        text = "".join(texts)
        if not text:
            return [np.zeros(0, np.uint32) for _ in texts]
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        start = pre_tokens(points, offsets)
        end = np.append(start[1:], len(points))
        pw, inv = powers(len(points))
        prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix64(points.astype(np.uint64) + np.uint64(1)) * pw[: len(points)], out=prefix[1:])
        keys = mix64((prefix[end] - prefix[start]) * inv[start])
        distinct, where, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > _CACHE:
            self.known.clear()
        known, encode = self.known, self.words._core_bpe.encode_ordinary
        ids = []
        for key, a, b in zip(distinct.tolist(), start[where].tolist(), end[where].tolist(), strict=True):
            found = known.get(key)
            if found is None:
                known[key] = found = encode(text[a:b])
            ids.append(found)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        first = np.concatenate([[0], np.cumsum(size)])[which]
        count = size[which]
        total = np.concatenate([[0], np.cumsum(count)])
        gathered = flat[np.repeat(first - total[:-1], count) + np.arange(total[-1])]
        bounds = total[np.searchsorted(start, offsets)]
        return [gathered[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _pieces(capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        mark = np.array([end], np.uint32)
        for batch in batches:
            out: dict[str, list[int]] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "pack_group")}
            for a, b, _, _ in text_chunks(batch):
                texts = ["" if t is None else t for t in batch.column(1).slice(a, b - a).to_pylist()]
                names, deals = (batch.column(k).slice(a, b - a).to_pylist() for k in (0, 2))
                for name, deal, ids in zip(names, deals, encoder.encode(texts), strict=True):
                    ids = np.concatenate([ids, mark])
                    first = len(ids) % capacity or capacity
                    cuts = [0, *range(first, len(ids) + 1, capacity)]
                    for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        for c, v in zip(out, (name, k, x, y - x, zlib.crc32(ids[x:y].tobytes()), deal), strict=True):
                            out[c].append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return run


def best_two_fit(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins, each a list of the places in ``lengths`` of its pieces."""
    by_length: dict[int, list[int]] = {}
    for i, length in enumerate(lengths):
        by_length.setdefault(length, []).append(i)
    there = sum(1 << length for length in by_length)  # bit k: a piece of length k is unpacked

    def largest(most: int) -> int:
        return (there & ((2 << most) - 1)).bit_length() - 1 if most > 0 else 0

    def take(length: int) -> int:
        nonlocal there
        found = by_length[length].pop()
        if not by_length[length]:
            there &= ~(1 << length)
        return found

    def give(i: int) -> None:
        nonlocal there
        by_length[lengths[i]].append(i)
        there |= 1 << lengths[i]

    bins = []
    while there:
        content, gap = [], capacity
        while (length := largest(gap)) > 0:
            content.append(take(length))
            gap -= length
        if gap and there:
            smallest = min(content, key=lambda i: lengths[i])
            room = gap + lengths[smallest]
            best, pair = lengths[smallest], None
            one = largest(room - 1)
            while one > 0 and 2 * one > best:
                two = largest(min(room - one, one))
                if two == one and len(by_length[one]) < 2:
                    two = largest(min(room - one, one - 1))
                if two > 0 and one + two > best:
                    best, pair = one + two, (one, two)
                    if best == room:
                        break
                one = largest(one - 1)
            if pair:
                content.remove(smallest)
                content += [take(pair[0]), take(pair[1])]
                give(smallest)
        bins.append(content)
    return bins


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number = None, 0
        for rows in sorted_groups(batches, ["pack_group"], MOST):
            lengths = rows.column("length").to_pylist()
            group = rows.column("pack_group")[0].as_py()
            last, number = group, number if group == last else 0
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for content in best_two_fit(lengths, capacity):
                at = 0
                for i in content:
                    sequence[i], offset[i] = (group << 32) + number, at
                    at += lengths[i]
                number += 1
            columns = [rows.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece: its document, its place there and its sequence."""
    groups = max(1, -(-docs.count() // GROUP))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # Dealt by id and text: the same whichever task handles a row and in whatever order, so a task that is run again deals alike.
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)))
    pieces = rows.mapInArrow(_pieces(capacity, end), "doc_id long, piece int, start long, length long, ids_crc32 long, pack_group long")
    dealt = pieces.repartition(min(groups, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "pack_group")
    order = ["pack_group", "doc_id", "piece", "length", "ids_crc32"]
    return dealt.sortWithinPartitions(*order).mapInArrow(_pack(capacity), _PACKED)


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
