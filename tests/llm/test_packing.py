import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm import packing
from quantloom.llm.cluster import sorted_groups
from quantloom.llm.packing import Encoder, best_two_fit, pack

BITS = ["'s", "'S", "'re", "'ll", "'d", "it", " ", "  ", "\n", "\t", " \n ", "é", "漢字", "12", "٣", "!", "?!", "'", " ", "　", "<|endoftext|>", "x", "😀", "don't", " 'tis", "\r\n", "́"]


def test_ids_equal_the_tokenizer(monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    texts += ["", "'", " '", "'r", "'s", "a's", "a 's", "''s", " ", "\n", "end \n", "x'l", "x'ly"]
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for window in (packing._WINDOW, 7):  # a very long text is tokenised in windows
        monkeypatch.setattr(packing, "_WINDOW", window)
        for text, ids in zip(texts, Encoder().encode(texts), strict=True):
            assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_best_two_fit_packs_everything_tightly():
    rnd = random.Random(5)
    lengths = [rnd.randint(1, 1024) for _ in range(3000)] + [1024] * 5
    bins = best_two_fit(lengths)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 1024 for b in bins)
    assert len(bins) <= int(np.ceil(sum(lengths) / 1024) * 1.01) + 1
    assert best_two_fit([]) == []


def test_two_replace_the_smallest():
    # greedy takes 600 + 300 and leaves 124; 300 gives way to 212 + 212
    bins = best_two_fit([600, 300, 212, 212])
    assert [600, 212, 212] in [[[600, 300, 212, 212][i] for i in b] for b in bins]


def test_pieces_hold_the_whole_contract(spark, monkeypatch):
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choice(BITS) for _ in range(rnd.choice([0, 3, 200, 900, 2500])))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "no id"), (7, docs[7][1]), (7, docs[7][1]), (8, "other text of an id"), (102, "a" * 30000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"piece": F.lit("x"), "length": F.lit(1), "pack_group": F.lit("y")})
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in docs:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        at = 0
        for k, n in enumerate([first, *[1024] * ((len(ids) - first) // 1024)]):
            want.append((i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
        assert at == len(ids)
    assert max(w[1] for w in want) >= 2
    for most in (packing.MOST, 1000):
        monkeypatch.setattr(packing, "MOST", most)
        got = pack(rows.repartition(5)).collect()
        assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
        places = {}
        for r in got:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in places.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at
                at += n
            assert at <= 1024
        assert len(places) <= -(-sum(w[3] for w in want) // 1024) + 3
    assert sorted(map(str, pack(rows.repartition(3)).collect())) == sorted(map(str, pack(rows.repartition(7)).collect()))
    assert pack(rows.where("false")).count() == 0


def test_groups_of_a_sorted_stream():
    rnd = random.Random(2)
    keys = sorted(rnd.choice([1, 2, 2, 2, 3, 9]) for _ in range(400))
    rows = pa.RecordBatch.from_pydict({"k": keys, "x": list(range(400))})
    cuts = sorted({0, 400, *(rnd.randrange(400) for _ in range(12))})
    batches = [rows.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    for most in (None, 1, 50, 1000):
        got = list(sorted_groups(iter(batches), ["k"], most))
        assert [x for g in got for x in g.column("x").to_pylist()] == list(range(400))
        assert all(len(set(g.column("k").to_pylist())) == 1 and g.num_rows <= (most or 400) for g in got)
        if not most:
            assert len(got) == 4
