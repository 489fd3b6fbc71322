import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quantloom.llm import cluster
from quantloom.llm.cluster import connected_components
from quantloom.llm.minhash_dedup import _across, _full, near_duplicates, odd_sketch
from quantloom.llm.paragraph_dedup import repeated_paragraphs

from .corpus import components, near_copies, sentence, shingles, tokens, vocabulary


def test_components_equal_union_find(spark, monkeypatch):
    rnd = random.Random(2)
    for n, m, most in ((60, 40, 1 << 17), (200, 199, 25), (60, 40, 7)):
        monkeypatch.setattr(cluster, "EDGES", most)  # one task, and several rounds over many
        links = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] + [(i, i + 1) for i in range(0, n - 1, 3)] if m < n - 1 else [(i, i + 1) for i in range(n - 1)]
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(7)).collect()}
        want = components(n, links)
        assert all(got.get(i, i) == want[i] for i in range(n))


def test_near_duplicates_equal_brute_force(spark):
    docs = near_copies()
    sets = [shingles(t) for _, t in docs]
    links = [(a, b) for a, b in itertools.combinations(range(len(docs)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(len(docs), links)
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"key": F.lit(1), "hub": F.lit("h")})
    got = {r["doc_id"]: r for r in near_duplicates(rows.repartition(5)).collect()}
    assert len(got) == len(docs)
    for i, _ in docs:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_near_duplicates_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(rows).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (None, 2, None, True), (4, 2, 2, False), (4, 2, 2, False), (2, 2, 2, True), (9, 0, 9, True)], key=str)


def test_repeated_passages_are_found_and_clean_documents_left(spark):
    rnd = random.Random(9)
    words = vocabulary(rnd, 3000)
    docs, planted = [], set()
    passage = [sentence(rnd, words, 55) for _ in range(6)]
    for i in range(120):
        lines = [sentence(rnd, words, rnd.randint(8, 70)) for _ in range(rnd.randint(1, 6))]
        if i % 4 == 0:
            k = rnd.randrange(len(lines))
            lines[k] = f"{sentence(rnd, words, 12)} {passage[i % 6]} {sentence(rnd, words, 9)}" if i % 8 else passage[i % 6]
            planted.add(i)
        lines.append("Licensed under some license, version 2")
        docs.append((i, "\n".join(lines)))
    docs += [(200, None), (201, ""), (None, docs[0][1])]
    got = repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"] for r in got} == planted
    by_id = dict(docs)
    assert all(0 <= r["start_word"] < r["end_word"] <= len(tokens(by_id[r["doc_id"]])) for r in got)
    clusters = {}
    for r in got:
        clusters.setdefault(r["cluster_id"], []).append(r)
    assert all(sum(r["kept"] for r in c) <= 1 for c in clusters.values()) and sum(r["kept"] for r in got) >= 6


def test_near_paragraphs_join_one_cluster(spark):
    rnd = random.Random(11)
    words = vocabulary(rnd, 2000)
    base = sentence(rnd, words, 60)
    docs = [(i, f"{base} tail{i}") for i in range(3)] + [(3, sentence(rnd, words, 60))]
    assert repeated_paragraphs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = [r for r in repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect() if (r["start_word"], r["end_word"]) == (0, 61)]
    assert sorted(r["doc_id"] for r in got) == [0, 1, 2] and len({r["cluster_id"] for r in got}) == 1
    assert [r["doc_id"] for r in got if r["kept"]] == [0]


def test_paragraph_clusters_equal_brute_force(spark):
    rnd = random.Random(5)
    words = vocabulary(rnd, 3000)
    texts = []
    for _ in range(6):
        base = sentence(rnd, words, 13).split(" ")  # too short for a content-defined cut
        for _ in range(40):
            a, b = rnd.randint(0, 2), rnd.randint(0, 2)
            texts.append(" ".join([*(rnd.choice(words[:4]) for _ in range(a)), *base[a : 13 - b], *(rnd.choice(words[:4]) for _ in range(b))]))
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(len(texts), links)
    got = repeated_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), least_words=1).collect()
    clusters = {}
    for r in got:
        clusters.setdefault(r["cluster_id"], set()).add(r["doc_id"])
    groups = {}
    for i, c in enumerate(want):
        groups.setdefault(c, set()).add(i)
    assert sorted(map(sorted, clusters.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_near_duplicate_lines_are_found_as_a_whole(spark):
    rnd = random.Random(6)
    words = vocabulary(rnd, 4000)
    docs = []
    for i in range(60):
        base = sentence(rnd, words, 44).split(" ")
        other = list(base)
        other[rnd.randint(8, 35)] = "edited"
        docs += [(2 * i, " ".join(base)), (2 * i + 1, f"{sentence(rnd, words, 9)}\n{' '.join(other)}")]
    got = {(r["doc_id"], r["start_word"], r["end_word"], r["kept"]) for r in repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    whole = [i for i in range(60) if (2 * i, 0, 44, True) in got and (2 * i + 1, 9, 53, False) in got]
    assert len(whole) >= 57  # eight bands of two rows miss a pair at the threshold with a chance of one in 750
    assert not any(d % 2 and (a, b) != (9, 53) for d, a, b, _ in got if d // 2 in whole)


def test_sketches_of_long_texts_let_similar_pairs_pass():
    rng = np.random.default_rng(4)
    for union in (500, 40_000):
        for _ in range(150):
            every = rng.integers(0, 1 << 64, union, dtype=np.uint64)
            pair = [np.sort(every[: union - union // 8]), np.sort(np.concatenate([every[: union - union // 4], every[union - union // 8 :]]))]  # similarity 0.75
            (n, a), (m, b) = map(odd_sketch, pair)
            columns = {"doc_id": [1, 2], "component": [1, 2], "n_shingles": [len(pair[0]), len(pair[1])], "occupied": [n, m], "block": [0, 0], "odd": [x.view(np.int64).tolist() for x in (a, b)], "shingles": [x.view(np.int64).tolist() for x in pair], "key": [0, 0], "i": [0, 0], "j": [0, 0], "left": [False, True], "minor": [False, True]}
            assert sum(r.num_rows for r in _across(0.75)(iter([pa.RecordBatch.from_pydict(columns)]))) == 1


def test_blocks_return_a_spanning_set_of_links(spark):
    rnd = random.Random(3)
    words = vocabulary(rnd, 2000)
    base = sentence(rnd, words, 60).split(" ")
    texts = [" ".join([*base[: 60 - k], *(rnd.choice(words) for _ in range(k))]) for k in (0, 2, 4, 8, 12, 20, 30) for _ in range(20)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    names = "key long, i int, j int, left boolean, minor boolean, component long"
    held = [r for i in range(len(texts)) for r in [(i, 1, 0, 0, False, i > 0, i), *([(i, 1, 0, 0, True, True, i)] if i else [])]]
    met = spark.createDataFrame(held, f"doc_id long, {names}").join(rows.mapInArrow(_full, "doc_id long, n_shingles long, occupied int, odd array<long>, shingles array<long>"), "doc_id")
    got = [tuple(r) for r in met.coalesce(1).sortWithinPartitions("key", "i", "j").mapInArrow(_across(0.75), "a long, b long").collect()]
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(len(texts), links)
    assert set(got) <= set(links) and len(got) == len(texts) - len(set(want))
    assert components(len(texts), got) == want
