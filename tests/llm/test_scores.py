import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from quantloom.llm import quality, toxicity
from quantloom.llm.decontamination import align, contaminated
from quantloom.llm.fingerprints import Fingerprint, edited_fingerprints, fingerprints
from quantloom.llm.pitman_yor import MOST_CONTEXTS, THETA1, THETA2, Frequent, Part, Seating, Shared, _compact_parts, _compact_row, _frequent, _least_level, reseated, restaurants, score_texts, sweeps
from quantloom.llm.textkernel import words as kernel_words

from .corpus import LOWER, edited, sentence, shingles, tokens, vocabulary


def test_decontamination_finds_copies_and_edits_only(spark):
    rnd = random.Random(1)
    words = vocabulary(rnd, 5000)
    items = [(i, sentence(rnd, words, rnd.randint(16, 60))) for i in range(20)] + [(20, None), (21, ""), (22, "two words")]
    docs, want = [], set()
    for i in range(200):
        text = sentence(rnd, words, rnd.randint(5, 300))
        if i % 10 == 0:
            k = i // 10
            copy = edited(rnd, items[k][1], 4, words) if k % 2 else items[k][1].upper()
            text = f"{text} {copy} {sentence(rnd, words, 30)}"
            want.add((i, k))
        docs.append((i, text))
    docs += [(500, None), (501, "")]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_of_often_copied_and_short_items(spark):
    rnd = random.Random(8)
    words = vocabulary(rnd, 5000)
    items = [(0, sentence(rnd, words, 40)), (1, "zzq yyk"), (2, "xxj wwv uub ttf")]
    docs = [(i, f"{sentence(rnd, words, 20)} {edited(rnd, items[0][1], 14, words)} {sentence(rnd, words, 20)}") for i in range(600)]
    want = {(i, 0) for i, t in docs if 2 * plain_alignment(tokens(t), items[0][1].translate(LOWER).split()) >= 2 * 40}
    docs += [(1000, sentence(rnd, words, 9) + " zzq yyk " + sentence(rnd, words, 9)), (1001, sentence(rnd, words, 9) + " wwv uub " + sentence(rnd, words, 9))]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(1000, 1), (1001, 2)} and len(want) > 500


def test_recall_of_often_copied_items(spark):
    """Copies of one item in 1,000 documents, with words replaced: what all pairs find is found."""
    rnd = random.Random(13)
    words = vocabulary(rnd, 3000)
    items = [(n, sentence(rnd, words, n)) for n in (8, 9, 10, 12, 20)]
    docs, want = [], set()
    for n, item in items:
        for rate in (0.15, 0.25, 0.30):
            for _ in range(1000):
                copy = " ".join(rnd.choice(words) if rnd.random() < rate else w for w in item.split(" "))
                docs.append((len(docs), f"{sentence(rnd, words, 6)} {copy} {sentence(rnd, words, 6)}"))
                if plain_alignment(tokens(docs[-1][1]), tokens(item)) >= n:
                    want.add((docs[-1][0], n))
    found = contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got <= want and len(want) > 10000
    for n, _ in items:
        for k, rate in enumerate((0.15, 0.25, 0.30)):
            block = range(1000 * (3 * [i for i, _ in items].index(n) + k), 1000 * (3 * [i for i, _ in items].index(n) + k + 1))
            own = {(i, n) for i in block} & want
            assert len(own & got) >= 0.98 * len(own), (n, rate)


def test_long_texts_and_many_hits(spark, monkeypatch):
    """A text beyond a kernel window, and more hits than are listed at once."""
    from quantloom.llm import decontamination

    monkeypatch.setattr(decontamination, "HITS", 50)
    rnd = random.Random(17)
    words = vocabulary(rnd, 400)
    item = sentence(rnd, words, 20)
    long = sentence(rnd, words, 500_000) + f" {item} " + sentence(rnd, words, 1000)
    docs = [(0, long), (1, f"{item} " * 40), (2, sentence(rnd, words, 50))]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["score"]) for r in got} == {(0, 1.0), (1, 1.0)}
    assert next(r["first_word"] for r in got if r["doc_id"] == 0) == 500_000


def test_decontamination_equals_all_pairs(spark):
    rnd = random.Random(21)
    words = vocabulary(rnd, 60)  # few words, so that most seeds are frequent
    items = [(k, sentence(rnd, words, n)) for k, n in enumerate([1, 2, 3, 7, 8, 12, 20, 40])] + [(2, "a second item of a number"), (None, sentence(rnd, words, 15)), (50, None), (51, " ")]
    docs = []
    for i in range(150):
        text = sentence(rnd, words, rnd.randint(0, 60))
        if i % 3 == 0:
            copy = rnd.choice(items)[1] or ""
            text = f"{text} {edited(rnd, copy, rnd.randint(0, len(copy.split()) // 3 + 1), words)} {sentence(rnd, words, 9)}"
        docs.append((i, text))
    docs += [(7, docs[0][1]), (None, docs[3][1]), (200, None), (201, ""), (202, " ".join(sentence(rnd, words, 500) for _ in range(4)) + f" {items[7][1]} z")]
    plain = lambda t: (t or "").lower().split()
    want = []
    for d, text in docs:
        for k, item in items:
            if plain(item) and plain_alignment(plain(text), plain(item)) >= len(plain(item)):
                want.append((d, k, plain_alignment(plain(text), plain(item)) / 2 / len(plain(item))))
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit("x"), "score": F.lit(1)})
    marks = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("y"))
    for parts in (1, 7):  # what stands beside a document changes nothing
        got = [(r["doc_id"], r["item_id"], r["score"]) for r in contaminated(rows.repartition(parts), marks).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert contaminated(rows, marks.where("false")).count() == 0 == contaminated(rows.where("false"), marks).count()


def plain_alignment(a, b):
    best, row = 0, [0] * (len(a) + 1)
    for y in b:
        new = [0]
        for i, x in enumerate(a):
            new.append(max(0, row[i] + (2 if x == y else -1), row[i + 1] - 1, new[i] - 1))
        row = new
        best = max(best, *row)
    return best


def test_alignment_equals_plain_smith_waterman():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = [np.array([rnd.randrange(6) for _ in range(rnd.randint(1, 30))], np.uint64) for _ in range(2)]
        score, first, last = align(a, b)
        assert score == plain_alignment(a.tolist(), b.tolist())
        if score:
            assert plain_alignment(a[first : last + 1].tolist(), b.tolist()) == score


def labelled(rnd, n=1400):
    words = vocabulary(rnd)
    docs, labels = [], []
    for i in range(n):
        text = sentence(rnd, words, rnd.randint(20, 120))
        toxic, bad = i % 7 == 0, i % 3 == 0
        if toxic:
            text = " ".join(w if rnd.random() > 0.1 else rnd.choice(["vile", "scum", "filth"]) for w in text.split(" "))
        if bad:
            text = " ".join(w + rnd.choice(["***", "###", "$$$"]) for w in text.split(" "))
        docs.append((i, text))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    return docs + [(n, None), (n + 1, "")], labels


def accuracy(scored, labels, at):
    got = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert all(0 <= s <= 1 for s in got.values())
    return sum((got[i] >= at) == bool(y) for i, y in labels) / len(labels)


def test_classifiers_on_held_out_rows(spark):
    docs, labels = labelled(random.Random(4))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    held = lambda i, m, k: zlib.crc32(str(i).encode()) % m == k
    q = spark.createDataFrame([(i, a) for i, a, _ in labels if not held(i, 3, 1)], "doc_id long, label int")
    assert accuracy(quality.score(rows, quality.fit(rows, q)), [(i, a) for i, a, _ in labels if held(i, 3, 1)], 0.5) > 0.95
    t = spark.createDataFrame([(i, b) for i, _, b in labels if not held(i, 4, 2)], "doc_id long, label int")
    model = toxicity.fit(rows, t, rows.select("doc_id"))
    assert accuracy(toxicity.score(rows, model), [(i, b) for i, _, b in labels if held(i, 4, 2)], toxicity.THRESHOLD) > 0.95
    wide = rows.withColumn("score", F.lit("x"))
    assert toxicity.without_toxic(wide, model).columns == wide.columns


def test_compression_scores_equal_plain_ones(spark):
    docs, labels = labelled(random.Random(14), 500)
    docs += [(3, docs[3][1]), (None, docs[4][1]), (900, "long " * 200000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("s"), "label": F.lit(5), "feature": F.lit(1)})
    marks = spark.createDataFrame([(i, a) for i, a, _ in labels] + [(None, 1), (5, 7)], "doc_id long, label int")
    model = quality.fit(rows, marks)
    assert model == quality.fit(rows.repartition(5), marks.repartition(3))
    one, two = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.bad, model.good))
    want = []
    for i, text in docs:
        raw = (text or "").encode()
        gain = sum(len(one.compress(raw[k : k + 512])) - len(two.compress(raw[k : k + 512])) for k in range(0, len(raw), 512)) / max(1, len(raw))
        want.append((str(i), round(1 / (1 + math.exp(-(model.slope * gain + model.intercept))), 9)))
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in quality.score(rows.repartition(4), model).collect()) == sorted(want)


def test_risk_and_its_gradient():
    rng = np.random.default_rng(3)
    for prior, shift, below in ((0.2, 0.0, False), (0.9, 3.0, True)):
        margin = rng.normal(size=30)
        margin[:10] += shift  # positives that look positive: the estimated risk of negatives is below zero
        on_p, on_u = margin[:10], margin[10:]
        loss = lambda f: np.log1p(np.exp(-f))
        parts = lambda p, u, prior=prior: (prior * loss(p).mean(), loss(-u).mean() - prior * loss(-p).mean())
        whole = lambda m: sum(parts(m[:10], m[10:]))
        negative = lambda m: -parts(m[:10], m[10:])[1]
        one, two = parts(on_p, on_u)
        assert (two < 0) == below
        value, slope = toxicity.risk(margin, 10, prior)
        assert abs(value - one - max(0, two)) < 1e-12
        f = negative if below else whole
        numeric = [(f(margin + 1e-5 * e) - f(margin - 1e-5 * e)) / 2e-5 for e in np.eye(30)]
        assert np.abs(slope - numeric).max() < 1e-8


def test_toxicity_scores_equal_plain_ones(spark):
    docs, labels = labelled(random.Random(16), 400)
    docs += [(3, docs[3][1]), (None, docs[7][1]), (900, "vile " + "long " * 300000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("s"), "label": F.lit(5), "words": F.lit(1)})
    marks = spark.createDataFrame([(i, b) for i, _, b in labels] + [(None, 1), (5, 7)], "doc_id long, label int")
    model = toxicity.fit(rows, marks, rows.select("doc_id"))
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    hashed = lambda w: int(kernel_words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0])
    want = []
    for i, text in docs:
        margin = model.intercept + sum(weight.get(hashed(w), 0.0) for w in set(tokens(text)))
        want.append((str(i), round(1 / (1 + math.exp(-margin)), 9)))
    assert len(weight) and sorted((str(r["doc_id"]), round(r["score"], 9)) for r in toxicity.score(rows.repartition(4), model).collect()) == sorted(want)
    kept = toxicity.without_toxic(rows, model)
    assert kept.columns == rows.columns and kept.count() == sum(s < toxicity.THRESHOLD for _, s in want)
    assert toxicity.without_toxic(rows.where("false"), model).count() == 0 == toxicity.score(rows.where("false"), model).count()


def test_classifiers_without_labels(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, label int")
    assert quality.score(rows, quality.fit(rows, none)).count() == 2
    assert {r["score"] < 1e-9 for r in toxicity.score(rows, toxicity.fit(rows, none, rows.select("doc_id"))).collect()} == {True}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score(empty, quality.fit(empty, none)).count() == 0


def test_fingerprints(spark):
    rnd = random.Random(5)
    words = vocabulary(rnd)
    docs = [(i, sentence(rnd, words, rnd.randint(0, 900)) or None) for i in rnd.sample(range(1000), 60)] + [(2000, "same text here"), (2001, "same text here"), (2002, ""), (None, "of no id é漢")]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"slot": F.lit("s"), "extra": F.lit(1), "top": F.lit(2), "fingerprint": F.lit("f")})
    order = sorted(docs, key=lambda d: -1 if d[0] is None else d[0], reverse=True)
    for size in (1 << 24, 20_000):  # one range, and many
        got = {r["doc_id"]: r for r in edited_fingerprints(rows.repartition(5), size).collect()}
        assert len(got) == len(docs)
        for k, (i, text) in enumerate(order):
            text, after = text or "", order[(k + 1) % len(order)][1] or ""
            n = len(text) // 3
            new = text[: len(text) - n] + after[:n]
            assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(text), hashlib.sha256(new.encode()).hexdigest())
            one, two, three = fingerprints([text, new, after])
            assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (str(one), str(two))
            assert (got[i]["near_edited"], got[i]["near_next"]) == (one.likeness(two), one.likeness(three))
            a, b = shingles(text), shingles(new)
            if len(a | b) > 300:
                assert abs(got[i]["near_edited"] - len(a & b) / len(a | b)) < 0.15
    assert got[2000]["fingerprint"] == got[2001]["fingerprint"] and got[2001]["near_next"] == 1
    one = Fingerprint.parse(got[order[5][0]]["fingerprint"])
    assert one.likeness(one) == 1 and one.containment(one.merged(fingerprints(["q w e r t y"])[0])) == 1
    assert edited_fingerprints(rows.where("false")).count() == 0
    single = edited_fingerprints(spark.createDataFrame([(None, "abc")], "doc_id long, text string")).collect()
    assert len(single) == 1 and single[0]["near_next"] == 1
    again = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (1, "d e f")], "doc_id long, text string")
    assert sorted(r["n_chars"] for r in edited_fingerprints(again, 4).collect()) == [5, 5, 5]


def test_containment_of_unequal_texts_by_merged_sketches():
    rnd = random.Random(15)
    words = vocabulary(rnd, 3000)
    parts = [sentence(rnd, words, 4000) for _ in range(3)]
    whole, inside, outside = fingerprints([" ".join(parts), parts[1][: len(parts[1]) // 3], sentence(rnd, words, 600)])
    assert inside.containment(whole) > 0.98 and outside.containment(whole) < 0.02 and whole.containment(inside) < 0.15
    one, two, three = fingerprints(parts)
    merged = one.merged(two).merged(three)
    assert inside.containment(merged) > 0.98 and abs(merged.likeness(whole) - 1) < 0.02


def test_language_model(spark):
    rnd = random.Random(6)
    words = vocabulary(rnd, 60)
    chain = {w: rnd.sample(words, 3) for w in words}

    def text():
        out = [rnd.choice(words)]
        for _ in range(rnd.randint(0, 80)):
            out.append(rnd.choice(chain[out[-1]]))
        return " ".join(out)

    docs = [(i, text()) for i in range(400)] + [(400, None), (401, " "), (402, "Unknown words only"), (None, "a b")]
    docs += [docs[3]]
    held = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = [r for r in score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(6, "doc_id"), held).collect()]
    assert len(got) == len(docs)
    learnt = [t for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    counts: dict = {}
    for t in learnt:
        for w in [*tokens(t), None]:
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    by_id = dict(docs)
    model = base = 0.0
    for r in got:
        w = [*tokens(by_id[r["doc_id"]]), None]
        want = sum(math.log10((counts.get(x, 0) + 1) / (total + len(counts) + 1)) for x in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), total)
        assert abs(r["base_score"] - want) < 1e-8 * max(1, abs(want)) and r["score"] < 0
        if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2:
            model, base = model + r["score"], base + r["base_score"]
    assert model > 0.7 * base  # the chain has three successors of sixty words
    none = score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert none["base_score"] == 0 and abs(none["score"]) < 1e-9 and none["train_tokens"] == 0
    assert score_texts(spark.createDataFrame([], "doc_id long, text string"), held).count() == 0


def test_scores_of_settled_seatings_equal_the_formula(spark):
    # Every pair of words occurs once in training, so each has one table and nothing is drawn at random.
    text, theta1, theta2, d = "aa bb cc dd", 10.0, 1.0, 0.95
    words, v = [*text.split(), None], 5
    pairs = set(zip([0, *words[:-1]], words, strict=True))

    def plain(t):
        total, before = 0.0, 0
        for w in [*tokens(t), None]:
            known = w in words
            one = (known * (1 - d) + (theta1 + d * v) / (v + 1)) / (theta1 + v)
            customers = int(before == 0 or before in words)
            total += math.log10((((before, w) in pairs) * (1 - d) + (theta2 + d * customers) * one) / (theta2 + customers))
            before = w
        return total

    rows = [(1, text), (2, "aa cc"), (3, "bb cc dd"), (4, None), (5, "dd dd dd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"train": F.lit("x"), "key": F.lit(1), "part": F.lit(0)})
    got = {r["doc_id"]: r["score"] for r in score_texts(docs, F.col("doc_id") == 1).collect()}
    for i, t in rows:
        assert abs(got[i] - plain(t)) < 1e-4, i


def test_gibbs_seating_has_the_right_distribution():
    c, d, weight, n = 5, 0.5, 0.7, 4000
    ways = {1: {1: 1.0}}  # by customers: number of tables, and the weight of all seatings with so many
    for k in range(1, c):
        ways[k + 1] = {t: ways[k].get(t - 1, 0) + ways[k].get(t, 0) * (k - t * d) for t in range(1, k + 2)}
    want = np.array([ways[c][t] * weight**t for t in range(1, c + 1)])
    want /= want.sum()
    rng = np.random.default_rng(5)
    for begin in (None, np.full(n, 3)):
        chain = Seating(np.full(n, c), begin)
        for _ in range(25):
            tables = chain.sweep(np.full(n, weight), d, rng)
        got = np.bincount(tables.astype(int), minlength=c + 1)[1:] / n
        assert np.abs(got - want).max() < 0.03
        sizes = chain.size.reshape(n, c)
        assert (sizes.sum(axis=1) == c).all() and ((sizes > 0).sum(axis=1) == chain.t).all()
    assert (reseated(np.array([0, 1, 2, 300, 5000]), 0.7, 0.5, rng)[:2] == [0, 1]).all()


def several_contexts():
    """(customers by word and context, the same as a part with a number)."""
    table = np.array([[5, 2, 0], [1, 3, 4], [2, 0, 1], [1, 1, 6]])
    word, context = np.nonzero(table)
    return table, lambda number: Part(number, table.sum(axis=1), word, context, table[word, context])


def after(part, tables, c1, t1, d):
    """What is shared after a sweep of a model of one part."""
    by = lambda x: np.bincount(part.pair_context, weights=x, minlength=3)
    return Shared(by(part.customers), by(tables), c1.sum(), t1.sum(), len(part.counts), d, d)


def test_seating_over_several_contexts_equals_a_plain_sampler():
    table, make = several_contexts()
    d, v, rnd = 0.5, len(table), random.Random(8)
    rooms = {(w, u): [1] * table[w, u] for w, u in zip(*np.nonzero(table), strict=True)}
    parent = {w: [1] * sum(len(x) for (k, _), x in rooms.items() if k == w) for w in range(v)}

    def leave(sizes):
        i = rnd.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        if sizes[i]:
            return False
        del sizes[i]
        return True

    def sit(sizes, weight):
        i = rnd.choices(range(len(sizes) + 1), [*(x - d for x in sizes), weight])[0]
        if i == len(sizes):
            sizes.append(1)
            return True
        sizes[i] += 1
        return False

    want, n = dict.fromkeys(rooms, 0.0), 4000
    for k in range(n + 50):
        for (w, u), sizes in rooms.items():
            for _ in range(table[w, u]):
                if leave(sizes):
                    leave(parent[w])
                one = (sum(parent[w]) - d * len(parent[w]) + (THETA1 + d * sum(map(len, parent.values()))) / (v + 1)) / (THETA1 + sum(map(sum, parent.values())))
                if sit(sizes, (THETA2 + d * sum(len(x) for (_, c), x in rooms.items() if c == u)) * one):
                    sit(parent[w], (THETA1 + d * sum(map(len, parent.values()))) / (v + 1))
        if k >= 50:
            for key, sizes in rooms.items():
                want[key] += len(sizes) / n

    got = np.zeros(len(rooms))
    for number in range(400):
        part = make(number)
        one = np.bincount(part.pair_word, minlength=v)
        history = [after(part, np.ones(len(rooms)), one, np.ones(v), d)]
        for _ in range(8):
            ((tables, c1, t1),) = sweeps(part, history, store=True)
            history.append(after(part, tables, c1, t1, d))
        got += tables / 400
    # What restaurants share stands still within a sweep: in restaurants as small as these that opens up to 8 % too many tables.
    plain = np.array([want[key] for key in zip(*np.nonzero(table), strict=True)])
    assert (np.abs(got - plain) < 0.1 * plain).all()


def test_a_stored_chain_goes_on_as_if_it_had_not_been():
    _, make = several_contexts()
    whole = make(3)
    history = [after(whole, np.ones(len(whole.pair_word)), np.bincount(whole.pair_word), np.ones(4), 0.5)]
    for k in range(4):
        *_, (tables, c1, t1) = sweeps(make(3), history)
        history.append(after(whole, tables, c1, t1, 0.5))
    for made in (1, 2, 3):
        part = make(3)
        for _ in sweeps(part, history[:made], store=True):
            pass
        (again,) = _compact_parts(iter([_compact_row(part)]))
        assert again.state[0] == made and (again.customers == part.customers).all() and (again.pair_word == part.pair_word).all()
        rest = list(sweeps(again, history[:4]))
        for got, want in zip(rest, list(sweeps(make(3), history[:4]))[made:], strict=True):
            assert all((x == y).all() for x, y in zip(got, want, strict=True))


def test_contexts_grow_with_the_training_text():
    assert [restaurants(n) for n in (0, 1000, 1 << 17, 1 << 18, 1 << 40)] == [2048, 2048, 8192, 16384, MOST_CONTEXTS]
    assert _least_level([(0, 1 << 20), (64, 5000), (300, 40)]) == 64 and _least_level([]) == _least_level([(0, 1 << 20)]) == 1 << 62
    ranked = np.random.default_rng(2).integers(1, 1 << 62, 5000).astype(np.uint64)
    frequent = Frequent.of(ranked, 2048)
    found = np.concatenate([ranked[:1024], ranked[2000:2100], ranked[:1]])
    rank, context = frequent.place(found, np.array([0, len(found) - 1]))
    assert (rank[:256] == np.arange(256)).all() and (rank[256:-1] == -1).all() and rank[-1] == 0
    assert context[0] == 0 and (context[1:1025] == np.arange(1, 1025)).all() and (context[1025:] > 1024).all() and context.max() < 2048


def test_frequent_words_are_counted_over_all_text():
    rnd = random.Random(12)
    words = vocabulary(rnd, 20000)
    texts = [sentence(rnd, words, 9000), "burst " * 3, " ".join(words[:3000])]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": texts, "train": [True, True, True]})
    got = {}
    for rows in (batch, batch.slice(1)):
        for r in _frequent(iter([rows])):
            for word, n in zip(r.column("word").to_pylist(), r.column("n").to_pylist(), strict=True):
                got[word] = got.get(word, 0) + n
    every = [w for t in (*texts, *texts[1:]) for w in tokens(t)]
    assert sum(got.values()) == len(every) + 5 and len(got) == len(set(every)) + 2  # ends of texts, the row of totals
