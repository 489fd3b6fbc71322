"""op11, op12 and op13: against their SQL on the given tables, and on small tables of odd rows against plain versions."""

import collections
import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import collocations, link_graph, prefix_trie, registry
from tests.llm.corpus import LOWER

DATA = "/root/testdata/sf0.001"
NEW = ["op11_phrase_collocations", "op12_url_filters", "op13_conversation_prefix_trie"]


def oracle(name, **tables):
    con = duckdb.connect()
    for table, source in tables.items():
        con.register(f"{table}_rows", source) if isinstance(source, pa.Table) else con.execute(f"create view {table}_rows as select * from '{source}'")
        con.execute(f"create view {table} as select * from {table}_rows")
    found = con.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    return names, sorted(map(tuple, found.fetchall()), key=str)


def same(df, expected):
    names, rows = expected
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == rows


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", NEW)
def test_given_tables(spark, name):
    same(registry.QUERIES[name](spark, DATA), oracle(name, **{t: f"{DATA}/{t}.parquet" for t in ("documents", "pages", "conversations")}))


# --- phrases ------------------------------------------------------------------------------------


def phrases(rows, least=30, cover=80, top=2000):
    """Counts by hand: every phrase of every piece."""
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                f[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for p, a in counts.items():
            if len(p) < 2 or a < least:
                continue
            longer = [c for q, c in counts.items() if len(q) > len(p) and c >= least and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if any(100 * c >= cover * a for c in longer):
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, l, r))
        for rank, (score, _, phrase, a, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, total[lang], -score))
    return sorted(out)


def odd_texts():
    rnd = random.Random(5)
    words = ["Of", "the", "a", "é", "ß|x", "New", "York", "city", "w1", "w2", "w3", "ÄB"]
    rows = [(rnd.choice(["en", "de", None, ""]), "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", ", ", "\n", "  ", "\x0b", "\r\n"]) for _ in range(rnd.randint(0, 60)))) for _ in range(300)]
    rows += [("en", None), (None, ""), ("en", " \n. ,"), ("en", "a a a a a a a a"), ("en", "x" * 3000)] + [("en", "New York city hall is old.")] * 40
    rows.append(("en", " ".join(rnd.choice(words) for _ in range(30000))))
    return rows


def test_phrases_of_odd_texts(spark):
    rows = odd_texts()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n long, phrase string").repartition(5)
    got = collocations.collocations(docs)
    assert sorted(map(tuple, got.collect())) == phrases(rows)
    assert sorted(map(tuple, collocations.collocations(docs, least=3, cover=60, top=25).collect())) == phrases(rows, 3, 60, 25)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_split_pivots_and_buckets_in_parts(spark, monkeypatch):
    """Shares of pivots, few ranked words (others by the bitmap) and buckets counted in parts give the same phrases."""
    rows = odd_texts()[:200]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).cache()
    frequent = collocations.frequent_words(docs, 5)
    known = collocations.ranks(frequent, most=12)
    counts = {r["id"]: r["n"] for r in frequent.where("id is not null").collect()}
    assert len(known.ids) <= 12 < len(counts) and set(known.ids) < set(counts)
    assert (known.code(np.array(list(counts), np.int64)) >= 0).all()
    code = known.code(np.array(list(counts), np.int64))
    assert sorted(known.id(code)) == sorted(counts)
    plain = {(r["lang"], tuple(r["ids"])): r["a"] for r in collocations.frequent_phrases(docs, frequent, 5).collect()}
    batches = pa.Table.from_pylist([{"lang": a, "text": b} for a, b in rows], pa.schema([("lang", pa.string()), ("text", pa.string())])).to_batches(50)

    class Held:
        value = known

    known.shares = np.full(len(known.ids), 3)
    monkeypatch.setattr(collocations, "HELD", 40)
    monkeypatch.setattr(collocations, "SENT", 100)
    sent = pa.Table.from_batches(list(collocations._fragments(iter(batches), Held, 7))).sort_by("bucket").to_batches(3)
    parts = collections.Counter()
    for batch in collocations._mined(iter(sent), Held, 5):
        for lang, ids, a, whole in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            assert not whole or (lang, tuple(ids)) not in parts
            parts[lang, tuple(ids)] += a
    assert {k: v for k, v in parts.items() if v >= 5} == plain


def test_exact_score(spark):
    """Counts whose products pass 64 bits, and one a hair under the next whole number."""
    big = 9_000_000_000_000_000
    phrases = spark.createDataFrame([("en", [1, 2], big - 1), ("en", [1, 3], 333)], "lang string, ids array<long>, a long")
    frequent = spark.createDataFrame([("en", 1, "a", big), ("en", 2, "b", big), ("en", 3, "c", 667), ("en", None, None, 3 * big)], "lang string, id long, word string, n long")
    got = {tuple(r["ids"]): r["score"] for r in collocations.scored_phrases(phrases, frequent).collect()}
    assert got == {(1, 2): 2000000 * (big - 1) // (2 * big), (1, 3): 2000000 * 333 // (big + 667)}


# --- urls ---------------------------------------------------------------------------------------


def pages():
    link = lambda *hosts: "<p>x</p>" + "".join(f'<A class="x"\nHREF = \'HTTPS://{h}/p?q\'>t</a>' for h in hosts) + '<a href="/own">o</a><a href="//proto.net/x">'
    rows = [
        (1, "http://Good.ORG/x", link("friend.net", "friend.net", "other.net")), (2, "http://friend.net/", link("deep.net")), (3, "http://bad.example.org/es/1", link("x.net")),
        (4, "http://spam.net/a?b#c", link("bad.example.org", "bad.example.org")), (5, "http://far.net", link("spam.net")), (6, "http://example.org/en/12", None),
        (7, "http://notexample.org/en/12", ""), (8, "http://a.com/de/", "<a <a <a href"), (9, "http://a.com/fr/", link()), (10, "http://a.com/fr", link()), (11, "http://a.com/en/x#y?z", link()), (12, None, link("spam.net")),
        (13, "no scheme", link("spam.net")), (14, "http://", ""), (15, "x://org", ""), (16, "http://" + "a." * 200 + "net/", ""), (17, "http://sub.friend.net?q://x/", link()), (17, "http://sub.friend.net?q://x/", link()), (None, "http://mixed.net/", link("good.org", "bad.example.org")),
    ]
    return [(i, u, h, "v", "r") for i, u, h in rows]


def test_urls_by_sql(spark):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, verdict string, host string")
    table = pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": [r[1] for r in rows], "html": [r[2] for r in rows]})
    got = link_graph.url_verdicts(df)
    same(got, oracle("op12_url_filters", pages=table))
    by = {r["page_id"]: r for r in got.collect()}
    assert (by[1]["host"], by[1]["path"], by[1]["rule"], by[1]["verdict"]) == ("good.org", "/x", "org/", "allow")
    assert (by[3]["rule"], by[3]["verdict"]) == ("example.org/es/", "block") and by[6]["rule"] == "example.org/en/1" and by[7]["rule"] == "org/"
    assert [by[k]["rule"] for k in (8, 9, 10, 11, 15)] == ["com/de/", "com/fr/", None, None, None]
    assert by[4]["verdict"] == by[5]["verdict"] == "block" and by[2]["verdict"] == "allow" and by[2]["trust"] > 0
    assert all((by[k]["host"], by[k]["path"], by[k]["verdict"]) == ("", "", "allow") for k in (12, 13, 14))
    assert by[17]["host"] == "sub.friend.net" and by[17]["path"] == "" and got.count() == len(rows)
    assert link_graph.url_verdicts(df.limit(0)).count() == 0


def test_standing_by_matrix(spark):
    """Scores against the same walks in numpy, a hub's edges in several blocks."""
    rnd = random.Random(3)
    hosts = [f"h{k}" for k in range(40)]
    edges = {(a, b): rnd.randint(1, 5) for a in hosts[:15] for b in rnd.sample(hosts, 4) if a != b} | {("hub", f"t{k}"): 1 for k in range(1300)} | {("h0", "hub"): 7}
    seeds = [("h0", 3, 0), ("h1", 1, 1), ("h2", 0, 2), ("t5", 0, 1)]
    got = link_graph.standing(spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, allowed long, blocked long"), 6)
    want = collections.defaultdict(lambda: [0, 0])
    for kind in (0, 1):
        ways = edges if kind == 0 else {(b, a): n for (a, b), n in edges.items()}
        total = collections.Counter()
        for (a, _), n in ways.items():
            total[a] += n
        count = sum(s[1 + kind] for s in seeds)
        base = {s[0]: link_graph.SCALE * s[1 + kind] // count for s in seeds if s[1 + kind]}
        score = dict(base)
        for _ in range(6):
            new = collections.Counter({h: b * 15 // 100 for h, b in base.items()})
            for (a, b), n in ways.items():
                if a in score:
                    new[b] += (score[a] * 85 // 100) * n // total[a]
            score = new
        for h, s in score.items():
            want[h][kind] = s
    assert {r["host"]: [r["trust"], r["distrust"]] for r in got.collect()} == dict(want)


# --- trie ---------------------------------------------------------------------------------------


def trie(rows):
    by = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[c].append(((turn is not None, turn or 0, digest), (role, text)))
    by = {c: [t for _, t in sorted(x)] for c, x in by.items()}
    nodes = collections.defaultdict(lambda: [set(), []])
    for c, own in by.items():
        h = zlib.crc32(str(c).encode()) % 9
        turns = by.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:]
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])][0].add(c)
        nodes[tuple(turns)][1].append(c)
    kids, leaves, saved = collections.Counter(p[:-1] for p in nodes if p), collections.Counter(), collections.Counter()
    for p in nodes:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(nodes[p][0]) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(((min(m), len(p), min(nodes[p[:-1]][0]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(e))).encode()).hexdigest()) for p, (m, e) in nodes.items()), key=str)


def odd_conversations():
    rnd = random.Random(9)
    rows = [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "ok", "", None, "é" * 5])) for c in range(-12, 60) if c % 7 for t in range(rnd.randint(0, 12))]
    rows += [(200, None, "user", "late"), (200, 3, "user", "x"), (200, 3, "user", "x"), (200, 3, "a", "y"), (None, 1, "user", "lost"), (10**15, 1, None, None), (31, 0, "user", "only"), (501, 0, "u", "t" * 100000)]
    return rows


@pytest.mark.parametrize("block", [1 << 10, 3])
def test_trie_of_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = odd_conversations()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, k1 string").repartition(6)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).select(columns).collect()), key=str) == trie(rows)
    assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_one_long_conversation(spark):
    """Two conversations that agree for 2,990 turns, over several partitions and blocks; 3,000 others end at one node."""
    rows = [(c, t, "u", f"t{t}" if t < 2990 else f"{c} {t}") for c in (5, 6) for t in range(3000)] + [(c, 0, "u", "same") for c in range(100, 3100)]
    got = list(prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect())
    assert len(got) == 1 + 1 + 2990 + 2 * 10
    shared = {r["depth"]: r for r in got if r["conv_id"] == 5 and r["depth"] > 0}
    size = [len(f"t{t}") for t in range(2990)]
    assert all(shared[d]["n_convs"] == (2 if d <= 2990 else 1) and shared[d]["saved_tokens"] == sum(size[d - 1 :]) and shared[d]["n_leaves"] == (2 if d <= 2990 else 1) for d in range(1, 3001))
    own = {r["depth"]: r for r in got if r["conv_id"] == 6}
    assert sorted(own) == list(range(2991, 3001)) and own[2991]["parent_conv_id"] == 5
    same = next(r for r in got if r["conv_id"] == 100)
    assert same["n_convs"] == 3000 and same["ends_sha256"] == hashlib.sha256(",".join(map(str, range(100, 3100))).encode()).hexdigest()
    root = next(r for r in got if r["depth"] == 0)
    assert (root["conv_id"], root["parent_conv_id"], root["n_convs"], root["n_children"], root["n_leaves"]) == (5, None, 3002, 2, 3)
    assert root["saved_tokens"] == sum(size) + 2999 * 4 and root["ends_sha256"] == prefix_trie.EMPTY
