import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quantloom.llm.secret_scan import BASE_KINDS, RULES, Scanner, digests, redact

SCANNER = Scanner.of()
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[0], x[2]))


def found(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return list(SCANNER.spans(batch))


def test_base_rules_equal_regular_expressions():
    rnd = random.Random(7)
    bits = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "abcdef", "0123456789abcdef01234567", "AKIA", "ABCDEFGHIJKLMNOP12", "\n", "é", "漢", "x=y", "token==", "-", "f", "g"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    texts += [None, "", "password=tok:abcdefgh token=", "secrettoken=abcdef", "é" * 999 + "\n" + "a" * 3000 + "token='Z9/+=_-.z'", "x" * 5000 + " password = hunter22 " + "y" * 5000]
    for text, spans in zip(texts, found(texts), strict=True):
        assert [s for s in spans if s[2] < 3] == brute(text or ""), text


def test_extra_rules():
    text = "a ghp_" + "A1" * 18 + " and -----BEGIN RSA PRIVATE KEY----- b"
    kinds = [RULES[r].kind for _, _, r in found([text])[0]]
    assert kinds == ["github", "private_key"]


def test_digests_equal_regular_expressions(spark):
    rnd = random.Random(9)
    bits = ["password", "secret", "api_key", "=", ": ", '"', "abcdef", "0123456789abcdef01234567", "AKIA", "ABCDEFGHIJKLMNOP12", "\n", "é", "漢", " token=='", "ghp_" + "a" * 36, " "]
    docs = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30)))) for i in range(150)]
    docs += [(3, docs[3][1]), (None, docs[5][1]), (500, None), (501, ""), (502, "x " * 400000 + "AKIA" + "Q" * 16 + " -----BEGIN " + "A " * 20000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"spans": F.lit(1), "kind": F.lit("k"), "n_hex": F.lit(2)})
    got = digests(rows.repartition(4)).collect()
    want = []
    for i, text in docs:
        spans = [f"{BASE_KINDS[k]}:{s}:{e}" for s, e, k in brute(text or "")]
        want.append((i, *(sum(x.startswith(k + ":") for x in spans) for k in BASE_KINDS), hashlib.sha256(",".join(spans).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    assert all(set(x.split(":")[0] for x in r["spans"].split(",")) <= {rule.kind for rule in RULES} | {""} for r in got)
    assert sum("github" in r["spans"] for r in got) > 5
    assert digests(rows.where("false")).count() == 0
    clean = {r["doc_id"]: r for r in redact(rows).collect()}
    assert clean[500]["text"] is None and clean[501]["text"] == "" and clean[0].asDict().keys() == set(rows.columns)
    assert not any(brute(r["text"] or "") for r in digests(redact(rows).withColumnRenamed("spans", "s")).join(redact(rows), "doc_id").collect() if r["base_sha256"] == hashlib.sha256(b"").hexdigest())
