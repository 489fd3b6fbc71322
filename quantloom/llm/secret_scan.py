"""Secret scanning with one combined deterministic automaton.

All rules are compiled on the driver, by subset construction and minimisation, into two small
transition arrays.  The first searches every byte of every text for all rules in one pass; texts are
cut into lanes at bytes that no rule can contain, and numpy advances thousands of lanes together.
Lanes that it flags are walked with the second automaton, which knows all rules in full and gives
the leftmost-longest, non-overlapping matches of each rule.

Defined results: a null text is empty and has no spans; a null doc_id stays null; rows that repeat are scanned
each; an empty table gives no rows; extra columns are ignored by ``scan``, whatever their names, and kept by ``redact``.
Offsets count code points.  A very long text is cut into lanes like any other; a lane without a stop byte is as
long as its run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules
from .textkernel import text_chunks

LANE = 256
MASK = "[secret]"


@dataclass(frozen=True)
class Rule:
    """kind; the full pattern; a pattern of which every wanted match contains a match, for the search pass; the least length of the value (whole match, or what follows the sign of an assignment)."""

    kind: str
    pattern: str
    seed: str
    least: int = 1


BASE_KINDS = ("assign", "access", "hex")
_VALUE = "[A-Za-z0-9+/_.=-]"
RULES = (
    Rule("assign", rf"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?{_VALUE}+", rf"(?i:password|passwd|secret|token|api_?key)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?{_VALUE}{{6}}", 6),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{4}", 20),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24}", 24),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "gh[pousr]_[A-Za-z0-9]{4}", 40),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", "xox[abprs]-[A-Za-z0-9]", 20),
    Rule("google", "AIza[A-Za-z0-9_-]+", "AIza[A-Za-z0-9_-]{4}", 39),
    Rule("private_key", r"-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----", r"-----BEGIN\x20"),
)


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    search: Automaton
    full: Automaton
    stops: np.ndarray
    #: By state of the full automaton, the rules that can still match.
    live: np.ndarray

    @staticmethod
    def of(rules: tuple[Rule, ...] = RULES) -> Scanner:
        full = compile_rules([r.pattern for r in rules])
        stops = (full.table() == full.dead).all(axis=0)
        live, step = full.accept.copy(), full.step.reshape(full.states, full.classes)
        while True:
            more = live | np.bitwise_or.reduce(live[step], axis=1)
            if (more == live).all():
                break
            live = more
        return Scanner(rules, compile_rules([r.seed for r in rules], search=True), full, stops, live)

    def lanes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the lanes of some texts in which a seed occurs."""
        n = len(data)
        stops = np.flatnonzero(self.stops[data])
        at = np.searchsorted(stops, np.arange(LANE, n, LANE))
        cuts = np.unique(np.concatenate([offsets, stops[at[at < len(stops)]] + 1]))
        start, length = cuts[:-1], np.diff(cuts)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = np.zeros(len(start), np.int64)
        seen = np.zeros(len(start), np.int64)
        kinds = self.search.class_of[data]
        step, accept, classes = self.search.step, self.search.accept, self.search.classes
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
        for t, k in enumerate(active.tolist()):
            now = step[state[:k] * classes + kinds[start[:k] + t]]
            state[:k] = now
            seen[:k] |= accept[now]
        hit = np.flatnonzero(seen)
        hit = hit[np.argsort(start[hit])]
        return start[hit], start[hit] + length[hit]

    def matches(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) of every wanted match, in bytes."""
        step, accept, classes, dead = self.full.step, self.full.accept, self.full.classes, self.full.dead
        kinds = self.full.class_of[np.frombuffer(text, np.uint8)].tolist()
        free = [0] * len(self.rules)
        out = []
        live = self.live.tolist()
        for i in range(len(kinds)):
            state, last = 0, {}
            open_rules = sum(1 << r for r, end in enumerate(free) if i >= end)
            for j in range(i, len(kinds)):
                state = int(step[state * classes + kinds[j]])
                if state == dead or not live[state] & open_rules:
                    break
                if flags := int(accept[state]):
                    for r in range(len(free)):
                        if flags >> r & 1:
                            last[r] = j + 1
            for r, end in last.items():
                if i >= free[r]:
                    free[r] = end
                    if self.wanted(r, text[i:end]):
                        out.append((i, end, r))
        return out

    def wanted(self, rule: int, match: bytes) -> bool:
        if self.rules[rule].kind == "assign":
            sign = min(p for p in (match.find(b":"), match.find(b"=")) if p >= 0)
            match = match[sign + 1 :].lstrip(b" ")
            match = match[1:] if match[:1] in (b'"', b"'") else match
        return len(match) >= self.rules[rule].least

    def spans(self, batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, int]]]:
        """For each row its (start, end, rule), in code points, by start and then rule."""
        for a, b, data, offsets in text_chunks(batch):
            found: dict[int, list[tuple[int, int, int]]] = {}
            for x, y in zip(*self.lanes(data, offsets), strict=True):
                row = int(np.searchsorted(offsets, x, "right")) - 1
                for s, e, r in self.matches(data[x:y].tobytes()):
                    found.setdefault(row, []).append((int(x) + s - int(offsets[row]), int(x) + e - int(offsets[row]), r))
            for row in range(b - a):
                if row not in found:
                    yield []
                    continue
                points = np.concatenate([[0], np.cumsum((data[offsets[row] : offsets[row + 1]] & 0xC0) != 0x80)])
                yield sorted(((int(points[s]), int(points[e]), r) for s, e, r in found[row]), key=lambda x: (x[0], x[2]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), of every row."""
    scanner = Scanner.of(rules)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": rules[r].kind, "start": s, "end": e} for s, e, r in x] for x in scanner.spans(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns, each secret in ``text`` (overlapping spans as one) replaced by a mark and ``n_chars``, where there is one, counted anew for those texts."""
    scanner = Scanner.of(rules)
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = {i: x for i, x in enumerate(scanner.spans(batch)) if x}
            if hits:
                columns = list(batch.columns)
                texts = columns[at].to_pylist()
                sizes = columns[count].to_pylist() if count >= 0 else None
                for i, found in hits.items():
                    out, end = [], 0
                    for s, e, _ in found:
                        if s >= end:
                            out += [texts[i][end:s], MASK]
                        end = max(end, e)
                    texts[i] = "".join([*out, texts[i][end:]])
                    if sizes:
                        sizes[i] = len(texts[i])
                columns[at] = pa.array(texts, columns[at].type)
                if sizes:
                    columns[count] = pa.array(sizes, columns[count].type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op8_secret_scans(spark, sf_dir: str) -> DataFrame:
    """The digest columns of every document's spans."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def digests(docs: DataFrame) -> DataFrame:
    """Counts by base kind, the hash of the base spans and all spans as text, of every row."""
    named = lambda found: F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return scan(docs).select(
        "doc_id",
        *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(named(of(*BASE_KINDS)), 256).alias("base_sha256"),
        named(F.col("spans")).alias("spans"),
    )
