"""Prefix trie of conversations: which turns conversations share from their start, and what storing each once would save.

Every partition's rows are combined into a node table of its own, keyed by a hash of the path; tables are merged again and again
by that hash, summing members and joining lists of ends; sums then go from the leaves to the root by doubling: after
round k a node holds what lies less than 2**k below it, so the rounds grow with the logarithm of the depth.

A path's 128-bit key is the exclusive or of hashes of (turn, place), so prefixes of a very long conversation are
computed in blocks of ``BLOCK`` turns and the blocks' totals carried, and no task need hold one conversation.  Places are
numbered after a range partitioning on (conversation, turn), which splits a long conversation, too.

Lists of ends are held in spans of ``SPAN`` ids.  SHA-256 can't be computed in parts, so one task reads
the ids of a node for its hash, as a stream, span by span.

Defined results: a null role or text is empty; turns are ordered by turn (null first), of equal turns by the MD5 of
(role, text), and repeated rows are turns each; rows without a conv_id are of no conversation and left out; an empty
table has no nodes; other columns are not looked at.  ``c % 5`` has the sign of c, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

#: Turns of a conversation that one window holds.
BLOCK = 1 << 10
#: Conversation ids that a list of ends covers: 2 ** SPAN.
SPAN = 10
#: Node tables that one merge joins.
FAN = 32
#: Turns that a conversation may borrow.
BORROWED = 9
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["k1", "k2"]


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their partition and their place among the rows of their conversation there; a stream that holds one batch."""
    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = batch.column(0).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
        start = np.repeat(first, np.diff(np.append(first, len(conv))))
        at = np.arange(len(conv)) - start
        if conv[0] == last:
            at[: first[1] if len(first) > 1 else len(conv)] += seen
        last, seen = conv[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(np.full(len(conv), part, np.int32)), pa.array(at.astype(np.int64))], names=["conv_id", "digest", "n_bytes", "part", "at"])


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, digest, n_bytes, rank): every turn with its place in its conversation, from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["conv_id", "turn", "digest"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(turns.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_numbered, "conv_id long, digest binary, n_bytes long, part int, at long"))
    # A row a partition: only its first conversation can have begun in an earlier one.
    ends = rows.groupBy("part").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), (F.max_by("at", F.struct("conv_id", "at")) + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("last").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    whole = ends.groupBy(F.col("last").alias("first")).agg(F.sum("n").alias("whole"))
    carry = ends.withColumn("before", before).join(whole, "first", "left").select("part", "first", F.coalesce(F.when(F.col("first") == F.col("last"), F.col("before")).otherwise(F.col("whole")), F.lit(0)).alias("carry"))
    rank = F.col("at") + F.when(F.col("conv_id") == F.col("first"), F.col("carry")).otherwise(0)
    return rows.join(F.broadcast(carry), "part").select("conv_id", "digest", "n_bytes", rank.alias("rank"))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations (conv_id, depth from 1, digest, n_bytes, length), and (conv_id, length) of all of them, turnless ones too.

    Conversation c has the first h turns of conversation c - c % 5, then its own after its first h; h = crc32(c) % 9.
    """
    convs = turns.groupBy("conv_id").agg((F.max("rank") + 1).alias("n"))
    convs = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % BORROWED, "base": F.expr("conv_id - conv_id % 5")})
    base = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(base, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")))
    own = turns.join(convs, "conv_id").where("rank >= h").select("conv_id", (F.col("lent") + F.col("rank") - F.col("h") + 1).alias("depth"), "digest", "n_bytes", "length")
    head = turns.where(F.col("rank") < BORROWED).withColumnRenamed("conv_id", "base")
    lent = head.join(convs, "base").where("rank < h").select("conv_id", (F.col("rank") + 1).alias("depth"), "digest", "n_bytes", "length")
    return cut(own.union(lent)), convs.select("conv_id", "length")


def paths(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each (conversation, prefix): the prefix's key, its parent's, depth, bytes of the last turn, whether it ends there; the empty prefix too."""
    rows = rows.withColumns({"z1": F.xxhash64("digest", "depth"), "z2": F.xxhash64("depth", "digest"), "block": F.expr(f"(depth - 1) div {BLOCK}")})
    totals = rows.where(F.col("length") > BLOCK).groupBy("conv_id", "block").agg(F.bit_xor("z1").alias("c1"), F.bit_xor("z2").alias("c2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv_id", "block", F.bit_xor("c1").over(earlier).alias("c1"), F.bit_xor("c2").over(earlier).alias("c2"))
    inner = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"x1": F.bit_xor("z1").over(inner), "x2": F.bit_xor("z2").over(inner)}).join(carry, ["conv_id", "block"], "left")
    key = {f"k{i}": F.col(f"x{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0))) for i in (1, 2)}
    rows = rows.withColumns(key).select("k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("p2"), "depth", "n_bytes", "conv_id", (F.col("depth") == F.col("length")).alias("ends"))
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    return rows.union(convs.select(zero, zero, null, null, zero, zero, "conv_id", F.col("length") == 0))


def _merged(tables: DataFrame, keys: list[str], sums: dict, parts: int) -> DataFrame:
    """Node tables, numbered by ``t``, merged ``FAN`` at a time until there is one."""
    while parts > 1:
        parts = -(-parts // FAN)
        tables = tables.withColumn("t", F.expr(f"t div {FAN}")).groupBy(*keys, "t").agg(*[how(name).alias(name) for name, how in sums.items()])
    return tables.drop("t")


def node_table(steps: DataFrame) -> DataFrame:
    """(k1, k2, p1, p2, depth, n_bytes, n_convs, conv) of all nodes, from tables that the partitions combine on their own."""
    same = {name: F.max for name in ("p1", "p2", "depth", "n_bytes")}
    local = steps.withColumn("t", F.spark_partition_id()).groupBy(*KEY, "t").agg(*[how(name).alias(name) for name, how in same.items()], F.count("*").alias("n_convs"), F.min("conv_id").alias("conv"))
    return _merged(local, KEY, same | {"n_convs": F.sum, "conv": F.min}, steps.rdd.getNumPartitions())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ends from a stream that is sorted by node and span; one batch is held."""
    names, kinds = ["k1", "k2", "ends_sha256", "n_ends"], [pa.int64(), pa.int64(), pa.string(), pa.int64()]
    node, state, n = None, None, 0
    for batch in batches:
        out = []
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        for key, ids in zip(keys, batch.column(2), strict=True):
            if key != node:
                if node is not None:
                    out.append((*node, state.hexdigest(), n))
                node, state, n = key, hashlib.sha256(), 0
            ids = ids.as_py()
            state.update((("," if n else "") + ",".join(map(str, ids))).encode())
            n += len(ids)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*node, state.hexdigest(), n), kinds, strict=True)], names=names)


def end_lists(steps: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256, n_ends) of the nodes at which conversations end."""
    ended = steps.where("ends").select(*KEY, F.shiftright("conv_id", SPAN).alias("span"), "conv_id")
    local = ended.withColumn("t", F.spark_partition_id()).groupBy(*KEY, "span", "t").agg(F.collect_list("conv_id").alias("ids"))
    lists = _merged(local, [*KEY, "span"], {"ids": lambda c: F.flatten(F.collect_list(c))}, steps.rdd.getNumPartitions())
    lists = lists.withColumn("ids", F.array_sort("ids"))
    return lists.repartition(*KEY).sortWithinPartitions(*KEY, "span").select(*KEY, "ids").mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string, n_ends long")


def rolled_up(nodes: DataFrame) -> DataFrame:
    """(k1, k2, saved, leaves) of whole subtrees, from nodes with p1, p2, saved and leaves of their own.

    A node's (a1, a2) is its ancestor 2**k above in round k; it adds its sums to the ancestor's and goes on to the ancestor's own.
    """
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    state = nodes.select(*KEY, F.col("p1").alias("a1"), F.col("p2").alias("a2"), "saved", "leaves")
    for _ in range(int(depth).bit_length()):
        given = state.where("a1 is not null").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("other"))
        up = state.where("a1 is not null").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        state = state.join(given, KEY, "left").join(up, ["a1", "a2"], "left")
        zero = F.lit(0).cast("long")
        state = cut(state.select(*KEY, F.col("b1").alias("a1"), F.col("b2").alias("a2"), (F.col("saved") + F.coalesce("more", zero)).alias("saved"), (F.col("leaves") + F.coalesce("other", zero)).alias("leaves")))
    return state.select(*KEY, "saved", "leaves")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations; columns as the query's."""
    rows, convs = rebuilt_turns(ordered_turns(conversations))
    steps = cut(paths(rows, convs))
    nodes = cut(node_table(steps))
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    zero = F.lit(0).cast("long")
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = cut(nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("n_bytes"), "leaves": (F.col("n_children") == 0).cast("long")}))
    whole = rolled_up(nodes).withColumnRenamed("saved", "saved_tokens").withColumnRenamed("leaves", "n_leaves")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    out = nodes.join(whole, KEY).join(end_lists(steps), KEY, "left").join(parents, ["p1", "p2"], "left")
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Paths are strings of MD5 sums here, 32 characters a turn; 3988292384 is the polynomial of CRC-32.
OP13_SQL = """WITH turns AS (SELECT conv_id, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS n_bytes, turn FROM conversations WHERE conv_id IS NOT NULL),
ranked AS (SELECT conv_id, digest, n_bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS r FROM turns),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
 lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 9 AS h FROM ranked),
built AS (SELECT c.conv_id, 0 AS own, r, digest, n_bytes FROM convs c JOIN ranked b ON b.conv_id = c.base WHERE r < h UNION ALL SELECT c.conv_id, 1, r, digest, n_bytes FROM convs c JOIN ranked o ON o.conv_id = c.conv_id WHERE r >= h),
steps AS (SELECT conv_id, n_bytes, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, count(*) OVER (PARTITION BY conv_id) AS length FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY own, r ROWS UNBOUNDED PRECEDING)),
every AS (SELECT conv_id, n_bytes, depth, path, depth = length AS ends FROM steps UNION ALL SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM steps) FROM convs),
nodes AS MATERIALIZED (SELECT path, max(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes, CASE WHEN max(depth) > 0 THEN left(path, 32 * (max(depth) - 1)::BIGINT) END AS up, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM every GROUP BY path),
kids AS (SELECT up, count(*) AS n FROM nodes GROUP BY up),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.path),
below AS (SELECT left(path, 32 * k) AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM own) GROUP BY 1)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(o.ends) AS ends_sha256 FROM own o JOIN below b USING (path) LEFT JOIN nodes p ON p.path = o.up"""
