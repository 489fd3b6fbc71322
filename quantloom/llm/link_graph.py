"""URL filters: rules decide the urls that they fit; the rest goes by the standing of its host in the link graph.

Trust is a personalised PageRank over host edges that starts at the hosts with pages that a rule allows; distrust is
one over the reversed edges that starts at the hosts with pages that a rule blocks: who links to blocked hosts is
distrusted.  A host is blocked where its distrust exceeds ``threshold`` hundredths of its trust, both as shares of
their totals; a host that neither reaches is allowed.  Host edges are links of pages to other hosts, weighted by their
number, and an edge both ways between a host and the domain above it (down to two labels), of weight one.

Scores are whole numbers (shares of ``SCALE``) and every division is floored, so the result is the same whatever
the order of sums and the partitioning.

Defined results: a url that is null or has no ``://`` has the empty host and path, fits no rule and is allowed; a null
html has no links; repeated rows are judged each, and their links count each; an empty table gives no rows; columns other
than page_id, url and html are not looked at.  Host names of over 127 labels (more than DNS allows) have no domain above them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut


class Rule(NamedTuple):
    """What to do with urls of ``host`` and its subdomains whose path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The registered query's rules.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))
SCALE = 10**17
#: Share of a host's score that follows its edges, in hundredths.
DAMPING = 85
ROUNDS = 20
#: Shares of a host's pages.
SALTS = 32
#: Edges of one source that a row holds.
BLOCK = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Target of an anchor; neither class crosses the next tag, so a scan is linear in the page.
HREF = r"""<[aA][\x20\x09-\x0D][^<>]*?[hH][rR][eE][fF][\x20\x09-\x0D]*=[\x20\x09-\x0D]*["']?([^"'<>\x20\x09-\x0D]+)"""
#: Host of a target that names one.
TARGET = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#\\]+)"


def url_host(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty where there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, action) of the longest rule that fits, nulls where none does; of rules as long the one with the longer host, then a blocking one.

    The rules become part of the plan, so a list is meant to have up to some thousand.
    """
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.action == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, action = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.action).otherwise(action)
    return name, action


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) of ``pages`` (host, html) without loops: links between hosts, and one each way between a host and the domain above it."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))
    links = links.select("src", F.translate(F.regexp_extract("href", TARGET, 1), UPPER, LOWER).alias("dst")).where("dst <> '' and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    names = pages.select("host").where("host <> ''").union(links.select("dst")).distinct()
    labels = F.split("host", r"\.")
    above = names.select(labels.alias("labels")).where((F.size("labels") <= 127) & (F.size("labels") > 2) & ~F.array_contains("labels", ""))
    above = above.select("labels", F.explode(F.expr("sequence(1, size(labels) - 2)")).alias("k"))
    above = above.select(F.array_join(F.expr("slice(labels, k, size(labels))"), ".").alias("low"), F.array_join(F.expr("slice(labels, k + 1, size(labels))"), ".").alias("high")).distinct()
    both = above.select(F.col("low").alias("src"), F.col("high").alias("dst")).union(above.select("high", "low")).withColumn("n", F.lit(1).cast("long"))
    return links.union(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def standing(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) of the hosts that either reaches, in shares of ``SCALE``.

    ``edges`` has src, dst, n; ``seeds`` has host, allowed, blocked (numbers of pages).  Both walks go in one table,
    keyed by (kind, host); the edges of one source come in blocks, so that no row or join key of a hub grows beyond ``BLOCK`` targets
    a row.  What reaches a host without edges stays there.
    """
    ways = edges.select(F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").union(edges.select(F.lit(1), "dst", "src", "n"))
    size = ways.groupBy("kind", "host").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / BLOCK).alias("blocks"))
    ways = ways.join(size, ["kind", "host"]).withColumn("block", F.pmod(F.xxhash64("to"), F.col("blocks")))
    ways = cut(ways.groupBy("kind", "host", "block").agg(F.first("total").alias("total"), F.collect_list(F.struct("to", "n")).alias("targets")).drop("block"))
    start = seeds.select(F.expr("stack(2, 0, host, allowed, 1, host, blocked) as (kind, host, n)")).where("n > 0")
    total = start.groupBy("kind").agg(F.sum("n").alias("total"))
    start = start.join(F.broadcast(total), "kind").select("kind", "host", F.expr(f"cast({SCALE} as decimal(18,0)) * cast(n as decimal(19,0)) div total").alias("base"))
    start = cut(start)
    scores = start.withColumnRenamed("base", "score")
    for _ in range(rounds):
        sent = scores.join(ways, ["kind", "host"]).select("kind", "total", F.expr(f"score * {DAMPING} div 100").alias("score"), F.explode("targets").alias("t"))
        sent = sent.select("kind", F.col("t.to").alias("host"), F.expr("cast(score as decimal(18,0)) * cast(t.n as decimal(19,0)) div total").alias("score"))
        kept = start.select("kind", "host", F.expr(f"base * {100 - DAMPING} div 100").alias("score"))
        # A cut a round: the plan of several would be planned anew after each of its stages, all on the driver.
        scores = cut(sent.union(kept).groupBy("kind", "host").agg(F.sum("score").alias("score")))
    by = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0).cast("long"))
    return scores.groupBy("host").agg(by(0).alias("trust"), by(1).alias("distrust"))


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: int = 100, rounds: int = ROUNDS) -> DataFrame:
    """page_id, host, path, rule, verdict, and trust and distrust of the host, of every row of ``pages`` (page_id, url, html)."""
    url = F.col("url")
    named = pages.select("page_id", url_host(url).alias("host"), url_path(url).alias("path"), "html")
    rule, action = fitting(rules, F.col("host"), F.col("path"))
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), action.alias("action"))
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked"))
    hosts = standing(host_edges(named), seeds, rounds)
    none = F.lit(0).cast("long")
    # A host with a third of the pages is dealt by a salt; the table of hosts, small beside the pages, is there for each.
    hosts = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = ruled.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    judged = dealt.join(hosts, ["host", "salt"], "left").withColumns({"trust": F.coalesce("trust", none), "distrust": F.coalesce("distrust", none)})
    blocked = F.col("distrust").cast("decimal(20,0)") * 100 > F.col("trust").cast("decimal(20,0)") * threshold
    return judged.select("page_id", "host", "path", "rule", F.coalesce("action", F.when(blocked, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql(rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, with a common table a round."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    order = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.action != "block"))
    case = lambda what: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{what(r)}'" for r in order) + " END"
    lower = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    href, target = HREF.replace("'", "''"), TARGET.replace("'", "''")
    steps = "".join(
        f""",
s{k} AS MATERIALIZED (SELECT kind, host, sum(score)::BIGINT AS score FROM (SELECT w.kind, w.dst AS host, (s.score * {DAMPING} // 100)::HUGEINT * w.n // w.total AS score FROM s{k - 1} s JOIN ways w ON w.kind = s.kind AND w.src = s.host
 UNION ALL SELECT kind, host, score * {100 - DAMPING} // 100 FROM s0) GROUP BY ALL)"""
        for k in range(1, rounds + 1)
    )
    return f"""WITH cuts AS (SELECT page_id, html, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
named AS (SELECT page_id, html, {lower("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cuts),
ruled AS (SELECT page_id, host, path, {case(lambda r: r.name)} AS rule, {case(lambda r: r.action)} AS action FROM named),
href AS (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS href FROM named WHERE host <> ''),
links AS (SELECT src, {lower(f"regexp_extract(href, '{target}', 1)")} AS dst FROM href),
names AS (SELECT host FROM named WHERE host <> '' UNION SELECT dst FROM links WHERE dst <> '' AND dst <> src),
above AS (SELECT DISTINCT array_to_string(l[k:], '.') AS low, array_to_string(l[k + 1:], '.') AS high FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM (SELECT string_split(host, '.') AS l FROM names) WHERE len(l) BETWEEN 3 AND 127 AND NOT list_contains(l, ''))),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT src, dst FROM links WHERE dst <> '' AND dst <> src UNION ALL SELECT low, high FROM above UNION ALL SELECT high, low FROM above) GROUP BY ALL),
ways AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY kind, src) AS total FROM (SELECT 0 AS kind, src, dst, n FROM edges UNION ALL SELECT 1, dst, src, n FROM edges)),
seeds AS (SELECT kind, host, count(*) AS n FROM (SELECT CASE action WHEN 'allow' THEN 0 ELSE 1 END AS kind, host FROM ruled WHERE action IS NOT NULL) GROUP BY ALL),
s0 AS MATERIALIZED (SELECT kind, host, ({SCALE}::HUGEINT * n // sum(n) OVER (PARTITION BY kind))::BIGINT AS score FROM seeds){steps},
ends AS (SELECT host, coalesce(sum(score) FILTER (kind = 0), 0)::BIGINT AS trust, coalesce(sum(score) FILTER (kind = 1), 0)::BIGINT AS distrust FROM s{rounds} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust FROM ruled LEFT JOIN ends USING (host)"""


OP12_SQL = _sql()
