"""Operator 12, URL filters: rules by host and path, and for other urls the verdict of their host by link-graph propagation.

Hosts are nodes; the links of pages to other hosts are edges, weighted by their number. Trust is a personalised PageRank
that starts from hosts with pages that a rule allows, in proportion to these pages; distrust starts from hosts with pages
that a rule blocks and runs along reversed edges, to those that link to them. A host is blocked if its share of all
distrust is more than `threshold` hundredths of its share of all trust. Shares are whole numbers of a fixed total, so
sums don't depend on their order, and a lost task or another partitioning changes no verdict. Edges and shares stay
in Spark; each step joins and sums them (combined before the shuffle) and is written to the shared folder.

Defined cases: a null url, or one without `://`, has an empty host and path and fits no rule; the empty host is no node and
links of such pages aren't counted; links of a host to itself count nothing; a host without evidence is allowed; null html
has no links; of rules that fit, the one of most characters wins, then that of the longer host, then block; rows are judged
one by one, also repeated ones and those with a null page_id; an empty table gives an empty result. Only page_id, url
and html are read, so no other column can clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, table, with_schema

#: Verdict and host with path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Rules are configuration, tested on every row.
MOST_RULES = 1000
TOTAL = 10**16
#: Hundredths of a host's share that go on along its links, and steps of propagation.
DAMPING, STEPS = 85, 20
THRESHOLD = 100

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
#: The host of a link with a scheme or none; other links stay on their page's host.
LINK = r"""(?i)<a\s[^<>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'<>\s]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The rule that decides, as a struct with `rule` and `verdict`; null if none fits."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    fits = []
    for verdict, rule in rules:
        at, _, rest = rule.partition("/")
        found = F.struct(F.lit(len(rule)).alias("n"), F.lit(len(at)).alias("h"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        fits.append(F.when(((host == at) | host.endswith("." + at)) & path.startswith("/" + rest), found))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<n:int,h:int,verdict:string,rule:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: how many links of pages of src lead to dst."""
    rows = with_schema(pages, ("url", "string"), ("html", "string")).select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    rows = rows.withColumn("dst", F.translate("dst", UPPER, LOWER)).where("src <> '' AND dst <> '' AND src <> dst")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def shares(counts: DataFrame, edges: DataFrame, total: int = TOTAL, damping: int = DAMPING, steps: int = STEPS) -> DataFrame:
    """host, trust, distrust after all steps. counts: host, allowed, blocked; edges: src, dst, n."""
    out = Written(counts.sparkSession)
    seeds = counts.where("host <> '' AND (allowed > 0 OR blocked > 0)")
    sums = F.broadcast(seeds.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")))  # one row
    part = lambda n, of: F.expr(f"CASE WHEN {n} > 0 THEN ({total} div {of}) * {n} ELSE 0 END")
    start = out.keep(seeds.join(sums, F.lit(True)).select("host", part("allowed", "a").alias("trust"), part("blocked", "b").alias("distrust")))
    both = edges.select("src", "dst", "n", F.lit(True).alias("ahead")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit(False).alias("ahead")))
    degree = both.groupBy("src", "ahead").agg(F.sum("n").alias("of"))
    both = out.keep(both.join(degree, ["src", "ahead"]).withColumnRenamed("src", "host"))
    if both.isEmpty():
        return start
    now = start
    stay = [F.expr(f"{c} * {100 - damping} div 100").alias(c) for c in ("trust", "distrust")]
    for _ in range(steps):
        moved = now.join(both, "host").select(F.col("dst").alias("host"), "ahead", F.expr(f"(CASE WHEN ahead THEN trust ELSE distrust END) * {damping} div 100 div of * n").alias("m"))
        along = moved.select("host", *[F.when(F.col("ahead") == a, F.col("m")).otherwise(0).alias(c) for a, c in ((True, "trust"), (False, "distrust"))])
        then = out.keep(start.select("host", *stay).unionByName(along).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")))
        if now is not start:
            out.drop(now)
        now = then
    return now


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, threshold: int = THRESHOLD, damping: int = DAMPING, steps: int = STEPS) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (of TOTAL)."""
    url = with_schema(pages, ("page_id", "long"), ("url", "string")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = url.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    said = lambda v: F.count(F.when(F.col("best.verdict") == v, 1))
    counts = ruled.groupBy("host").agg(said("allow").alias("allowed"), said("block").alias("blocked"))
    found = shares(counts, host_edges(pages), damping=damping, steps=steps)
    held = ruled.join(found, "host", "left").fillna(0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") * 100 > F.col("trust") * threshold, "block").otherwise("allow")
    return held.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", by_host).alias("verdict"), "trust", "distrust")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def oracle(rules: Sequence[tuple[str, str]] = RULES) -> str:
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), -r[1].index("/"), r[0] == "allow")):
        at, _, rest = rule.partition("/")
        cases.append(f"WHEN (host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '/{rest}') THEN '{verdict} {rule}'")
    step = """
, s{i} AS MATERIALIZED (
  SELECT host, sum(trust)::BIGINT AS trust, sum(distrust)::BIGINT AS distrust FROM (
    SELECT host, trust * {stay} // 100 AS trust, distrust * {stay} // 100 AS distrust FROM s0
    UNION ALL
    SELECT dst, CASE WHEN ahead THEN trust * {damping} // 100 // degree * n ELSE 0 END, CASE WHEN ahead THEN 0 ELSE distrust * {damping} // 100 // degree * n END
    FROM s{before} JOIN ways ON host = src)
  GROUP BY host)"""
    steps = "".join(step.format(i=i, before=i - 1, stay=100 - DAMPING, damping=DAMPING) for i in range(1, STEPS + 1))
    fold = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    link = LINK.replace("'", "''")
    return f"""
WITH parts AS (
  SELECT page_id, html, {fold(f"coalesce(regexp_extract(url, '{URL}', 1), '')")} AS host, coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages
), ruled AS (
  SELECT page_id, html, host, path, CASE {" ".join(cases)} END AS best FROM parts
), seeds AS (
  SELECT host, count(*) FILTER (best LIKE 'allow %') AS allowed, count(*) FILTER (best LIKE 'block %') AS blocked FROM ruled WHERE host <> '' AND best IS NOT NULL GROUP BY host
), links AS (
  SELECT host AS src, {fold("unnest(regexp_extract_all(html, '" + link + "', 1))")} AS dst FROM ruled
), edges AS (
  SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), ways AS MATERIALIZED (
  SELECT *, sum(n) OVER (PARTITION BY src, ahead)::BIGINT AS degree FROM (SELECT src, dst, n, true AS ahead FROM edges UNION ALL SELECT dst, src, n, false FROM edges)
), s0 AS MATERIALIZED (
  SELECT host, CASE WHEN allowed > 0 THEN {TOTAL} // (sum(allowed) OVER ())::BIGINT * allowed ELSE 0 END AS trust,
    CASE WHEN blocked > 0 THEN {TOTAL} // (sum(blocked) OVER ())::BIGINT * blocked ELSE 0 END AS distrust
  FROM seeds
){steps}
, shares AS (
  SELECT * FROM s{STEPS} WHERE EXISTS (SELECT 1 FROM ways) UNION ALL SELECT * FROM s0 WHERE NOT EXISTS (SELECT 1 FROM ways)
)
SELECT page_id, host, path, best[7:] AS rule, coalesce(best[:5], CASE WHEN coalesce(distrust, 0) * 100 > coalesce(trust, 0) * {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0)::BIGINT AS trust, coalesce(distrust, 0)::BIGINT AS distrust
FROM ruled LEFT JOIN shares USING (host)
"""
