"""URL filter: host and path rules, and link-graph propagation for what they leave open.

Host edges come from the absolute links of all pages. Trust is a personalised
PageRank along the edges: a host restarts with the share of its pages that
rules allow, and passes its trust to the hosts it links to. Distrust runs
against the edges: a host restarts with the share of its pages that rules
block, and passes distrust to the hosts that link to it. A page without a rule
is blocked if its host's distrust exceeds its trust by more than a threshold;
half of what a host with blocked pages alone restarts with, by default.

DataFrame functions only. Pages become counts by host and host pair before
anything is joined; verdicts come back to pages by a join on the blocked hosts,
broadcast only if their counted number is small.

Defined cases: a null url, or one without ``://``, has an empty host and path,
fits no rule, adds no edge and is allowed. Null html has no links. A link to the
own host, or to one without pages, counts as an edge only in the latter case.
Repeated rows count as often as they stand there. Empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, small_side

#: (verdict, host, path), fixed values of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, ROUNDS = 0.85, 12
THRESHOLD = (1 - DAMPING) / 2
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href[\x20\x09\x0A\x0C\x0D]*=[\x20\x09\x0A\x0C\x0D]*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'<>\x20\x09\x0A\x0C\x0D]+)"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, _UP, _LOW), F.lit("")), F.coalesce(path, F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def _longest(host: Column, path: Column, rules, value) -> Column:
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    return reduce(lambda c, r: F.when(fits(host, path, r[1], r[2]), F.lit(value(r))) if c is None else c.when(fits(host, path, r[1], r[2]), F.lit(value(r))), order, None) if order else F.lit(None).cast("string")


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and its verdict (null without a rule), and html."""
    host, path = host_and_path(F.col("url"))
    at = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    h, p = F.col("host"), F.col("path")
    return at.select("page_id", "html", "host", "path", _longest(h, p, rules, lambda r: r[1] + r[2]).alias("rule"), _longest(h, p, rules, lambda r: r[0]).alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and the number of links, between different hosts."""
    linked = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    return linked.select("src", F.translate("dst", _UP, _LOW).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(restart: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust, from restart(host, trust, distrust) over edges(src, dst, n)."""
    out_ = edges.groupBy("src").agg(F.sum("n").alias("total"))
    in_ = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    share = (F.col("n") / F.col("total")).alias("share")
    forward = edges.join(out_, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), share)
    backward = edges.join(in_, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), share)
    flow = forward.union(backward).checkpoint()
    base = restart.select("host", F.explode(F.map_from_arrays(F.array(F.lit("trust"), F.lit("distrust")), F.array("trust", "distrust"))).alias("kind", "r")).where("r > 0")
    base = base.select("kind", "host", (F.col("r") * (1 - damping)).alias("r")).checkpoint()
    rank = base
    if not flow.isEmpty():
        for i in range(rounds):
            passed = flow.join(rank, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("r") * F.col("share") * damping).alias("r"))
            rank = base.union(passed).groupBy("kind", "host").agg(F.sum("r").alias("r"))
            if i % 4 == 3:
                rank = rank.checkpoint()
    total = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("r")).otherwise(0.0)).alias(kind)
    return rank.groupBy("host").agg(total("trust"), total("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, *, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    prepare(pages.sparkSession)
    at = judged(pages, rules)
    counts = at.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.sum((F.col("ruled") == "allow").cast("long")).alias("good"), F.sum((F.col("ruled") == "block").cast("long")).alias("bad"))
    restart = counts.select("host", (F.coalesce("good", F.lit(0)) / F.col("n")).alias("trust"), (F.coalesce("bad", F.lit(0)) / F.col("n")).alias("distrust"))
    scores = propagate(restart, host_edges(at), rounds, damping)
    blocked = scores.where(F.col("distrust") - F.col("trust") > threshold).select("host", F.lit(True).alias("bad_host")).checkpoint()
    # a hot host is split by the adaptive skew join where the list is too long to broadcast
    out = at.join(small_side(blocked, blocked.count()), "host", "left")
    verdict = F.coalesce("ruled", F.when(F.col("bad_host"), F.lit("block")).otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def filter_sql(rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same over a view pages, as DuckDB SQL."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in order) + " END"
    link = LINK.replace("'", "''")
    steps = ["r0 AS (SELECT * FROM base)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS (SELECT kind, host, sum(r) AS r FROM (SELECT * FROM base UNION ALL SELECT f.kind, f.dst, r.r * f.share * {damping} FROM flow f JOIN r{i} r ON f.kind = r.kind AND f.host = r.host) GROUP BY 1, 2)")
    return f"""
WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
placed AS (SELECT page_id, html, coalesce(translate(raw, '{_UP}', '{_LOW}'), '') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM parts),
judged AS (SELECT *, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled FROM placed),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{_UP}', '{_LOW}') AS dst FROM judged WHERE host <> ''),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY 1, 2),
flow AS (SELECT 'trust' AS kind, src AS host, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM edges
  UNION ALL SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM edges),
shares AS (SELECT host, count(*) FILTER (ruled = 'allow') / count(*) AS trust, count(*) FILTER (ruled = 'block') / count(*) AS distrust FROM judged WHERE host <> '' GROUP BY host),
base AS (SELECT 'trust' AS kind, host, trust * {1 - damping} AS r FROM shares WHERE trust > 0 UNION ALL SELECT 'distrust', host, distrust * {1 - damping} FROM shares WHERE distrust > 0),
{", ".join(steps)},
blocked AS (SELECT host FROM r{rounds} GROUP BY host HAVING sum(CASE kind WHEN 'distrust' THEN r ELSE -r END) > {threshold})
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""
