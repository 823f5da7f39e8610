"""URL verdicts: rules first, then trust and distrust propagated over the host graph, in native expressions only.

A rule names a host and the beginning of a path; it fits the host and its subdomains, and the longest fitting rule
decides. Other urls get the verdict of their host. Hosts are the nodes of a graph: an edge for every host that a page's
``href`` values lead to, weighted by pages, and one each way between a host and the nearest known host above it (one
site). Links inside a host are no edges.

Trust starts at the share of a host's pages that rules allow and follows links (personalised PageRank). Distrust starts
at the share that rules block and runs against the links: who links to blocked hosts is distrusted. In each round a host
keeps ``1 - damping`` of its start and receives what its neighbours hand on, in proportion to the weights; a host with
nobody to hand to keeps its own. A host is blocked where its distrust exceeds its trust and reaches what a wholly
blocked host keeps of its start, ``1 - damping``.

Values are whole billionths and every edge rounds down, so sums do not depend on the order of rows, and the rounds end
early once nothing changes. Edges and seeds are counted before they are shuffled, so a host with a third of all pages
is a few rows.

Edge cases: a null url or one without ``://`` has an empty host and path, no rule and is allowed; a null html has no
links; ``href`` values with another scheme and no host (``mailto:``) are no edges, relative ones lead to the own host;
hosts over 253 characters are no valid names and get no site edges; repeated pages count as often; an empty table gives
an empty result; other columns are ignored, but the columns of the result replace those of equal names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.session import cut_lineage

SCALE = 1_000_000_000
#: Rounds between two written tables.
STRETCH = 2
HREF = r"(?i)href[\x09-\x0D\x20]*=[\x09-\x0D\x20]*[\"']?([^\x09-\x0D\x20\"'<>]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST_NAME = 253


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` the host and its subdomains below the path."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.7
    rounds: int = 10
    #: Whether a host and the nearest known host above it count as linked.
    sites: bool = True


def _after(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), "^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, or null; equal lengths go by name."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def link_hosts(host: Column, html: Column) -> Column:
    """Distinct hosts other than ``host`` that the ``href`` values of a page lead to."""

    def to_host(link: Column) -> Column:
        absolute = F.when(F.regexp_like(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), link).when(link.startswith("//"), F.concat(F.lit("http:"), link))
        return host_of(absolute)

    hosts = F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1)), to_host)
    return F.array_distinct(F.filter(hosts, lambda h: (h != "") & (h != host)))


def host_edges(pages: DataFrame, hosts: DataFrame, sites: bool) -> DataFrame:
    """Edges (source, target, weight) from pages (host, html); ``hosts`` lists the known hosts."""
    links = pages.where(F.col("host") != "").select(F.col("host").alias("source"), F.explode(link_hosts(F.col("host"), F.col("html"))).alias("target"))
    if sites:
        labels = F.split("host", r"\.")
        upper = F.transform(F.sequence(F.lit(2), F.size(labels) - 1), lambda i: F.struct((-i).alias("rank"), F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".").alias("above")))
        named = hosts.where((F.length("host") <= LONGEST_NAME) & (F.size(labels) > 2))
        above = named.select("host", F.inline(upper)).join(hosts.select(F.col("host").alias("above")), "above")
        near = above.groupBy("host").agg(F.min_by("above", "rank").alias("above"))
        both = F.explode(F.array(F.struct(F.col("host").alias("source"), F.col("above").alias("target")), F.struct(F.col("above").alias("source"), F.col("host").alias("target"))))
        links = links.unionByName(near.select(both.alias("edge")).select("edge.*"))
    return links.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, how: Propagation) -> DataFrame:
    """Trust and distrust of every host: host, trust, distrust (billionths).

    ``seeds``: host, trust, distrust to start with; ``edges``: source, target, weight. Both values run in one table
    with a ``kind``, so a round is one join and one aggregation.
    """
    ways = cut_lineage(
        edges.withColumn("out", F.sum("weight").over(Window.partitionBy("source"))).withColumn("into", F.sum("weight").over(Window.partitionBy("target")))
        .select(F.inline(F.array(
            F.struct(F.lit("trust").alias("way"), F.col("source").alias("giver"), F.col("target").alias("taker"), (F.col("weight") / F.col("out")).alias("share")),
            F.struct(F.lit("distrust").alias("way"), F.col("target").alias("giver"), F.col("source").alias("taker"), (F.col("weight") / F.col("into")).alias("share")),
        ))),
        "host-ways",
    )
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("start")) for k in ("trust", "distrust")]
    known = edges.select(F.explode(F.array("source", "target")).alias("host")).unionByName(seeds.select("host")).distinct()
    start = known.join(seeds, "host", "left").select("host", F.inline(F.array(*kinds))).withColumn("start", F.coalesce("start", F.lit(0)).cast("bigint"))
    hands = ways.select(F.col("way").alias("kind"), F.col("giver").alias("host"), F.lit(True).alias("hands")).distinct()
    state = cut_lineage(
        start.join(hands, ["kind", "host"], "left").select(
            "kind", "host", F.floor(F.col("start") * F.lit(1 - how.damping)).alias("base"), F.coalesce("hands", F.lit(False)).alias("hands"), F.col("start").alias("value")
        ),
        "host-state",
    )
    done = 0
    while done < how.rounds:
        before, now = state, min(STRETCH, how.rounds - done)
        for _ in range(now):
            state = _round(state, ways, how.damping)
        state, done = cut_lineage(state, "host-state"), done + now
        old = before.select("kind", "host", F.col("value").alias("old"))
        if state.join(old, ["kind", "host"]).where("value <> old").isEmpty():
            break
    return state.groupBy("host").agg(*[F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("trust", "distrust")])


def _round(state: DataFrame, ways: DataFrame, damping: float) -> DataFrame:
    own = (F.col("kind") == F.col("way")) & (F.col("host") == F.col("giver"))
    sent = state.where("hands").select("kind", "host", "value").join(ways, own).select(
        F.col("way").alias("kind"), F.col("taker").alias("host"), F.floor(F.col("value") * F.col("share") * F.lit(damping)).alias("got")
    )
    kept = state.select("kind", "host", (F.col("base") + F.when(F.col("hands"), 0).otherwise(F.floor(F.col("value") * F.lit(damping)))).alias("got"), "base", "hands")
    both = kept.unionByName(sent, allowMissingColumns=True)
    return both.groupBy("kind", "host").agg(F.max("base").alias("base"), F.max("hands").alias("hands"), F.sum("got").alias("value"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...], how: Propagation = Propagation(), url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with host, path, rule, verdict, trust and distrust (billionths; 0 for urls without a host)."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    found = rule_of(F.col("host"), F.col("path"), rules).alias("found")
    named = pages.select(host.alias("host"), path.alias("path"), F.col(html).alias("html")).where(F.col("host") != "")
    share = lambda verdict: F.floor(F.count_if(F.col("found.verdict") == verdict) * F.lit(float(SCALE)) / F.count(F.lit(1)))
    seeds = cut_lineage(named.select("host", found).groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "host-seeds")
    edges = cut_lineage(host_edges(named, seeds.select("host"), how.sites), "host-edges")
    limit = round((1 - how.damping) * SCALE) - 1
    verdict = F.when((F.col("distrust") >= limit) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    hosts = propagate(seeds, edges, how).select(F.col("host").alias("__host"), F.struct("trust", "distrust", verdict.alias("verdict")).alias("__own"))
    rule, own = F.col("__rule"), F.col("__own")
    return (
        pages.withColumns({"host": host, "path": path}).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
        .join(hosts, F.col("host") == F.col("__host"), "left")
        .withColumns({
            "rule": rule["rule"], "verdict": F.coalesce(rule["verdict"], own["verdict"], F.lit("allow")),
            "trust": F.coalesce(own["trust"], F.lit(0)), "distrust": F.coalesce(own["distrust"], F.lit(0)),
        })
        .drop("__rule", "__host", "__own")
    )
