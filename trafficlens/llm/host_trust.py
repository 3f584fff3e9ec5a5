"""URL verdicts: rules first, then trust that spreads over the links between hosts.

Trust is a personalised PageRank from the hosts with allowed pages along their links. Distrust runs
the other way: from the hosts with blocked pages back to the hosts that link to them. Besides the
links of the pages, a host and its parent domain are linked both ways if both occur. A host is
blocked if its distrust exceeds its trust by more than a threshold.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.columns import lower_ascii, named, shared_table
from trafficlens.plans.sides import small_side

DAMPING, THRESHOLD = 0.85, 1e-12
#: What may be outstanding, over all hosts, when the spreading ends.
TOLERANCE = 1e-13
HREF = r"""<[aA]\s[^>]*?[hH][rR][eE][fF]\s*=\s*["']([^"'>]*)["']"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark or hash, A-Z lowered; else empty."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, rules): per host the rules that fit it by host; rules are (verdict, 'host/path')."""
    spark = hosts.sparkSession
    listed = [(f"{host}/{path}", host, f"/{path}", verdict)
              for verdict, rule in rules for host, path in [rule.split("/", 1)]]
    table = spark.createDataFrame(listed, "rule string, of string, start string, verdict string")
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    return hosts.select("host", F.explode(ends).alias("of")).join(small_side(table), "of").groupBy(
        "host").agg(F.collect_list(F.struct("rule", "start", "verdict")).alias("rules"))


def most_rounds(tolerance: float = TOLERANCE, damping: float = DAMPING) -> int:
    """After so many rounds no more than ``tolerance`` is outstanding in any graph."""
    return math.ceil(math.log(tolerance) / math.log(damping))


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE,
           damping: float = DAMPING) -> DataFrame:
    """(host, kind, score) with score = (1 - damping) seed + damping * inflow, to ``tolerance``.

    ``edges`` (source, target, kind, share): what part of a host's score of a kind goes where. What
    the seeds give walks along the edges; each host keeps 1 - damping of what reaches it and passes the
    rest on, until what is still under way, summed over all hosts of a kind, is within the tolerance.
    """
    edges = small_side(edges)
    walk = shared_table(seeds.withColumnRenamed("seed", "score"), "trust")
    reached, rounds = [walk], 0
    while rounds < most_rounds(tolerance, damping):
        steps = [walk]
        for _ in range(TOGETHER):
            steps.append(
                steps[-1].withColumnRenamed("host", "source").join(edges, ["source", "kind"])
                .groupBy(F.col("target").alias("host"), "kind")
                .agg(F.sum(F.col("score") * F.col("share") * damping).alias("score")))
        # the exchanges of one step are used again by the next
        tagged = [s.withColumn("step", F.lit(k)) for k, s in enumerate(steps[1:])]
        table = shared_table(reduce(DataFrame.unionByName, tagged), "trust")
        walk = table.where(F.col("step") == TOGETHER - 1).drop("step")
        reached.append(table.drop("step"))
        rounds += TOGETHER
        under_way = walk.groupBy("kind").agg(F.sum("score").alias("s")).agg(F.max("s")).first()[0]
        if (under_way or 0.0) <= tolerance:
            break
    return reduce(DataFrame.unionByName, reached).groupBy("host", "kind").agg(
        (F.sum("score") * (1 - damping)).alias("score"))


#: Rounds of one job.
TOGETHER = 6


def host_edges(pages: DataFrame, hosts: DataFrame, url_col: str = "url", html_col: str = "html"
               ) -> DataFrame:
    """(source, target, links): links between different hosts, counted; and parents as one link.

    A link is the href of an anchor. One without ``://`` stays on its host, unless it starts with
    ``//``.
    """
    href = F.explode(F.regexp_extract_all(named(html_col), F.lit(HREF), F.lit(1))).alias("href")
    outward = pages.select(host_of(named(url_col)).alias("source"), href).select(
        "source", F.when(F.col("href").startswith("//"), host_of(F.concat(F.lit("x:"), "href")))
        .otherwise(host_of(F.col("href"))).alias("target"))
    links = shared_table(
        outward.where("source <> '' and target <> '' and source <> target")
        .groupBy("source", "target").agg(F.count("*").alias("links")), "host-links")
    all_hosts = hosts.select("host").unionByName(
        links.select(F.col("target").alias("host"))).distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.(.+)$", 1)
    up = all_hosts.select(F.col("host").alias("source"), parent.alias("target")).join(
        all_hosts.withColumnRenamed("host", "target"), "target", "left_semi").select(
        "source", "target")
    both = up.unionByName(up.select(F.col("target").alias("source"), F.col("source").alias("target")))
    return links.unionByName(both.withColumn("links", F.lit(1).cast("long"))).groupBy(
        "source", "target").agg(F.sum("links").alias("links"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id",
          url_col: str = "url", html_col: str = "html", tolerance: float = TOLERANCE,
          threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    ``rules`` are (allow or block, 'host/path'); of those that fit, the longest decides. Pages that
    no rule fits get their host's verdict. A null url, or one without ``://``, has an empty host and
    path; an empty host is trusted and distrusted by nobody, and allowed. Null html has no links.
    Repeated rows are judged alike and count as pages of their own for the seeds.
    """
    url = named(url_col)
    own = shared_table(pages.select(named(id_col).alias("page_id"), host_of(url).alias("host"),
                                    path_of(url).alias("path")), "pages")
    hosts = shared_table(own.where("host <> ''").select("host").distinct(), "hosts")
    fitting = shared_table(_ruled(hosts, rules), "host-rules")
    found = F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]))
    longest = F.array_max(F.transform(found, lambda r: F.struct(
        F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    ruled = shared_table(
        own.join(small_side(fitting), "host", "left").withColumn("r", longest).select(
            "page_id", "host", "path", F.col("r.rule").alias("rule"),
            F.col("r.verdict").alias("verdict")), "pages-ruled")

    counts = ruled.where("verdict is not null").groupBy(
        "host", F.when(F.col("verdict") == "allow", "trust").otherwise("distrust").alias("kind")
    ).agg(F.count("*").alias("n"))
    totals = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = shared_table(counts.join(F.broadcast(totals), "kind").select(
        "host", "kind", (F.col("n") / F.col("total")).alias("seed")), "host-seeds")
    links = shared_table(host_edges(pages, hosts, url_col, html_col), "host-edges")
    forth = links.withColumn("kind", F.lit("trust"))
    back = links.select(F.col("target").alias("source"), F.col("source").alias("target"), "links",
                        F.lit("distrust").alias("kind"))
    edges = forth.unionByName(back)
    out = edges.groupBy("source", "kind").agg(F.sum("links").alias("all"))
    edges = shared_table(edges.join(out, ["source", "kind"]).select(
        "source", "target", "kind", (F.col("links") / F.col("all")).alias("share")), "host-shares")
    score = spread(edges, seeds, tolerance)
    per_host = shared_table(
        score.groupBy("host").agg(
            *[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k)
              for k in ("trust", "distrust")]), "host-scores")
    zero = F.lit(0.0)
    return ruled.join(small_side(per_host), "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(
            F.coalesce("distrust", zero) - F.coalesce("trust", zero) > threshold, F.lit("block")
        ).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))


def judge_sql(rules: Sequence[tuple[str, str]], tolerance: float = TOLERANCE,
              damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The verdicts in DuckDB SQL over a table ``pages``, by a recursion to the same tolerance."""
    def host(url: str) -> str:
        return (f"translate(coalesce(regexp_extract({url}, '^[\\s\\S]*?://([^/?#]*)', 1), ''), "
                "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

    def case(pick) -> str:
        whens = []
        for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
            of, path = rule.split("/", 1)
            whens.append(f"when (host = '{of}' or ends_with(host, '.{of}')) and "
                         f"starts_with(path, '/{path}') then '{pick(verdict, rule)}'")
        return "case " + " ".join(whens) + " end"

    href = HREF.replace("'", "''")
    rounds = most_rounds(tolerance, damping)
    return f"""
with recursive own as (
  select page_id, html, {host('url')} as host,
         coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
ruled as (select *, {case(lambda v, r: r)} as rule, {case(lambda v, r: v)} as verdict from own),
hrefs as (select host as source, unnest(regexp_extract_all(html, '{href}', 1)) as href from own),
outward as (
  select source, {host("case when starts_with(href, '//') then 'x:' || href else href end")} as target
  from hrefs),
links as (
  select source, target, count(*) as links from outward
  where source <> '' and target <> '' and source <> target group by source, target),
hosts as (select host from own where host <> '' union select target from links),
up as (
  select host as source, regexp_extract(host, '^[^.]+\\.(.+)$', 1) as target from hosts
  where regexp_extract(host, '^[^.]+\\.(.+)$', 1) in (select host from hosts)),
all_links as (
  select source, target, sum(links) as links from (
    select * from links union all select source, target, 1 from up
    union all select target, source, 1 from up) group by source, target),
edges as (
  select source, target, links, 'trust' as kind from all_links
  union all select target, source, links, 'distrust' from all_links),
shares as (
  select source, target, kind, links / sum(links) over (partition by source, kind) as share from edges),
seeds as (
  select host, kind, n / sum(n) over (partition by kind) as seed from (
    select host, case verdict when 'allow' then 'trust' else 'distrust' end as kind, count(*) as n
    from ruled where verdict is not null group by 1, 2)),
walk as (
  select 0 as round, host, kind, seed as score from seeds
  union all
  select w.round + 1, e.target, e.kind, sum(w.score * e.share) * {damping!r}
  from walk w join shares e on w.host = e.source and w.kind = e.kind
  where w.round < {rounds} group by w.round, e.target, e.kind),
kept as (select host, kind, {1 - damping!r} * sum(score) as score from walk group by host, kind),
scores as (
  select host, coalesce(sum(score) filter (kind = 'trust'), 0) as trust,
         coalesce(sum(score) filter (kind = 'distrust'), 0) as distrust from kept group by host)
select page_id, r.host, path, rule, coalesce(verdict, case
  when coalesce(distrust, 0) - coalesce(trust, 0) > {threshold!r} then 'block' else 'allow' end) as verdict
from ruled r left join scores s on r.host = s.host
"""
