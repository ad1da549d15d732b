"""URL filters: rules first, then trust and distrust propagated over the host link graph.

Native: DataFrame functions only. Personalised PageRank flows from trusted hosts along links;
distrust flows from blocked hosts against the links, each host taking it by the share of its own links, so
that a host's distrust is the chance that a walk from it along links, which stops with 1 - DAMPING at each host, stops at a
blocked one. That chance does not depend on how many others link there. Both run in one table, keyed by
(kind, host), until no score changes by more than TOLERANCE.

Edge cases: a null url, or one without ://, has empty host and path and is allowed, for no rule and
no score reach it; null html has no links; repeated rows are judged alike; an empty table gives no
rows; other columns are ignored. A host without links or seeds scores 0 and is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: (verdict, rule); a rule is host/path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ROUNDS, DAMPING, LEAST_DISTRUST = 6, 0.85, 0.01
#: Scores are written, and compared with those written before, every ROUNDS rounds.
TOLERANCE = 1e-6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The authority of an absolute or scheme-relative link of an anchor.
LINK = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def longest_first(rules) -> list[tuple[str, str]]:
    return sorted(rules, key=lambda r: -len(r[1]))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent domain of it and the path's start, and its verdict; else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in reversed(longest_first(rules)):
        of, slash, start = text.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, p: links between different hosts; p is the share of src's links. Counted per host pair before any join."""
    links = F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, UPPER, LOWER))
    pairs = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("dst")).filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    out = pairs.groupBy("src").agg(F.sum("n").alias("out"))
    return pairs.join(out, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("p"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    """Each link turned round, with the share that it has of the links of the host it leaves."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p")


def propagate(edges: DataFrame, home: DataFrame, rank: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """kind, src, dst, p and kind, host, score -> kind, host, score some rounds on. One join and one aggregation a round."""
    for _ in range(rounds):
        flow = edges.alias("e").join(rank.alias("r"), (F.col("e.kind") == F.col("r.kind")) & (F.col("e.src") == F.col("r.host")))
        flow = flow.select("e.kind", F.col("e.dst").alias("host"), (F.col("e.p") * F.col("r.score") * damping).alias("score"))
        rank = flow.unionByName(home).groupBy("kind", "host").agg(F.sum("score").alias("score"))
    return rank


def converged(edges: DataFrame, seeds: DataFrame, scratch: Scratch, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """kind, host, score once no score changes by more than TOLERANCE within `rounds` rounds; each such step is written, which cuts the lineage.

    A round shrinks what is left to change by the damping, so the steps end.
    """
    home = seeds.select("kind", "host", (F.col("seed") * (1 - damping)).alias("score"))
    rank, step = home, 0
    while True:
        new = scratch.write(propagate(edges, home, rank, rounds, damping), f"rank-{step}")
        both = new.unionByName(rank.select("kind", "host", (-F.col("score")).alias("score"))).groupBy("kind", "host").agg(F.abs(F.sum("score")).alias("change"))
        change = both.agg(F.max("change")).first()[0]
        if step:
            scratch.drop(f"rank-{step - 1}")
        if (change or 0.0) <= TOLERANCE:
            return new
        rank, step = new, step + 1


def host_scores(pages: DataFrame, scratch: Scratch, rules=RULES, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust. Seeds are the hosts that the rules mostly allow (kind 1) or mostly block (kind 0)."""
    edges = scratch.write(host_edges(pages), "edges")
    both = scratch.write(edges.select(F.lit(1).alias("kind"), "*").unionByName(reversed_edges(edges).select(F.lit(0).alias("kind"), "*")), "kinds")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    seeds = pages.select(host.alias("host"), rule_of(host, path, rules)[1].alias("verdict")).filter("verdict is not null and host <> ''")
    seeds = seeds.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count("*").alias("n"))
    seeds = scratch.write(seeds.select(F.when(F.col("allowed") * 2 > F.col("n"), 1).otherwise(0).alias("kind"), "host", F.lit(1.0).alias("seed")), "seeds")
    scores = converged(both, seeds, scratch, rounds)
    by_kind = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0))
    return scores.groupBy("host").agg(by_kind(1).alias("trust"), by_kind(0).alias("distrust"))


def judge(pages: DataFrame, scratch: Scratch, rules=RULES, rounds: int = ROUNDS, least: float = LEAST_DISTRUST) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages (page_id, url, html).

    Without a rule a page is blocked if its host's distrust is at least `least` and above its trust.
    Pages of one hot host spread over tasks: pages join the hosts' scores as a skew-splittable left join.
    """
    scores = scratch.write(host_scores(pages, scratch, rules, rounds), "scores")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_of(host, path, rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("ruled"))
    judged = judged.join(scores.withColumnRenamed("host", "scored"), F.col("host") == F.col("scored"), "left")
    by_host = F.when((F.col("distrust") >= least) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), Scratch(spark, "op1")).select("page_id", "host", "path", "rule", "verdict")


#: Rounds of the SQL: what is left to change after them is below DAMPING ** SQL_ROUNDS, 5e-7.
SQL_ROUNDS = 90


def oracle(rules=RULES, rounds: int = SQL_ROUNDS, damping: float = DAMPING, least: float = LEAST_DISTRUST) -> str:
    """The same propagation in SQL, round by round. A verdict could differ only where a score lies within TOLERANCE / (1 - damping) of a threshold."""
    fits = [((f"(host = '{t.partition('/')[0]}' or ends_with(host, '.{t.partition('/')[0]}')) and starts_with(path, '/{t.partition('/')[2]}')"), w, t) for w, t in longest_first(rules)]
    case = lambda i: "case " + " ".join(f"when {f[0]} then '{f[i]}'" for f in fits) + " end"
    link = LINK.replace("'", "''")
    return f"""
with recursive cut as (select page_id, html, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') as host, regexp_extract(coalesce(url, ''), '{URL}', 2) as path from pages),
ruled as (select *, {case(2)} as rule, {case(1)} as ruled from cut),
pairs as (select src, dst, count(*) as n from (select host as src, translate(unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)), '{UPPER}', '{LOWER}') as dst from cut) where src <> '' and src <> dst group by src, dst),
edges as (select src, dst, n / sum(n) over (partition by src) as p from pairs),
kinds as (select 1 as kind, src, dst, p from edges union all select 0, dst, src, p from edges),
seeds as (select case when count_if(ruled = 'allow') * 2 > count(*) then 1 else 0 end as kind, host, {1 - damping}::double as home from ruled where ruled is not null and host <> '' group by host),
walk as (select 0 as step, kind, host, home as score from seeds union all
  select step + 1, kind, host, sum(score) from (select r.step, e.kind, e.dst as host, e.p * r.score * {damping} as score from kinds e join walk r on e.kind = r.kind and e.src = r.host
    union all select r.step, s.kind, s.host, s.home from seeds s, (select distinct step from walk) r) where step < {rounds} group by step, kind, host),
r as (select kind, host, score from walk where step = {rounds}),
scores as (select host, coalesce(sum(score) filter (kind = 1), 0) as trust, coalesce(sum(score) filter (kind = 0), 0) as distrust from r group by host)
select page_id, ruled.host, path, rule, coalesce(ruled, case when distrust >= {least} and distrust > trust then 'block' else 'allow' end) as verdict
from ruled left join scores on ruled.host = scores.host"""


QUERIES = {"op1_url_filters": op1_url_filters}
ORACLES = {"op1_url_filters": oracle()}
