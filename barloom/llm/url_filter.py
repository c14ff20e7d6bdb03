"""URL filter: rules first, then trust and distrust spread over the graph of hosts.

Hosts are nodes; their links, counted per pair of hosts, and the ties between a
host and its parent domain are edges. Personalised PageRank runs along the edges
from trusted hosts and, on the reversed edges, from blocked ones: what a trusted
host links to gains trust, what links to a blocked host gains distrust. A host
whose distrust outweighs its trust is blocked. Each round is a join and an
aggregation by host; nothing of the graph reaches the driver but a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.shared import ascii_lower, broadcast_if, written

DAMPING, ROUNDS, TOLERANCE, EVERY = 0.85, 40, 1e-4, 5
#: Weight of the tie between a host and its parent domain, in links.
TIE = 1.0
#: Edges and scores a task of a round handles, about.
EDGES_PER_FILE = 1_000_000
#: Rules up to this number are broadcast (some 100 bytes each).
BROADCAST_RULES = 100_000
#: Hosts with what is known of them are broadcast up to this number (some 200 bytes each); beyond, the join is shuffled and hot hosts are split.
BROADCAST_HOSTS = 100_000
LINK = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``, A-Z lower-cased; empty for null and other addresses."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains, down to one label."""
    labels = F.split(host, r"\.")
    return F.when(host != "", F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).otherwise(F.array().cast("array<string>"))


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Per host the rules on it or a parent domain: ``host, fits`` (length, rule, path, verdict)."""
    named = rules.select(F.col("host").alias("on"), F.struct(
        F.length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("fit"))
    return (hosts.select("host", F.explode(suffixes(F.col("host"))).alias("on")).join(broadcast_if(named, BROADCAST_RULES), "on")
            .groupBy("host").agg(F.collect_list("fit").alias("fits")))


def host_edges(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """``src, dst, weight``: links between different hosts, counted, and ties of hosts to their parent domains."""
    linked = F.filter(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda x: x.rlike(r"(?i)^(https?:)?//"))
    links = (pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(linked).alias("to"))
             .select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))).alias("dst"))
             .where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
    every = hosts.select("host").union(links.select("dst")).where("host <> ''").distinct()
    chain = suffixes(F.col("host"))
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size(chain)), lambda i: F.struct(
        F.get(chain, i - 1).alias("child"), F.get(chain, i).alias("parent"))))
    ties = (every.select(pair.alias("tie")).select("tie.*").where("parent is not null and instr(parent, '.') > 0").distinct())
    ties = ties.select(F.col("child").alias("src"), F.col("parent").alias("dst")).union(ties.select("parent", "child"))
    return (links.union(ties.withColumn("weight", F.lit(TIE))).groupBy("src", "dst").agg(F.sum("weight").alias("weight")))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank of both kinds: ``host, kind, score``.

    ``seeds`` has ``host, kind, seed``: kind ``trust`` follows the edges, ``distrust``
    goes against them. Seeds of a kind are scaled to a sum of 1. What reaches a
    host without further edges is not passed on. Stops when a round changes less
    than ``tolerance`` in all, looked at every few rounds. A round is one shuffle of
    what the hosts pass on, summed before it; its scores are written, so the next
    round's join knows their size.
    """
    both = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "weight").union(
        edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), "weight"))
    out = both.groupBy("kind", "host").agg(F.sum("weight").alias("all"))
    both = written(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("weight") / F.col("all")).alias("share")), "url-edges")
    files = max(edges.sparkSession.sparkContext.defaultParallelism, both.count() // EDGES_PER_FILE)
    total = seeds.groupBy("kind").agg(F.sum("seed").alias("total"))
    base = written(seeds.join(F.broadcast(total), "kind").where("seed > 0")  # two rows
                   .select("host", "kind", ((1 - DAMPING) * F.col("seed") / F.col("total")).alias("score")).coalesce(files), "url-seeds")
    score, before = base, None
    for i in range(1, rounds + 1):
        passed = both.join(score, ["kind", "host"]).select(F.col("to").alias("host"), "kind", (DAMPING * F.col("share") * F.col("score")).alias("score"))
        score = written(passed.union(base).groupBy("host", "kind").agg(F.sum("score").alias("score")).coalesce(files), "url-scores")
        if (i + 1) % EVERY and i % EVERY:
            continue
        now = score.agg(F.sum("score")).first()[0]
        if now is None or (i % EVERY == 0 and now - before < tolerance):  # scores only grow
            break
        before = now
    return score


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          threshold: float = 0.0) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, trust, distrust``.

    ``rules`` (host, path, verdict) fit their host and its subdomains if the path
    of the url starts with theirs; the longest that fits decides (equally long:
    the last by name). Without one the host decides: blocked if distrust - trust
    is above ``threshold`` times their sum and above 0. Hosts are trusted or
    blocked seeds by the share of their pages that rules allow or block. Null and
    other addresses have an empty host and path and are allowed. Without rules or
    pages nothing is blocked. Repeated rows stay; other columns are ignored.
    """
    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    source = source.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    hosts = written(source.groupBy("host").count(), "url-hosts")
    fits = written(host_rules(hosts, rules), "url-fits")
    best = F.array_max(F.filter("fits", lambda f: F.col("path").startswith(f["path"])))
    ruled = source.join(broadcast_if(fits, BROADCAST_HOSTS), "host", "left").withColumn("best", best)
    share = lambda verdict: F.sum((F.col("best.verdict") == verdict).cast("long"))
    seeds = ruled.drop("html").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"), F.count("*").alias("n"))
    seeds = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust") / F.col("n"), F.lit("distrust"), F.col("distrust") / F.col("n")))
                         .alias("kind", "seed")).where("seed > 0")
    score = spread(written(host_edges(source, hosts), "url-graph"), written(seeds, "url-shares"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    known = score.groupBy("host").agg(of("trust"), of("distrust"))
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    against = distrust - trust
    method = F.when((against > 0) & (against > threshold * (distrust + trust)), "block").otherwise("allow")
    table = hosts.join(known, "host", "left").join(fits, "host", "left").select(
        "host", "fits", trust.alias("trust"), distrust.alias("distrust"), method.alias("method"))
    table = broadcast_if(written(table, "url-judged"), BROADCAST_HOSTS)
    return source.drop("html").join(table, "host", "left").withColumn("best", best).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", "method").alias("verdict"),
        "trust", "distrust")
