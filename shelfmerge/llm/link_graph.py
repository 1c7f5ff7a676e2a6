"""URL verdicts: host and path rules first, then trust and distrust over the link graph.

Hosts of allowed pages seed personalised PageRank along links; hosts of blocked
pages seed the same walk along reversed links, since a page that points to bad
places is suspect. A host whose distrust exceeds its trust is blocked; they are
compared by their ratio, and a host that only distrust reaches is blocked however
little arrives. The walks go on until they reach no new host and the verdicts are
settled: no score that has to be compared can still cross the other.

Everything is DataFrame work: links are counted per pair of hosts before any
join, a round is two joins and one aggregation over host pairs, and its result
is written to the shared folder. Without links between hosts no round is run.

Defined results: a null url or one without ``://`` has an empty host and path and
is never blocked; a null page counts no links; repeated rows are judged alike;
hosts that neither walk reaches are allowed.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmerge.llm.common import materialise

#: (host, path, verdict): a rule fits its host and all subdomains, if the path starts with its own.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Rounds at least.
ROUNDS = 8
DAMPING = 0.85
#: Trust and distrust that differ by less than this share are equal; scores that change by less are settled.
EQUAL = 1e-9
#: Links with a host of their own.
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)


def pick(host: Column, path: Column, rules, value) -> Column:
    """value(rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r[0] + r[1])):
        out = F.when(fits(host, path, r[0], r[1]), F.lit(value(r))).otherwise(out)
    return out


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, rule_verdict."""
    host, path = F.col("host"), F.col("path")
    return pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select(
        "page_id",
        "host",
        "path",
        pick(host, path, rules, lambda r: r[0] + r[1]).alias("rule"),
        pick(host, path, rules, lambda r: r[2]).alias("rule_verdict"),
    )


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    found = pages.select(
        host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("dst")
    )
    lowered = found.select("src", lower_ascii(F.col("dst")).alias("dst")).filter("src <> '' and dst <> '' and src <> dst")
    return lowered.groupBy("src", "dst").agg(F.count("*").alias("n"))


def shares(links: DataFrame) -> DataFrame:
    """Links with the share of their source's outgoing, and of their target's incoming links."""
    out = links.groupBy("src").agg(F.sum("n").alias("n_out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("n_in"))
    return (
        links.join(out, "src")
        .join(into, "dst")
        .select("src", "dst", (F.col("n") / F.col("n_out")).alias("forward"), (F.col("n") / F.col("n_in")).alias("backward"))
    )


def propagate(links: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust, liked, feared) after ``rounds`` rounds, and as many more as the verdicts need.

    seeds: (host, trust, distrust), each summing to one. liked and feared: the
    walk reaches the host, even where its score is too small for a double.
    """
    links = materialise(shares(links), "host-links")
    seeds = materialise(seeds.withColumns({"liked": F.col("trust") > 0, "feared": F.col("distrust") > 0}), "host-seeds")
    rank, reached, k = seeds, None, 0
    while True:
        there = links.join(rank, links.src == rank.host).select(
            links.dst.alias("host"),
            (damping * F.col("trust") * F.col("forward")).alias("trust"),
            F.lit(0.0).alias("distrust"),
            "liked",
            F.lit(False).alias("feared"),
        )
        back = links.join(rank, links.dst == rank.host).select(
            links.src.alias("host"),
            F.lit(0.0).alias("trust"),
            (damping * F.col("distrust") * F.col("backward")).alias("distrust"),
            F.lit(False).alias("liked"),
            "feared",
        )
        fresh = seeds.select(
            "host",
            ((1 - damping) * F.col("trust")).alias("trust"),
            ((1 - damping) * F.col("distrust")).alias("distrust"),
            "liked",
            "feared",
        )
        summed = (
            there.union(back)
            .union(fresh)
            .groupBy("host")
            .agg(
                F.sum("trust").alias("trust"),
                F.sum("distrust").alias("distrust"),
                F.bool_or("liked").alias("liked"),
                F.bool_or("feared").alias("feared"),
            )
        )
        before, rank, k = rank, materialise(summed, f"host-rank-{k}"), k + 1
        if k < rounds:
            continue
        now = tuple(rank.agg(F.count_if("liked"), F.count_if("feared")).first())
        if now == reached and settled(before, rank, damping):
            return rank
        reached = now


def settled(before: DataFrame, rank: DataFrame, damping: float) -> bool:
    """Whether no host that both walks reach can change its verdict.

    What all later rounds move is at most damping / (1 - damping) of what the last one moved.
    """
    old = before.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d"))
    both = rank.join(old, "host", "left").withColumns(
        {"dt": F.abs(F.col("trust") - F.coalesce("t", F.lit(0.0))), "dd": F.abs(F.col("distrust") - F.coalesce("d", F.lit(0.0)))}
    )
    moved = both.agg(F.sum(F.col("dt") + F.col("dd"))).first()[0] or 0.0
    far = F.abs(F.col("trust") - F.col("distrust")) > moved * damping / (1 - damping) + EQUAL * F.col("trust")
    still = (F.col("dt") <= EQUAL * F.col("trust") * (1 - damping)) & (F.col("dd") <= EQUAL * F.col("distrust") * (1 - damping))
    return both.filter(F.col("liked") & F.col("feared")).filter(~far & ~still).isEmpty()


def blocked_hosts(pages: DataFrame, verdicts: DataFrame) -> DataFrame | None:
    """Hosts that the walks block; None where no host links to another."""
    links = materialise(host_links(pages), "links")
    if links.isEmpty():
        return None
    counts = (
        verdicts.filter("host <> ''")
        .groupBy("host")
        .agg(F.count_if(F.col("rule_verdict") == "allow").alias("a"), F.count_if(F.col("rule_verdict") == "block").alias("b"))
        .filter("a > 0 or b > 0")
    )
    total = counts.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb")).first()
    seeds = counts.select(
        "host", (F.col("a") / max(1, total.sa or 0)).alias("trust"), (F.col("b") / max(1, total.sb or 0)).alias("distrust")
    )
    rank = propagate(links, seeds)
    more = F.col("distrust") > F.col("trust") * (1 + EQUAL)
    return rank.filter("feared").filter(~F.col("liked") | more).select("host")


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    pages = pages.select("page_id", "url", "html")
    verdicts = judged(pages, rules)
    bad = blocked_hosts(pages, verdicts)
    if bad is None:
        method = F.lit("allow")
        marked = verdicts
    else:
        marked = verdicts.join(bad.withColumn("bad", F.lit(True)), "host", "left")
        method = F.when(F.col("bad"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"))
