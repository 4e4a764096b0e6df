"""URL filters: rules by host and path, and link-graph propagation for what no rule fits.

Trust starts at hosts with allowed pages and flows along links (personalised PageRank);
distrust starts at hosts with blocked pages and flows against links. Links join hosts: those
in the pages' HTML, weighted by their number, and one in each direction between a host and
the domain it belongs to (one label less, down to two labels). Scores spread until they
settle, however far a host is from the seeds. A host with more distrust than trust is
blocked, any other is allowed; how small the two are does not matter. A rule that fits a URL goes before that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from servertide.operators.scratch import written

#: host and path of a rule, and its verdict.
Rule = tuple[str, str, str]
DAMPING = 0.85
ROUNDS = 12
#: Rounds between tables in the shared folder.
CUT_EVERY = 4
#: Scores have settled when none rises by more than this share of itself between two tables.
SETTLED = 1e-4
#: Scores that differ by no more than this share of the larger are equal, so that the order of a sum does not matter.
TIE = 1e-3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)href\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _suffixes(host: Column) -> Column:
    """A host and all domains it lies in."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def rules_of_hosts(hosts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(host, rules): the rules that fit a host, the longest first."""
    spark = hosts.sparkSession
    table = spark.createDataFrame(list(rules), "domain string, prefix string, verdict string")
    fits = hosts.select("host", F.explode(_suffixes(F.col("host"))).alias("domain")).join(table, "domain")
    rule = F.concat("domain", "prefix")
    return fits.groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct(F.length(rule).alias("length"), rule.alias("rule"), "prefix", "verdict")), False).alias("rules")
    )


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts; ``pages`` has host and html."""
    linked = pages.where(F.col("host") != "").select(
        F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst")
    ).select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("dst != ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    known = pages.select("host").where("host != ''").union(linked.select("dst")).distinct()
    domains = F.filter(_suffixes(F.col("host")), lambda d: F.size(F.split(d, r"\.", -1)) >= 2)
    kin = known.select(F.explode(F.arrays_zip(F.slice(domains, 1, F.greatest(F.size(domains) - 1, F.lit(0))).alias("a"), F.slice(domains, 2, F.greatest(F.size(domains), F.lit(1))).alias("b"))).alias("k"))
    kin = kin.select(F.col("k.a").alias("src"), F.col("k.b").alias("dst")).where("dst IS NOT NULL").distinct()
    kin = kin.union(kin.select("dst", "src")).withColumn("n", F.lit(1).cast("long"))
    return linked.unionByName(kin).where("src != dst").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, rounds: int | None = ROUNDS) -> DataFrame:
    """(kind, host, score): trust along ``links`` and distrust against them, from ``seeds`` (kind, host, share).

    After ``rounds`` rounds, or, if that is None, when the scores have settled. Scores only
    rise, and a host that is first reached counts as a rise, so all that links lead to is reached.
    """
    both = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    )
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    edges = written(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("part")), "edges")
    start = written(seeds.select("kind", "host", (F.col("share") * (1 - DAMPING)).alias("score")), "seeds")
    if start.isEmpty():
        return start
    state = before = start
    turn = 0
    while turn != rounds:
        turn += 1
        moved = state.join(edges, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("score") * F.col("part") * DAMPING).alias("score"))
        state = start.unionByName(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if turn % CUT_EVERY == 0:
            state = written(state, "scores")
            if rounds is None and not _rises(state, before):
                break
            before = state
    return state


def _rises(state: DataFrame, before: DataFrame) -> bool:
    """Whether a score of ``state`` is more than that of ``before``, by more than settled ones are."""
    old = before.withColumnRenamed("score", "old")
    return not state.join(old, ["kind", "host"], "left").where(F.col("score") - F.coalesce("old", F.lit(0.0)) > SETTLED * F.col("score")).isEmpty()


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``.

    ``rules`` is a list of the caller, of which equal lengths go by text. A URL that is null
    or has no ``://`` has an empty host and path, no rule and no score, and is allowed. Null
    HTML has no links. Repeated rows give repeated results, and weigh as often in the seeds
    and links. Other columns are not read.
    """
    pages = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    fits = rules_of_hosts(pages.select("host").where("host != ''").distinct(), rules)
    first = F.try_element_at(F.filter("rules", lambda r: F.startswith(F.col("path"), r["prefix"])), F.lit(1))
    ruled = pages.drop("html").join(fits, "host", "left").select("page_id", "host", "path", first.alias("first"))
    ruled = written(ruled.select("page_id", "host", "path", F.col("first.rule").alias("rule"), F.col("first.verdict").alias("said")), "ruled")
    seeds = ruled.where("said IS NOT NULL").groupBy(
        F.when(F.col("said") == "allow", "trust").otherwise("distrust").alias("kind"), "host"
    ).agg(F.count("*").alias("n"))
    total = seeds.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = seeds.join(total, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("share"))
    scores = propagate(host_links(pages), seeds, None).groupBy("host").agg(
        *(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust"))
    )
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("distrust") - F.col("trust") > TIE * F.greatest("distrust", "trust"), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
