"""URL verdicts: host rules first, then the reputation of the host by empirical Bayes.

A rule decides the urls it fits. The decided pages are the labelled outcomes: a blocked page is a bad
one. Every other page is judged by its host's rate of bad pages. The rate has a beta prior whose mean
is the shrunk rate of the registered domain, which in turn is shrunk to the public suffix and that to
the rate of all labelled pages. The weight of each prior (a number of pseudo pages) is the moment
estimate over all hosts, domains or suffixes with two labelled pages or more, each counted once, so
that one busy host does not set it. A page is blocked when the lower bound of the posterior rate is
at least ``LIMIT``.

Only column expressions are used. Pages are summed per host before any shuffle; the levels above
are sums of the host table, and only blocked hosts are joined back to the pages (adaptive execution
broadcasts a small list and splits a busy host of a long one).

Defined results: a null url or one without ``://`` has an empty host and path, which no rule fits;
its pages share the reputation of the empty host, which has no labels. Repeated rows are judged row by
row and count row by row. An empty table gives an empty result. A user name and a port belong to the
host as given, but not to the name that domain and suffix are taken from. A numeric address is its
own domain under an empty suffix. Very long urls are read whole. Other columns are not used, whatever
their names; null page ids stay null.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmeter.llm.expressions import let, table
from sparkmeter.llm.registry import query
from sparkmeter.session import settle

#: A host is blocked when at least this share of bad pages is credible.
LIMIT = 0.5
#: Standard deviations between the posterior mean and its lower bound (95 % of a normal).
DEVIATIONS = 1.6449
#: Bounds of a prior's weight in pages; the upper one holds where children do not differ at all.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1000.0
#: Rates are summed in whole billionths, so that sums do not depend on the order of rows.
SCALE = 1_000_000_000

# Public suffixes of two labels (a parameter; any longer list can be given).
SUFFIXES = (
    "co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp co.kr com.br com.cn "
    "com.tw com.hk com.sg com.mx com.ar com.tr co.za co.in co.il com.ua com.pl"
).split()


@dataclass(frozen=True)
class Rule:
    """``verdict`` for the host and its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the query.
RULES = [
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def split_url(url: Column) -> Column:
    """Struct of host (A to Z lowered) and path; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + F.lit(3)))

    def parts(r: Column) -> Column:
        host = F.regexp_extract(r, r"^[^/?#]*", 0)
        path = F.regexp_extract(F.substr(r, F.length(host) + F.lit(1)), r"^[^?#]*", 0)
        lowered = F.translate(host, string.ascii_uppercase, string.ascii_lowercase)
        return F.struct(lowered.alias("host"), path.alias("path"))

    return let(F.coalesce(rest, F.lit("")), parts)


def longest_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Struct of name and verdict of the longest rule that fits, else null.

    One branch per rule, for lists of some hundreds; of equally long rules the first in order of
    their names wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        own = (host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))
        fits = own & F.startswith(path, F.lit(rule.path))
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Struct of registered domain and public suffix of a host."""
    bare = F.regexp_replace(host, r"^.*@", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r":[0-9]*$", ""), r"\.+$", "")

    def named(x: Column) -> Column:
        labels = F.split(x, r"\.")
        two = F.array_join(F.slice(labels, -2, 2), ".")
        double = (F.size(labels) > 1) & two.isin(list(suffixes))
        suffix = F.when(double, two).otherwise(F.element_at(labels, -1))
        take = F.when(double, 3).otherwise(2)
        domain = F.when(F.size(labels) <= take, x).otherwise(
            F.array_join(F.slice(labels, F.negative(take), take), ".")
        )
        numeric = x.rlike(r"^[0-9.]+$")
        return F.struct(
            F.when(numeric, x).otherwise(domain).alias("domain"),
            F.when(numeric, F.lit("")).otherwise(suffix).alias("suffix"),
        )

    return let(bare, named)


def _spread(groups: DataFrame) -> DataFrame:
    """Sums behind the moments of the rates of groups with two labelled pages or more."""
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    pairs = bad * (bad - 1.0) / (n * (n - 1.0))
    rate = lambda x: F.floor(x * F.lit(float(SCALE))).cast("bigint")
    return groups.filter("n > 1").agg(
        F.count("*").alias("groups"),
        F.sum(rate(bad / n)).alias("once"),
        F.sum(rate(pairs)).alias("twice"),
    )


def prior_weight(groups: int, once: int | None, twice: int | None) -> float:
    """Pseudo pages of a beta prior from the mean rate and the mean of products of two outcomes."""
    if not groups:
        return MOST_WEIGHT
    mean = float(once) / (float(groups) * float(SCALE))
    both = float(twice) / (float(groups) * float(SCALE))
    if both <= mean * mean:
        return MOST_WEIGHT
    return min(MOST_WEIGHT, max(LEAST_WEIGHT, (mean - both) / (both - mean * mean)))


def _shrunk(prior: Column, weight: float) -> Column:
    return (F.col("bad").cast("double") + prior * F.lit(weight)) / (
        F.col("n").cast("double") + F.lit(weight)
    )


def reputations(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Posterior of each host of ``outcomes`` (host, bad: 0, 1, or null where not labelled).

    Returns host, domain, suffix, n, bad, mean and bound (the lower bound of the rate of bad pages).
    """
    per_host = outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("bigint").alias("bad")
    )
    named = per_host.withColumn("_of", levels(F.col("host"), suffixes))
    hosts = settle(named.select("host", "_of.domain", "_of.suffix", "n", "bad"), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    tops = hosts.groupBy("suffix").agg(*sums)
    # One row each: totals and moments.
    total = hosts.agg(*sums).first()
    of_host, of_domain, of_top = (
        prior_weight(*_spread(groups).first()) for groups in (hosts, domains, tops)
    )
    overall = float(total["bad"]) / float(total["n"]) if total["n"] else 0.0

    top_rates = tops.select("suffix", _shrunk(F.lit(overall), of_top).alias("top"))
    domain_rates = domains.join(top_rates, "suffix").select(
        "domain", "suffix", _shrunk(F.col("top"), of_domain).alias("prior")
    )
    a = F.col("bad").cast("double") + F.col("prior") * F.lit(of_host)
    b = (F.col("n") - F.col("bad")).cast("double") + (F.lit(1.0) - F.col("prior")) * F.lit(of_host)
    posterior = hosts.join(domain_rates, ["domain", "suffix"]).withColumns({"a": a, "b": b})
    whole = F.col("a") + F.col("b")
    spread = F.sqrt(F.col("a") * F.col("b") / (whole * whole * (whole + F.lit(1.0))))
    mean = F.col("a") / whole
    return posterior.select(
        "host", "domain", "suffix", "n", "bad", mean.alias("mean"),
        (mean - F.lit(DEVIATIONS) * spread).alias("bound"),
    )


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    suffixes: Sequence[str] = SUFFIXES,
    id_col: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) of every page; the pages that rules decide are the labels."""
    parts = pages.select(F.col(id_col), split_url(F.col(url)).alias("_url"))
    found = parts.select(
        id_col,
        "_url.host",
        "_url.path",
        longest_rule(F.col("_url.host"), F.col("_url.path"), rules).alias("_rule"),
    )
    bad = F.when(F.col("_rule").isNotNull(), (F.col("_rule.verdict") == "block").cast("int"))
    known = reputations(found.select("host", bad.alias("bad")), suffixes)
    blocked = known.filter(F.col("bound") >= LIMIT).select("host", F.lit("block").alias("_own"))
    return found.join(blocked, "host", "left").select(
        id_col,
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", "_own", F.lit("allow")).alias("verdict"),
    )


def _fits(rule: Rule) -> str:
    own = f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}'))"
    return f"{own} AND starts_with(path, '{rule.path}')"


_ORDERED = sorted(RULES, key=lambda r: (-len(r.name), r.name))
_RULE = " ".join(f"WHEN {_fits(r)} THEN '{r.name}'" for r in _ORDERED)
_BLOCKED = ", ".join(f"'{r.name}'" for r in RULES if r.verdict == "block")


def _weight(groups: str) -> str:
    rate = "CAST(floor({} * CAST(1000000000 AS DOUBLE)) AS BIGINT)"
    n, bad = "CAST(n AS DOUBLE)", "CAST(bad AS DOUBLE)"
    once = rate.format(f"({bad} / {n})")
    twice = rate.format(f"({bad} * ({bad} - 1) / ({n} * ({n} - 1)))")
    return f"""(SELECT CASE WHEN g = 0 OR b2 <= m * m THEN CAST({MOST_WEIGHT} AS DOUBLE)
   ELSE least(CAST({MOST_WEIGHT} AS DOUBLE), greatest(CAST({LEAST_WEIGHT} AS DOUBLE), (m - b2) / (b2 - m * m))) END
  FROM (SELECT g, CAST(o AS DOUBLE) / (CAST(g AS DOUBLE) * CAST(1000000000 AS DOUBLE)) AS m,
               CAST(t AS DOUBLE) / (CAST(g AS DOUBLE) * CAST(1000000000 AS DOUBLE)) AS b2
        FROM (SELECT count(*) AS g, sum({once}) AS o, sum({twice}) AS t FROM {groups} WHERE n > 1)))"""


_TWO = ", ".join(f"'{s}'" for s in SUFFIXES)
JUDGED_SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
           FROM pages),
v AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw, r FROM u),
p AS (SELECT page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
             regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM v),
q AS (SELECT *, CASE {_RULE} END AS rule FROM p),
h0 AS (SELECT host, count(rule) AS n,
              CAST(coalesce(sum(CASE WHEN rule IN ({_BLOCKED}) THEN 1 WHEN rule IS NOT NULL THEN 0 END), 0) AS BIGINT) AS bad
       FROM q GROUP BY host),
h1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS x FROM h0),
h2 AS (SELECT *, string_split(x, '.') AS l FROM h1),
h3 AS (SELECT *, len(l) > 1 AND array_to_string(l[-2:], '.') IN ({_TWO}) AS two FROM h2),
h AS (SELECT host, n, bad,
   CASE WHEN regexp_matches(x, '^[0-9.]+$') THEN x WHEN two THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
   CASE WHEN regexp_matches(x, '^[0-9.]+$') THEN '' WHEN two THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM h3),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
k AS (SELECT {_weight("h")} AS kh, {_weight("d")} AS kd, {_weight("s")} AS ks,
   (SELECT CASE WHEN sum(n) > 0 THEN CAST(sum(bad) AS DOUBLE) / CAST(sum(n) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END FROM h) AS m),
s2 AS (SELECT suffix, (CAST(bad AS DOUBLE) + m * ks) / (CAST(n AS DOUBLE) + ks) AS top FROM s CROSS JOIN k),
d2 AS (SELECT domain, suffix, (CAST(bad AS DOUBLE) + top * kd) / (CAST(n AS DOUBLE) + kd) AS prior
       FROM d JOIN s2 USING (suffix) CROSS JOIN k),
ab AS (SELECT host, CAST(bad AS DOUBLE) + prior * kh AS a, CAST(n - bad AS DOUBLE) + (CAST(1 AS DOUBLE) - prior) * kh AS b
       FROM h JOIN d2 USING (domain, suffix) CROSS JOIN k),
x AS (SELECT host, a / (a + b) - CAST({DEVIATIONS} AS DOUBLE) * sqrt(a * b / ((a + b) * (a + b) * ((a + b) + CAST(1 AS DOUBLE)))) AS bound FROM ab)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({_BLOCKED}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN bound >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM q LEFT JOIN x USING (host)
"""


@query("op11_host_reputation", JUDGED_SQL)
def op11_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))
