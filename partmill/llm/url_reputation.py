"""URL filter: fixed host/path rules first, else the reputation of the host.

Reputation is empirical Bayes. Labelled page outcomes are counted per host, and every rate is
shrunk towards the level above through a beta-binomial prior: host to registered domain to suffix
to all pages. The strength of each prior is the moment estimate of how much the children of that
level differ. A host is blocked when the lower posterior bound of its bad rate exceeds `max_bad`.

Defined cases: a null url or one without `://` has empty host and path and no rule; the empty host
is a host like any other. Rows whose outcome is null are not counted. Repeated pages count, and are
judged, once per row. Without any outcome all hosts share the weak prior at the top and are allowed.
Other columns of the inputs are ignored.

Scale: one pass over the urls for the outcomes and one for the verdict; the host table is
pre-aggregated before it is shuffled, and a hot host is only a hot key of the last join, which
adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (action, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Public suffixes of two labels; all other suffixes are the last label.
WIDE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp",
                 "or.jp", "com.br", "com.cn", "com.mx", "com.tr", "co.in", "co.kr", "co.za", "com.ar", "com.tw")


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, wide: Sequence[str] = WIDE_SUFFIXES) -> Column:
    """Public suffix; numeric and bracketed addresses have none."""
    two = F.regexp_extract(host, r"([^.]+\.[^.]*)$", 1)
    return (F.when(host.rlike(r"^[0-9.]*$|:"), F.lit("")).when(two.isin(*wide), two)
            .otherwise(F.regexp_extract(host, "([^.]*)$", 1)))


def domain_of(host: Column, wide: Sequence[str] = WIDE_SUFFIXES) -> Column:
    """Registered domain: the suffix and one label more; the host itself where there is none."""
    two = F.regexp_extract(host, r"([^.]+\.[^.]*)$", 1)
    three = F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]*)$", 1)
    pick = F.when(two.isin(*wide), three).otherwise(two)
    return F.when(host.rlike(r"^[0-9.]*$|:") | (pick == ""), host).otherwise(pick)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, action) of the longest rule that fits, else null."""
    out = None
    for action, rule_host, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        value = F.struct(F.lit(rule_host + prefix).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


def _with_prior(children: DataFrame) -> DataFrame:
    """Prior mean `m` and strength `k` of children (n, y) from parents (pn, py, pm, pk).

    The parent's evidence is taken without the child's own, so nothing counts twice. The strength is
    the beta-binomial moment estimate over all children of the level (how little they differ from
    their parents), but never more than the evidence that the parent has.
    """
    rest_n, rest_y = F.col("pn") - F.col("n") + F.col("pk"), F.col("py") - F.col("y") + F.col("pk") * F.col("pm")
    children = children.withColumn("m", rest_y / rest_n).withColumn("most", rest_n)
    gap = F.col("n") * F.pow(F.col("y") / F.col("n") - F.col("m"), 2) / (F.col("m") * (1 - F.col("m")))
    rho = (F.sum(gap) - F.count(F.lit(1))) / F.nullif(F.sum(F.col("n") - 1), F.lit(0))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.9), F.coalesce(rho, F.lit(0.05))))
    strength = children.where("n > 0").agg((1 / rho - 1).alias("level_k"))  # one row: joins as a scalar
    return children.join(F.broadcast(strength), F.lit(True)).withColumn("k", F.least("level_k", "most")).drop("level_k", "most")


def _as_parent(level: DataFrame, key: str) -> DataFrame:
    return level.select(key, F.col("n").alias("pn"), F.col("y").alias("py"), F.col("m").alias("pm"), F.col("k").alias("pk"))


def host_reputation(urls: DataFrame, outcomes: DataFrame, z: float = 1.645,
                    wide: Sequence[str] = WIDE_SUFFIXES) -> DataFrame:
    """One row per host of `urls` (host) and of the outcomes: n, y (bad outcomes), posterior mean, lower and upper bound.

    `outcomes` has one row (host, bad) for each labelled page. Above the suffixes stands a weak
    prior of five pages, half a page of them bad.
    """
    counts = outcomes.where("bad is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("y"))
    # Hosts of the outcomes count for their domains and suffixes even where no url names them.
    named = urls.select("host").unionByName(outcomes.select("host")).distinct()
    hosts = named.join(counts, "host", "left").select(
        "host", domain_of(F.col("host"), wide).alias("domain"), suffix_of(F.col("host"), wide).alias("suffix"),
        F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("y", F.lit(0)).alias("y"))
    summed = (F.sum("n").alias("n"), F.sum("y").alias("y"))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pn"), F.coalesce(F.sum("y"), F.lit(0)).alias("py"))
    total = total.select("pn", "py", F.lit(0.1).alias("pm"), F.lit(5.0).alias("pk"))
    suffixes = _with_prior(hosts.groupBy("suffix").agg(*summed).join(F.broadcast(total), F.lit(True)))
    domains = _with_prior(hosts.groupBy("domain", "suffix").agg(*summed).join(_as_parent(suffixes, "suffix"), "suffix"))
    leaves = _with_prior(hosts.join(_as_parent(domains, "domain"), "domain"))
    a, b = F.col("y") + F.col("k") * F.col("m"), F.col("n") - F.col("y") + F.col("k") * (1 - F.col("m"))
    spread = F.lit(z) * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
    return leaves.withColumn("mean", a / (a + b)).select(
        "host", "n", "y", "mean", (F.col("mean") - spread).alias("lower"), (F.col("mean") + spread).alias("upper"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
                max_bad: float = 0.25, z: float = 1.645, wide: Sequence[str] = WIDE_SUFFIXES,
                id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict for every page: id, host, path, rule, verdict, n_outcomes, n_bad."""
    judged = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rated = host_reputation(judged, outcomes, z, wide).select(
        "host", F.col("n").alias("n_outcomes"), F.col("y").alias("n_bad"), (F.col("lower") > max_bad).alias("bad_host"))
    best = longest_rule(F.col("host"), F.col("path"), rules)
    return judged.join(rated, "host").withColumn("fit", best).select(
        id_col, "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.action"), F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"),
        "n_outcomes", "n_bad")


def outcomes_by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome of a page: the label of the document whose number opens its path's file name.

    A document is bad when any of its label rows says low quality or toxic.
    """
    number = F.regexp_extract("path", "/([0-9]{1,18})(?:[^0-9]|$)", 1)
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select(
        "host", F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id is not null")
    judged = labels.groupBy("doc_id").agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1)
              .when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad"))
    return seen.join(judged, "doc_id").select("host", "bad")
