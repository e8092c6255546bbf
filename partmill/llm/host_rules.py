"""Quality rules whose failures are judged by host.

Every document is measured once and held against a few rules. Failures are counted per registered
domain, each rule's rate is shrunk towards the rate of all domains through a beta prior whose
strength is estimated from how much the domains differ, and a domain fails when the lower posterior
bound of one of its rates stands far above the common one. The verdict of a document's domain is
joined back to the document: it is kept when it passes the base rules and its domain does too.

Defined cases: null text has no words and fails the base rule of fewest words. A null host is a
domain of its own. Repeated rows count, and are judged, once per row. An empty table gives no rows.
A rule that no document fails blocks nobody. Other columns are ignored.

Runs of five words are compared by 64-bit hashes within one text; texts without a repeated hash,
most of them, are done at that; the others sort (hash, place).

Scale: one pass over the texts writes a narrow table of measures; counting combines before it
shuffles, so a hot host is one small key, and the verdicts are joined by broadcast only when their
size is proven.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import lookup, materialize
from .common import SPACE, WORD
from .url_reputation import domain_of

# Fixed values of the query contract.
SYMBOLS = "[#*$%&|<>]"
RUN, LEAST_WORDS, MOST_REPEATED = 5, 10, 20


def rule_failures() -> dict[str, Column]:
    """Whether a measured document fails each rule. The first two are the base rules; the others only speak about the host."""
    n = F.col("n_words")
    return {
        "few_words": n < LEAST_WORDS,
        "repeated_words": 100 * F.col("n_repeat_words") > MOST_REPEATED * n,
        "many_symbols": 10 * F.col("n_symbols") > n,
        "repeated_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 3 * n) | (F.col("word_chars") > 10 * n),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), text.alias("text"),
                       F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    run = ", ".join(f"words[i + {k}]" for k in range(RUN))
    rows = rows.select(
        "id", "host", F.size("words").cast("long").alias("n_words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD)).alias("lines"),
        F.expr(f"CASE WHEN size(words) < {RUN} THEN cast(array() AS array<bigint>) "
               f"ELSE transform(sequence(0, size(words) - {RUN}), i -> xxhash64({run})) END").alias("runs"))
    rows = rows.withColumn("n_lines", F.size("lines").cast("long")).withColumn(
        "n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # Only texts in which a run comes back go on: their runs in order of hash, then the places of equal neighbours.
    again = F.size(F.array_distinct("runs")) < F.size("runs")
    rows = rows.withColumn("placed", F.when(again, F.expr("sort_array(transform(runs, (h, i) -> struct(h, i)))")))
    rows = rows.withColumn("places", F.expr(
        "sort_array(transform(filter(placed, (x, i) -> coalesce(x.h = get(placed, i - 1).h, false) "
        "OR coalesce(x.h = get(placed, i + 1).h, false)), x -> x.i))"))
    covered = F.expr(f"aggregate(transform(places, (p, i) -> cast(least({RUN}, coalesce(get(places, i + 1) - p, {RUN})) AS bigint)), 0L, (a, x) -> a + x)")
    return rows.select("id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                       F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _strength(n: Column, y: Column, mean: float) -> Column:
    """How many documents the prior is worth: beta-binomial moment estimate over all domains."""
    gap = n * F.pow(y / n - mean, 2) / (mean * (1 - mean))
    rho = (F.sum(gap) - F.count(F.lit(1))) / F.nullif(F.sum(n - 1), F.lit(0))
    return 1 / F.greatest(F.lit(0.001), F.least(F.lit(0.9), F.coalesce(rho, F.lit(0.05)))) - 1


def judged_hosts(hosts: DataFrame, rules: list[str], excess: float = 2.0, least_rate: float = 0.1, z: float = 1.645) -> DataFrame:
    """(domain, host_failed) from counts (domain, n, and the failures of each rule).

    A rule fails a domain when the lower posterior bound of its rate is above `least_rate` and above
    `excess` times the rate of all documents.
    """
    total = hosts.agg(F.sum("n").alias("n"), *[F.sum(r).alias(r) for r in rules]).first()
    means = {r: total[r] / total["n"] for r in rules if total["n"] and 0 < total[r] < total["n"]}
    if not means:
        return hosts.select("domain", F.lit(False).alias("host_failed"))
    worth = hosts.agg(*[_strength(F.col("n"), F.col(r), m).alias(r) for r, m in means.items()]).first()
    failed = F.lit(False)
    for rule, mean in means.items():
        a, b = F.col(rule) + worth[rule] * mean, F.col("n") - F.col(rule) + worth[rule] * (1 - mean)
        lower = a / (a + b) - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))
        failed = failed | (lower > max(least_rate, excess * mean))
    return hosts.select("domain", failed.alias("host_failed"))


def host_rules(docs: DataFrame, rules: Mapping[str, Column] | None = None, excess: float = 2.0, least_rate: float = 0.1, z: float = 1.645,
               id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, measures, base_failed, kept, domain, host_failed and `failures` (names of the rules it fails).

    `rules` maps names to conditions over the measures; by default it is `rule_failures`.
    """
    fails = rules or rule_failures()
    rows = measured(docs, id_col, text_col, host_col)
    rows = rows.withColumn("domain", domain_of(F.col("host"))).withColumn("failures", F.array_compact(F.array(
        *[F.when(fail, F.lit(name)) for name, fail in fails.items()])))
    rows = materialize(rows, "measures")
    counts = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.when(F.array_contains("failures", name), 1)).alias(name) for name in fails])
    hosts = lookup(materialize(judged_hosts(materialize(counts, "host-counts"), list(fails), excess, least_rate, z), "host-verdicts"))
    base = rule_failures()
    out = rows.join(hosts, rows["domain"].eqNullSafe(hosts["domain"]), "left").drop(hosts["domain"])
    out = out.withColumn("base_failed", base["few_words"] | base["repeated_words"])
    return out.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "domain", "host_failed", "failures")


def documents_of_good_hosts(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with their columns; rows that repeat an id are judged together and go if one of them goes."""
    id_col = options.get("id_col", "doc_id")
    bad = host_rules(docs, **options).where(~F.col("kept")).select(F.col(id_col).alias("_bad")).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad"]), "left_anti")
