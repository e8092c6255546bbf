"""Secret scan over a trigram inverted index.

Every rule is a regular expression. From its parse a Boolean query over trigrams is derived: the
alternatives of the rule, each a set of trigrams that every match must contain (letters folded to
lower case). The index holds, for all trigrams of all rules, the documents in which each occurs;
a rule's candidates are the documents in the postings of all trigrams of some alternative. Only
candidates are verified with the expression itself. A rule without mandatory trigrams is run over
every document.

A rule may keep only those matches whose length, or whose last group's length, reaches a minimum:
matches are found leftmost and without overlap first, then the short ones are dropped.

Defined cases: null text is empty and has no spans. Rows that repeat an id are scanned each by its
own text. Positions count code points, the end is exclusive. Other columns are ignored.

Scale: postings hold ids only and only of the rules' trigrams; the text is shuffled once, to meet
its candidate rules. The list of rules and their trigrams are parameters, and small.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _parser as grammar  # the standard library's own parse of a regular expression

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import materialize
from .common import same


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0
    group: int = 0  # the group that `least` measures


# The three rules of the contract, in the contract's order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
# Public token formats that the base rules do not name.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[0-9A-Za-z_-]+", 39),
    Rule("stripe", r"sk_live_[0-9a-zA-Z]+", 32),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
)
MAX_STRINGS = 32  # an expression with more spellings than this counts as unknown text


def _joined(left: set[str], right: set[str]) -> set[str]:
    return {a + b for a, b in product(left, right)}


def _tri(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, of which a matching text satisfies one: sets of trigrams it must contain.

    The empty set among them means that some match needs no trigram.
    """
    def spellings(item) -> set[str] | None:
        """All texts one item can match, or None if there are too many."""
        op, arg = item
        name = str(op)
        if name == "LITERAL":
            return {chr(arg).lower()}
        if name == "IN":
            out = set()
            for kind, value in arg:
                if str(kind) == "LITERAL":
                    out.add(chr(value).lower())
                elif str(kind) == "RANGE" and value[1] - value[0] < MAX_STRINGS:
                    out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
                else:
                    return None
            return out if len(out) <= 8 else None
        if name == "SUBPATTERN":
            return listing(arg[-1])
        if name == "BRANCH":
            parts = [listing(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if name == "MAX_REPEAT" and arg[1] != grammar.MAXREPEAT and arg[1] <= 2:
            one = listing(arg[2])
            if one is None:
                return None
            out, grown = ({""} if arg[0] == 0 else set()), {""}
            for n in range(1, arg[1] + 1):
                grown = _joined(grown, one)
                out |= grown if n >= arg[0] else set()
            return out
        return None

    def listing(sequence) -> set[str] | None:
        out = {""}
        for item in sequence:
            more = spellings(item)
            if more is None or len(out) * len(more) > MAX_STRINGS:
                return None
            out = _joined(out, more)
        return out

    alternatives: set[frozenset[str]] = {frozenset()}
    run = {""}

    def close() -> None:
        nonlocal alternatives, run
        alternatives = {a | _tri(text) for a, text in product(alternatives, run)}
        run = {""}

    def walk(sequence) -> None:
        nonlocal run
        for item in sequence:
            more = spellings(item)
            if more is not None and len(run) * len(more) <= MAX_STRINGS:
                run = _joined(run, more)
                continue
            close()
            if str(item[0]) == "SUBPATTERN":
                walk(item[1][-1])
                close()
            elif more is not None:
                run = more
    walk(grammar.parse(pattern))
    close()
    minimal = [a for a in alternatives if not any(b < a for b in alternatives)]
    return sorted(minimal, key=sorted)


def postings(docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index: (trigram, id), sorted by trigram within each file, written once."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    low = F.array(F.lower(F.coalesce(F.col(text_col), F.lit(""))))  # evaluated once a row, not once a trigram
    found = F.transform(low, lambda text: F.filter(wanted, lambda t: F.contains(text, t)))[0]
    return materialize(docs.select(F.col(id_col).alias("id"), F.explode(found).alias("trigram")).sortWithinPartitions("trigram"), "postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(id, rules): the kinds whose Boolean query the postings satisfy, per id."""
    terms = [(rule.kind, n, len(need), t) for rule in rules for n, need in enumerate(trigram_query(rule.pattern)) for t in need]
    spark = index.sparkSession
    query = F.broadcast(spark.createDataFrame(terms, "kind string, clause int, need int, trigram string"))
    met = index.join(query, "trigram").groupBy("id", "kind", "clause", "need").agg(F.size(F.collect_set("trigram")).alias("have"))
    return met.where("have = need").groupBy("id").agg(F.collect_set("kind").alias("rules"))


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of a rule's matches in a text."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else hits
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(gaps, F.arrays_zip(hits.alias("hit"), measured.alias("measured")), lambda gap, m: F.struct(
        F.char_length(gap).alias("gap"), F.char_length(m["hit"]).alias("length"), F.char_length(m["measured"]).alias("size")))
    empty = F.expr("array()").cast("array<struct<start:int,ord:int,end:int>>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("found"))

    def add(acc, step):
        start = acc["at"] + step["gap"]
        end = start + F.coalesce(step["length"], F.lit(0))
        one = F.when(step["size"] >= rule.least, F.array(F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end")))).otherwise(empty)
        return F.struct(end.alias("at"), F.concat(acc["found"], one).alias("found"))
    return F.aggregate(steps, begin, add, lambda acc: acc["found"])


def _quick(rule: Rule) -> str:
    """A cheaper expression that finds the same spans: a bare class needs its minimum at once."""
    return re.sub(r"\+$", f"{{{rule.least},}}", rule.pattern) if re.fullmatch(r"\[[^]]+\]\+", rule.pattern) else rule.pattern


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, spans): for every row the array of (start, ord, end), sorted; ord is the rule's place in `rules`."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    scanned = {kind for kind, q in queries.items() if frozenset() in q}
    indexed = tuple(r for r in rules if r.kind not in scanned)
    grams = sorted({t for r in indexed for need in queries[r.kind] for t in need})
    data = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if indexed:
        few = candidates(postings(data, grams, "id"), indexed)
        data = data.join(few, same(data, few, "id"), "left").select(data["id"], "text", "rules")
    else:
        data = data.withColumn("rules", F.lit(None).cast("array<string>"))
    none = F.expr("array()").cast("array<struct<start:int,ord:int,end:int>>")
    parts = []
    for order, rule in enumerate(rules):
        fast = Rule(rule.kind, _quick(rule), rule.least, rule.group)
        check = F.col("text").rlike(fast.pattern) if rule.kind in scanned else F.array_contains("rules", rule.kind)
        parts.append(F.when(check, _spans(F.col("text"), fast, order)).otherwise(none))
    return data.select(F.col("id").alias(id_col), F.array_sort(F.concat(*parts)).alias("spans"))


def span_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_<kind> of each base rule, base_sha256, spans."""
    rules = base + more
    found = scan(docs, rules, id_col, text_col)
    basic = F.filter("spans", lambda s: s["ord"] < len(base))
    counts = [F.size(F.expr(f"filter(spans, s -> s.ord = {n})")).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(base)]
    return found.select(id_col, *counts, F.sha2(span_text(basic, rules), 256).alias("base_sha256"), span_text(F.col("spans"), rules).alias("spans"))
