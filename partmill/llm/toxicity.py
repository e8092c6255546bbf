"""Toxicity by weak supervision.

Voters look at a text and fire or stay silent. Some are lexicons of insults by language and theme,
some are patterns (shouting, disguised words, direct address with an insult), and some are
lexicons mined from a bounded sample of labelled rows: words and repeated word beginnings that occur almost only in toxic texts, dealt to several voters.

A text is judged by its passages, runs of `SPAN` words that overlap, so that what stands around an insult neither hides
nor adds to it: its votes are those of the passage where most voters fire, its score is that of its worst passage.

A generative label model with two classes explains all votes of all documents: per voter the
chance to fire in either class, per class the correlations of voters. It is fitted by expectation
maximisation over the counts of vote patterns, which Spark gathers from every document; only sums
per voter and pair of voters reach the driver. Voters that move together within a class share
their weight, so that ten copies of one voter do not count ten times.

The model's posterior labels train a linear classifier on words and word beginnings (logistic,
stochastic gradient descent) over a bounded sample of documents: first on whole texts, then on the worst passage
of each toxic text and on every passage of the others. That classifier scores all passages of all texts.

Defined cases: null text is empty; a text without words gets the score of the bias. Documents
labelled both ways are not learned from. Without labels the voters start from fixed rates. Held
out rows are in no sample; labels, language, source and id are never inputs of a score. Other
columns are ignored.

Scale: two passes over the documents, no shuffle of texts. The bounds of the samples are
parameters (`per_class` for labelled rows, `per_side` for posterior labels).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import materialize
from .common import held_out
from .subword_quality import MAX_CHARS, training_rows, whole_texts_within

# Everyday insults, by language and theme; general vocabulary, not taken from the data.
LEXICONS = {
    "en_mind": "idiot idiots idiotic stupid moron morons moronic dumb dumbass imbecile fool foolish brainless halfwit dimwit retard retarded",
    "en_worth": "worthless loser losers pathetic useless failure nobody trash garbage scum scumbag filth vermin parasite lowlife",
    "en_disgust": "disgusting gross vile nasty repulsive revolting disgrace disgraceful sickening hideous ugly",
    "en_ridicule": "clown clowns joke laughable ridiculous crybaby coward cowards liar liars hypocrite creep freak weirdo",
    "en_curse": "damn damned crap bastard bitch asshole ass shit bullshit fuck fucking fucker dick prick jerk whore slut",
    "en_threat": "kill murder hate hang burn destroy beat smash choke",
    "fr": "idiot idiote imbécile stupide crétin débile abruti ordure salaud salope connard connasse con conne merde pourri raté nul minable",
    "de": "idiot dumm dummkopf blöd trottel depp arschloch scheiße mist versager abschaum dreck schwachkopf widerlich wertlos hure",
    "es": "idiota estúpido estúpida imbécil tonto tonta basura escoria mierda cabrón puta asqueroso asquerosa inútil perdedor payaso",
}
PATTERNS = {
    "shouting": r"(?:\b[A-ZÀ-Þ]{4,}\b[^\w\n]+){2}[A-ZÀ-Þ]{4,}\b",
    "exclaiming": r"!{2,}|[!?]{3,}",
    "disguised": r"\b[a-z]{1,3}[*@#$]{1,4}[a-z]{1,4}\b",
    "address": r"\b(?:[Yy]ou(?: are|'re)|[Dd]u bist|[Tt]u es|[Ee]res)\s+(?:such |so |all |just |nothing |ein |une? |an? |el |la )",
}
MARKS = ("", "!?", "*@#$", "")  # a text without any of these characters needs no search for the pattern
MINED = 12            # voters that share the mined entries
HEADS = (4, 5, 6, 7)  # lengths of word beginnings
SPAN, STEP = 240, 160  # words of a passage, and from the start of one to the next
_WORD = re.compile(r"[^\W\d_]+")


def passages(text: str) -> list[str]:
    """Runs of `SPAN` words that start every `STEP` words and together cover the text; a shorter text is one."""
    if len(text) < 2 * SPAN:  # words have a gap between them
        return [text]
    starts = [w.start() for w in _WORD.finditer(text)]
    more = max(0, -(-(len(starts) - SPAN) // STEP))
    edges = [0, *starts[STEP:more * STEP + 1:STEP]]
    return [text[a:starts[k * STEP + SPAN] if k < more else len(text)] for k, a in enumerate(edges)]


def words_of(text: str) -> list[str]:
    return " ".join(_WORD.findall(text)).lower().split()


def runs(words: list[str]) -> list[list[str]]:
    """The words of each of the text's passages."""
    return [words[a:a + SPAN] for a in range(0, max(1, len(words) - SPAN + STEP), STEP)]


def roots(vocabulary: Iterable[str]) -> set[str]:
    """Shortest beginnings of the word beginnings among some terms."""
    return {t[:HEADS[0]] for t in vocabulary if t.endswith("+")}


def terms(words: list[str], only: set[str] | None = None) -> set[str]:
    """Distinct words of a passage, and the word beginnings that at least two of its words have, marked by a plus.
    With `only`, beginnings are looked for under these roots alone."""
    out = set(words)
    if only is not None:
        words = [w for w in words if w[:HEADS[0]] in only]
    for n in HEADS:  # a repeated beginning has repeated beginnings itself
        heads = Counter([w[:n] for w in words if len(w) > n])
        repeated = {h for h, c in heads.items() if c > 1}
        if not repeated:
            break
        out.update([h + "+" for h in repeated])
        words = [w for w in words if w[:n] in repeated]
    return out


def all_terms(text: str) -> set[str]:
    return set().union(*map(terms, runs(words_of(text))))


@dataclass(frozen=True)
class Voters:
    lexicons: tuple[frozenset[str], ...]
    patterns: tuple[re.Pattern, ...]

    def __len__(self) -> int:
        return len(self.lexicons) + len(self.patterns)

    @cached_property
    def entries(self) -> frozenset[str]:
        return frozenset().union(*self.lexicons)

    @cached_property
    def roots(self) -> set[str]:
        return roots(self.entries)

    def votes(self, text: str) -> int:
        """Bit j is set where voter j fires, in the first passage of those with most votes."""
        seen = [self._lexicon_votes(words) for words in runs(words_of(text))]
        for j, (pattern, marks) in enumerate(zip(self.patterns, MARKS), len(self.lexicons)):
            if (not marks or any(c in text for c in marks)) and pattern.search(text):
                seen = [bits | bool(pattern.search(p)) << j for bits, p in zip(seen, passages(text))]
        return max(seen, key=int.bit_count)

    def _lexicon_votes(self, words: list[str]) -> int:
        found = terms(words, self.roots) & self.entries
        return sum(1 << j for j, lexicon in enumerate(self.lexicons) if not lexicon.isdisjoint(found)) if found else 0


def _counts(texts: list[str], labels: list[float]) -> tuple[Counter, Counter, float, float]:
    """Weighted document frequencies of all terms in either class."""
    toxic, clean, a, b = Counter(), Counter(), 0.0, 0.0
    for text, y in zip(texts, labels):
        found = all_terms(text)
        if y > 0.5:
            toxic.update(found)
            a += 1
        else:
            clean.update(found)
            b += 1
    return toxic, clean, a, b


def evidence(x: float, y: float, a: float, b: float) -> float:
    """Log likelihood ratio of a term seen in x of a toxic and y of b clean texts against one rate for
    both; negative where it leans to the clean class."""
    n, share = x + y, a / (a + b)
    ratio = (x * np.log(x / (n * share)) if x else 0.0) + (y * np.log(y / (n * (1 - share))) if y else 0.0)
    return float(ratio if x / a >= y / b else -ratio)


def make_voters(sample: list[tuple[str, int]], voters: int = MINED, least: float = 9.0, precision: float = 0.9) -> Voters:
    """Fixed voters and those mined from labelled texts: terms with enough evidence and precision."""
    toxic, clean, a, b = _counts([t for t, _ in sample], [y for _, y in sample])
    mined = []
    if a and b:
        for term, n in toxic.items():
            rate, other = n / a, clean.get(term, 0) / b
            if n >= 2 and rate >= precision * (rate + other) and evidence(n, clean.get(term, 0), a, b) >= least:
                mined.append((-n, term))
    mined.sort()
    heads, words = [t for _, t in mined if t.endswith("+")], [t for _, t in mined if not t.endswith("+")]
    few = voters // 3
    dealt = [frozenset(heads[j::few]) for j in range(few)] + [frozenset(words[j::voters - few]) for j in range(voters - few)]
    fixed = [frozenset(x.split()) for x in LEXICONS.values()]
    return Voters(tuple([*fixed, *(d for d in dealt if d)]), tuple(re.compile(p) for p in PATTERNS.values()))


@dataclass(frozen=True)
class LabelModel:
    prior: float
    fire: np.ndarray    # 2 x voters: chance to fire in the clean and in the toxic class
    weight: np.ndarray  # 2 x voters: share of a voter's silence and of its vote that counts, 1 without correlations

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        """Chance of the toxic class for each row of votes (rows x voters, 0 or 1)."""
        on = np.log(self.fire[1]) - np.log(self.fire[0])
        off = np.log(1 - self.fire[1]) - np.log(1 - self.fire[0])
        on, off = on * self.weight[1], off * self.weight[0]
        logit = np.log(self.prior) - np.log(1 - self.prior) + bits @ (on - off) + off.sum()
        return 1 / (1 + np.exp(-np.clip(logit, -60, 60)))


def unpack(patterns: np.ndarray, voters: int) -> np.ndarray:
    return ((patterns[:, None] >> np.arange(voters)) & 1).astype(np.float64)


def start(voters: Voters, sample: list[tuple[str, int]]) -> LabelModel:
    """Rates from the labelled sample, smoothed; fixed rates where there are no labels of both classes."""
    m = len(voters)
    labels = np.array([y for _, y in sample])
    fire = np.vstack((np.full(m, 0.02), np.full(m, 0.3)))
    if len(set(labels.tolist())) == 2:
        bits = unpack(np.array([voters.votes(t) for t, _ in sample], np.int64), m)
        for y in (0, 1):
            mine = bits[labels == y]
            fire[y] = (mine.sum(0) + 0.5 * (0.3 if y else 0.02)) / (len(mine) + 0.5)
    return LabelModel(0.1, np.clip(fire, 1e-4, 1 - 1e-4), np.ones((2, m)))


def _sums(counted: DataFrame, model: LabelModel, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Expected counts over all documents: per class, per voter, and per pair of voters."""
    m = model.fire.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + 2 * m + (2 * m * m if pairs else 0))
        for batch in batches:
            bits, n = unpack(batch["votes"].to_numpy(), m), batch["n"].to_numpy().astype(np.float64)
            p = model.posterior(bits)
            for y, share in ((0, n * (1 - p)), (1, n * p)):
                total[y] += share.sum()
                total[2 + y * m:2 + (y + 1) * m] += share @ bits
                if pairs:
                    at = 2 + 2 * m + y * m * m
                    total[at:at + m * m] += ((bits * share[:, None]).T @ bits).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "x"])
    rows = counted.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(2 + 2 * m + (2 * m * m if pairs else 0))
    for r in rows:
        total[r["i"]] = r["x"]
    both = total[2 + 2 * m:].reshape(2, m, m) if pairs else None
    return total[:2], total[2:2 + 2 * m].reshape(2, m), both


def _refit(model: LabelModel, first: LabelModel, classes: np.ndarray, fired: np.ndarray, trust: float = 1.0) -> LabelModel:
    """Maximisation. The first rates, from labels, stay in with the weight `trust` of all documents, so
    that a common habit which is not toxicity cannot take over the class."""
    fire = (fired + trust * classes[:, None] * first.fire) / np.maximum((1 + trust) * classes[:, None], 1e-9)
    prior = float(np.clip((classes[1] + 1) / (classes.sum() + 10), 1e-4, 0.5))
    return LabelModel(prior, np.clip(fire, 1e-4, 1 - 1e-4), model.weight)


def correlations(classes: np.ndarray, fired: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Correlation of every pair of voters within each class (2 x voters x voters)."""
    n = np.maximum(classes, 1.0)[:, None]
    p = fired / n
    joint = both / n[:, :, None]
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return (joint - p[:, :, None] * p[:, None, :]) / (spread[:, :, None] * spread[:, None, :])


def fit_label_model(counted: DataFrame, model: LabelModel, rounds: int = 3) -> LabelModel:
    """Expectation maximisation over counted vote patterns (votes, n); correlations once, in between."""
    first = model
    for _ in range(rounds):
        classes, fired, _none = _sums(counted, model, False)
        model = _refit(model, first, classes, fired)
    classes, fired, both = _sums(counted, model, True)
    linked = np.clip(correlations(classes, fired, both), 0, 1)
    for y in (0, 1):
        np.fill_diagonal(linked[y], 0)
    linked[linked < 0.1] = 0
    # Votes count double where voters err together in the clean class, silence where they miss together.
    model = LabelModel(model.prior, model.fire, np.vstack((1 / (1 + linked[1].sum(1)), 1 / (1 + linked[0].sum(1)))))
    classes, fired, _none = _sums(counted, model, False)
    return _refit(model, first, classes, fired)


@dataclass(frozen=True)
class Linear:
    weights: dict[str, float]
    bias: float

    @cached_property
    def roots(self) -> set[str]:
        return roots(self.weights)

    def score(self, text: str | None) -> float:
        weights = self.weights
        logit = self.bias + max(sum([weights[t] for t in weights.keys() & terms(p, self.roots)]) for p in runs(words_of(text or "")))
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def _descend(rows: list[np.ndarray], sure: np.ndarray, size: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias after stochastic gradient descent over rows of term numbers with posteriors `sure`; both classes weigh the same."""
    w, bias = np.zeros(size), 0.0
    rng = np.random.default_rng(seed)
    goal = (sure > 0.5).astype(np.float64)
    share = (goal.sum() + 0.5) / (len(goal) + 1)
    cost = np.where(goal > 0.5, 0.5 / share, 0.5 / (1 - share)) * np.maximum(0.2, np.abs(2 * sure - 1))
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        for i in rng.permutation(len(rows)):
            ids = rows[i]
            gap = (1 / (1 + np.exp(-np.clip(bias + w[ids].sum(), -40, 40))) - goal[i]) * cost[i]
            w[ids] -= step * (gap + 1e-3 * w[ids])
            bias -= step * 0.2 * gap
    return w, float(bias)


def train_linear(texts: list[str], posterior: list[float], most: int = 20_000, least: float = 9.0, epochs: int = 12, rate: float = 0.2, seed: int = 3) -> Linear:
    """Logistic regression on the terms that speak for the toxic class, against the posterior's
    label, each row with the weight of how sure the posterior is. Terms of clean texts have no part
    in it, so harmless words around an insult do not excuse it."""
    toxic, clean, a, b = _counts(texts, posterior)
    share = (a + 0.5) / (a + b + 1)
    if not a or not b:
        return Linear({}, float(np.log(share / (1 - share))) if a + b else 0.0)
    kept = []
    for term in set(toxic) | set(clean):
        g = evidence(toxic.get(term, 0), clean.get(term, 0), a, b)
        if g >= least:
            kept.append((-g, term))
    kept = [t for _, t in sorted(kept)[:most]]
    place, under = {t: i for i, t in enumerate(kept)}, roots(kept)
    parts = [[np.array(sorted(place[t] for t in place.keys() & terms(p, under)), np.int64) for p in runs(words_of(text))] for text in texts]
    sure = np.array(posterior)
    w, bias = _descend([np.unique(np.concatenate(ids)) for ids in parts], sure, len(kept), epochs, rate, seed)
    rows, whose = [], []
    for k, ids in enumerate(parts):
        chosen = [max(ids, key=lambda i: w[i].sum())] if sure[k] > 0.5 else ids
        rows += chosen
        whose += [k] * len(chosen)
    w, bias = _descend(rows, sure[whose], len(kept), epochs, rate, seed)
    return Linear({t: float(x) for t, x in zip(kept, w) if abs(x) > 1e-3}, bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 1500, per_side: int = 1500, max_chars: int = MAX_CHARS,
                 id_col: str = "doc_id", text_col: str = "text") -> Linear:
    """Voters, label model, and the classifier trained on its posterior labels."""
    sample = training_rows(docs, labels, "toxic", per_class, id_col, text_col, max_chars)
    voters = make_voters(sample)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [voters.votes(t.as_py()) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["k"], batch["learn"], pa.array(found, pa.int64())], ["k", "learn", "votes"])
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    k = F.xxhash64(id_col, text_col).alias("k")
    voted = materialize(docs.select(text, k, (~held_out(F.col(id_col))).alias("learn")).mapInArrow(vote, "k long, learn boolean, votes long"), "votes")
    counted = materialize(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), "vote-patterns")
    model = fit_label_model(counted, start(voters, sample))
    m = len(voters)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.posterior(unpack(batch["votes"].to_numpy(), m))
            yield pa.RecordBatch.from_arrays([batch["votes"], pa.array(p)], ["votes", "p"])
    judged = voted.where("learn").join(counted.select("votes").mapInArrow(judge, "votes long, p double"), "votes")
    chosen = None
    for side in (F.col("p") > 0.5, F.col("p") <= 0.5):
        part = judged.where(side).select("k", "p").dropDuplicates(["k"]).orderBy("k").limit(per_side)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most twice per_side keys: a broadcast of proven size.
    # Rows that repeat a key are equal: one of each, combined before the shuffle, so the bound holds for rows too.
    rows = docs.select(text, k).join(F.broadcast(chosen), "k").groupBy("k", "p").agg(F.min("text").alias("text"))
    rows = whole_texts_within(rows.withColumn("side", F.col("p") > 0.5), "side", "k", max_chars).collect()
    rows.sort(key=lambda r: r["k"])
    return train_linear([r["text"] for r in rows], [r["p"] for r in rows])


def toxicity(docs: DataFrame, labels: DataFrame, cut: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **options)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch["text"]], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["held_out"], pa.array(scores), pa.array((scores >= cut).astype(np.int32))],
                ["id", "held_out", "score", "predicted"])
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
