"""Plain Python versions of the operators, and the small inputs the tests share."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

WORD = r"[^\x20\x09-\x0D]+"
#: Extra columns whose names the operators use inside.
CLASHING = ["id", "k1", "k2", "h", "row", "key", "name", "size", "words", "words2", "component", "node", "plain", "bytes", "rules", "cell"]


def lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def substrings(rows, window):
    words = [re.findall(WORD, t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def near(rows, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(WORD, lower(t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        least = (min(ids) if ids else None) if sets[i] else doc
        out.append((doc, len(sets[i]), least, doc == least))
    return out


def exact(rows):
    plain = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for (doc, t), p in zip(rows, plain):
        groups.setdefault(p, []).append((-len(t or ""), doc is None, doc))
    out = []
    for (doc, t), p in zip(rows, plain):
        best = min(groups[p], key=lambda x: (x[0], x[1], x[2] or 0))
        out.append((doc, best[2], len(groups[p]), doc == best[2] and len(t or "") == -best[0], hashlib.sha256(p.encode()).hexdigest()))
    return out


def contaminated(rows, items, n):
    token = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    grams = {}
    for item, t in items:
        w = re.findall(token, lower(t or ""))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[i:i + n]), set()).add(str(item))
    out = []
    for doc, t in rows:
        w, hit, found = re.findall(token, lower(t or "")), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in grams:
                    hit.update(range(i, i + k))
                    found |= grams[tuple(w[i:i + k])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def corpus(seed=5, n=60, vocabulary=400, passages=6):
    """Texts with shared passages, near and exact copies, repeated words, nulls and empty texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(vocabulary)]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    shared = [say(rng.randint(12, 60)) for _ in range(passages)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if rows and kind < 0.15:
            text = rng.choice([t for _, t in rows if t] or ["a"])
        elif rows and kind < 0.5:
            w = re.findall(WORD, rng.choice([t for _, t in rows if t] or ["a b"]))
            for _ in range(rng.randint(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(words).upper()
            text = (" " if rng.random() < 0.5 else "\n ").join(w)
        elif kind < 0.6:
            text = " ".join([rng.choice(words)] * rng.randint(1, 80))
        else:
            w = say(rng.randint(0, 90))
            for _ in range(rng.randint(0, 2)):
                at = rng.randint(0, len(w))
                w[at:at] = rng.choice(shared)
            text = " ".join(w)
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "word"), (n + 3, "word"), (None, "word"), (None, None), (n + 4, rows[0][1])]
    return rows


def frame(spark, rows, extra=True):
    data = [(d, t, "en", f"src{(d or 0) % 3}" if d is None or d % 7 else None, len(t or "")) for d, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit("x").alias(c) for c in CLASHING])
    return df


def as_rows(df, *names):
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=repr)
