"""Candidate generation for fuzzy and containment matching.

All generators emit equi-join keys that every qualifying pair must share, so no pair of unrelated
strings is ever formed and no recall is lost. Joins of derived keys carry no broadcast hint: adaptive
execution knows their sizes when it gets there, broadcasts the small ones and splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scale import lookup, materialize


def sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.split(c, " ")), " ")


def _grams(c: Column) -> Column:
    """Bigrams of a string set between blanks, numbered by occurrence, so a repeated one counts as often as it occurs.

    Every bigram touches at most one blank, so the order of the words does not matter.
    """
    framed = F.concat(F.lit(" "), c, F.lit(" "))
    plain = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(framed) - 1), lambda i: F.substring(framed, i, F.lit(2))))
    return F.transform(plain, lambda g, i: F.concat(g, (i - F.array_position(plain, g)).cast("string")))


def _grams_shared(lengths: Column, least: float) -> Column:
    """How many bigrams two strings of these lengths together have in common if their ratio reaches `least`.

    Let L be the longest common subsequence of the strings between their blanks, S their length
    together and r the ratio: every one of the S - 2 L characters left over breaks at most one of the
    L - 1 steps between matched characters, so 3 L - S - 1 steps are bigrams of both. Without the
    blanks (L and S smaller by 2 and 4) that is at least (3 r / 200 - 1) S + 1. The same bound holds
    for the words that two sets do not share together with those they do.
    """
    return F.ceil((3 * least / 200 - 1) * lengths + 1 - 1e-9).cast("int")


def gram_rows(strings: DataFrame, key: str, text: Column) -> DataFrame:
    """Distinct keys with the length and bigrams of their text: key, _n, _g."""
    return strings.select(key).where(F.col(key) != "").distinct().withColumn("_s", text).select(
        key, F.length("_s").alias("_n"), F.explode(_grams(F.col("_s"))).alias("_g"))


def _gram_keys(grams: DataFrame, frequency: DataFrame, key: str, least: float, together: int) -> DataFrame:
    """(key, _n, _all, _k): a string's bigrams as hashes, and hashes of every `together` of its rarest ones.

    A partner has at least r / (200 - r) of a string's length. Of strings that share c bigrams, those
    left after taking c - together away still share `together`, so only the rarest ones of each side
    are combined.
    """
    ranked = grams.join(frequency, "_g", "left").groupBy(key, "_n").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_g").alias("g")))).alias("_all"))
    partner = F.ceil(F.col("_n") * (least / (200 - least)) - 1e-9)
    few = F.greatest(F.size("_all") - _grams_shared(F.col("_n") + partner, least) + together, F.lit(together))
    ranked = ranked.select(key, "_n", few.alias("_few"), F.transform("_all", lambda x: F.xxhash64(x["g"])).alias("_all"))
    ranked = ranked.withColumn("_p", F.slice("_all", F.lit(1), F.col("_few")))
    combined = "transform(_p, (x, i) -> struct(x AS h, i))"
    for _ in range(together - 1):  # append every later bigram
        combined = (f"flatten(transform({combined}, c -> transform(filter(transform(_p, (y, j) -> struct(y AS h, j)), y -> y.j > c.i), "
                    "y -> struct(xxhash64(c.h, y.h) AS h, y.j AS i))))")
    short = F.size("_p") < together  # both strings have so few bigrams only if they share them all
    keys = F.when(short, F.array(F.xxhash64("_p"))).otherwise(F.transform(F.expr(combined), lambda c: c["h"]))
    return ranked.select(key, "_n", "_all", F.explode(F.array_distinct(keys)).alias("_k"))


def gram_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float, together: int = 3) -> DataFrame:
    """Distinct (left_key, right_key) that can reach the ratio `least`, from rows of gram_rows.

    Frequencies are those of the right side. Strings that meet in a key go on when they have as many
    bigrams in common as the ratio asks for. A combination of common bigrams is used only by strings
    that have nothing rarer; joins on it may be split, as no step needs a key's rows together.
    """
    frequency = right.groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    a = _gram_keys(left, frequency, left_key, least, together).withColumnsRenamed({"_n": "_m", "_all": "_ours"})
    b = _gram_keys(right, frequency, right_key, least, together)
    near = F.least("_m", "_n") * 2 >= (F.col("_m") + F.col("_n")) * (least / 100) - 1e-9
    alike = F.size(F.array_intersect("_ours", "_all")) >= _grams_shared(F.col("_m") + F.col("_n"), least)
    return a.join(b, "_k").where(near).where(alike).select(left_key, right_key).distinct()


#: Searches by left-out characters: how many of both strings together, and the longest string whose variants are listed.
CLOSE = ((2, 90), (3, 30))


def plain_tokens(c: Column) -> Column:
    """The words of a string in order with single blanks, as the ratio compares them."""
    return F.array_join(F.array_sort(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")), " ")


def _variants(n: int) -> Column:
    """Hash of every string left of `_s` without n of its characters."""
    left = "array(struct(_s AS s, 0 AS i))"
    for _ in range(n):  # leave out one more, not before the last one left out
        left = (f"flatten(transform({left}, x -> transform(filter(sequence(1, length(x.s) + 1), p -> p > x.i AND p <= length(x.s)), "
                "p -> struct(concat(substring(x.s, 1, p - 1), substring(x.s, p + 1)) AS s, p - 1 AS i))))")
    return F.array_distinct(F.expr(f"transform({left}, x -> xxhash64(x.s))"))


def close_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, most: int, longest: int) -> DataFrame:
    """Distinct (left_key, right_key) whose texts of sorted words are equal once a and b characters are left
    out of them, a + b <= `most`; right texts of up to `longest` characters and left ones `most` shorter.

    Names of one pattern share nearly all bigrams, but hardly ever what is left without so few
    characters. Lengths m and n fix b = n - m + a, so only variants that the other side's lengths
    can meet are listed, and a pair is formed only if it is that close.
    """
    # A few names have very many variants: a fixed number of tasks, which small inputs would not get.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ours = left.select(left_key).distinct().repartition(tasks, left_key).withColumn("_s", plain_tokens(F.col(left_key))).withColumn("_m", F.length("_s"))
    theirs = right.select(right_key).distinct().repartition(tasks, right_key).withColumn("_s", plain_tokens(F.col(right_key))).withColumn("_n", F.length("_s"))
    ours, theirs = ours.where((F.col("_m") > 0) & (F.col("_m") <= longest - most)), theirs.where((F.col("_n") > 0) & (F.col("_n") <= longest))
    steps = ours.select("_m").distinct().crossJoin(F.broadcast(theirs.select("_n").distinct())).withColumn(
        "_a", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("_b", F.col("_n") - F.col("_m") + F.col("_a"))
    # At most `longest` lengths a side.
    steps = materialize(steps.where((F.col("_b") >= 0) & (F.col("_a") + F.col("_b") <= most)), "lengths")

    def rows(texts: DataFrame, key: str, length: str, out: str) -> DataFrame:
        wanted = steps.select(length, "_a", "_b").distinct()
        every = None
        for n in range(most + 1):
            some = texts.join(F.broadcast(wanted.where(F.col(out) == n)), length).select(
                key, F.explode(F.transform(_variants(n), lambda h: F.xxhash64(h, "_a", "_b"))).alias("_k"))
            every = some if every is None else every.unionByName(some)
        return every
    return rows(ours, left_key, "_m", "_a").join(rows(theirs, right_key, "_n", "_b"), "_k").select(left_key, right_key).distinct()


def _words(strings: DataFrame, key: str) -> DataFrame:
    """Distinct keys with their distinct words: key, _t, _n (length of the words with blanks between)."""
    words = F.array_distinct(F.filter(F.split(key, " "), lambda w: w != ""))
    return strings.select(key).where(F.col(key) != "").distinct().select(key, words.alias("_w")).select(
        key, F.explode("_w").alias("_t"), F.length(F.array_join("_w", " ")).alias("_n"))


def _covered(covered: DataFrame, covering: DataFrame, frequency: DataFrame, key: str, other: str, least: float) -> DataFrame:
    """Distinct pairs whose shared words leave so little of `key` that the ratio reaches `least`.

    A string of length n whose shared words have length s scores 100 - 100 (n - s) / (n + s), so s is
    at least n r / (200 - r). The rarest words that are longer together than the rest of n cannot all
    be missing: one of them is a key. What the pair shares is then added up.
    """
    share = least / (200 - least)
    order = Window.partitionBy(key).orderBy(F.coalesce("_df", F.lit(0)), "_t")
    ranked = covered.join(frequency, "_t", "left").withColumn(
        "_before", F.coalesce(F.sum(F.length("_t") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rare = ranked.where(F.col("_before") <= F.col("_n") * (1 - share) + 1e-9).select(key, "_t")
    met = rare.join(covering.select(other, "_t"), "_t").select(key, other).distinct()
    shared = met.join(covered, key).join(covering.select(other, "_t"), [other, "_t"]).groupBy(key, other, "_n").agg(
        (F.sum(F.length("_t") + 1) - 1).alias("_s"))
    return shared.where(F.col("_s") >= F.col("_n") * share - 1e-9).select(key, other)


def token_set_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, least: float = 90.0) -> DataFrame:
    """Distinct (left_key, right_key) that can reach token_set_ratio >= `least`: one side's words all but
    cover the other's, or what the words do not share is alike."""
    a, b = materialize(_words(left, left_key), "left-words"), materialize(_words(right, right_key), "right-words")
    count = F.count(F.lit(1)).alias("_df")
    ours = _covered(a, b, b.groupBy("_t").agg(count), left_key, right_key, least)
    theirs = _covered(b, a, a.groupBy("_t").agg(count), right_key, left_key, least)
    text = lambda c: F.array_join(F.array_sort(F.array_distinct(F.split(c, " "))), " ")
    alike = gram_pairs(gram_rows(left, left_key, text(left_key)), materialize(gram_rows(right, right_key, text(right_key)), "grams"),
                       left_key, right_key, least)
    pairs = ours.select(left_key, right_key).unionByName(theirs.select(left_key, right_key))
    return pairs.unionByName(alike).distinct()


def _inside_words(vocabulary: DataFrame, labels: DataFrame) -> DataFrame:
    """(_word, label) where a single-word label of eight or more characters lies inside a word: its first eight are the key."""
    keys = labels.where((F.size("_w") == 1) & (F.length("label") >= 8)).select("label", F.substring("label", 1, 8).alias("_k"))
    pieces = F.transform(F.sequence(F.lit(1), F.length("_word") - 7), lambda i: F.substring("_word", i, F.lit(8)))
    windows = vocabulary.where(F.length("_word") >= 8).select("_word", F.explode(F.array_distinct(pieces)).alias("_k"))
    return windows.join(lookup(keys), "_k").where(F.col("_word").contains(F.col("label"))).select("_word", "label").distinct()


def _word_ends(vocabulary: DataFrame, wanted: DataFrame, heads: bool) -> DataFrame:
    """(_word, _part) where a wanted part (_part) begins, or with `heads` ends, a word of the vocabulary."""
    n = F.sequence(F.lit(1), F.length("_word"))
    ends = F.transform(n, lambda i: F.substring("_word", -i, i) if heads else F.substring("_word", F.lit(1), i))
    return vocabulary.select("_word", F.explode(ends).alias("_part")).join(lookup(wanted), "_part").select("_word", "_part")


def contained_labels(texts: DataFrame, labels: DataFrame, text_col: str, label_col: str, id_col: str | None = None) -> DataFrame:
    """Distinct (id, label) where a specific label occurs inside the text; without id_col the text is its own id.

    Only labels of two or more words, or of eight or more characters, count. In a text the first word
    of a longer label ends a word, its last begins one, and those between are whole. Which distinct
    words of all texts can be such ends is found once; then every word of a text is one row that
    looks up its label by its own end and the next word's.
    """
    id_col = id_col or text_col
    named = labels.select(F.col(label_col).alias("label")).distinct().where((F.length("label") >= 8) | F.col("label").contains(" "))
    named = materialize(named.withColumn("_w", F.split("label", " ")), "phrases")
    longest = named.agg(F.coalesce(F.max(F.size("_w")), F.lit(1))).first()[0]
    rows = texts.select(F.col(id_col).alias("_id"), F.split(text_col, " ").alias("_t")).distinct()
    rows = rows.select("_id", F.posexplode(F.transform("_t", lambda w, i: F.struct(w.alias("w"), F.slice("_t", i + 2, F.lit(max(1, longest - 1))).alias("rest")))))
    rows = materialize(rows.select("_id", F.col("col.w").alias("_word"), F.col("col.rest").alias("_rest")).where("_word <> ''").distinct(), "text-words")
    vocabulary = materialize(rows.select("_word").distinct(), "vocabulary")
    single = rows.select("_id", "_word").distinct().join(_inside_words(vocabulary, named), "_word").select("_id", "label")

    phrases = named.where(F.size("_w") > 1).select("label", "_w", F.col("_w")[0].alias("_first"), F.col("_w")[1].alias("_second"), (F.size("_w") == 2).alias("_pair"))
    firsts = _word_ends(vocabulary, phrases.select(F.col("_first").alias("_part")).distinct(), True).withColumnRenamed("_part", "_first")
    begun = _word_ends(vocabulary, phrases.where("_pair").select(F.col("_second").alias("_part")).distinct(), False)
    seconds = begun.select("_word", F.col("_part").alias("_second"), F.lit(True).alias("_pair")).unionByName(
        phrases.where("not _pair").select(F.col("_second").alias("_word"), "_second", F.lit(False).alias("_pair")).distinct())
    seconds = seconds.withColumnRenamed("_word", "_next")
    met = rows.withColumn("_next", F.get("_rest", F.lit(0))).where("_next is not null").join(firsts, "_word")
    met = met.join(seconds, "_next").join(lookup(phrases), ["_first", "_second", "_pair"])
    k = F.size("_w")
    goes_on = F.col("_pair") | ((F.slice("_rest", F.lit(1), k - 2) == F.slice("_w", F.lit(2), k - 2))
                                & F.coalesce(F.startswith(F.get("_rest", k - 2), F.get("_w", k - 1)), F.lit(False)))
    return single.unionByName(met.where(goes_on).select("_id", "label")).distinct().select(
        F.col("_id").alias(id_col), F.col("label").alias(label_col))
