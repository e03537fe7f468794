"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected in any stratum.

Every document gets integer measures of its words, symbols, lines and repetition. The labelled holdout is halved by a hash of
the id. In one half every rule takes, for each stratum, the cutoff that gains most there: rejected bad documents less
GOOD_COST times rejected good ones, among equals the most lenient. The rules with a gain are ordered by it. The
other half, in which nothing was chosen, tests the joint verdict of the first rule, of the first two, and so on: how many of
n good documents any of them rejects. A verdict is certified if the exact binomial bound on the rate of false
rejections stays within MAX_FALSE at confidence 1 - MISS / tests, tests being the number of all verdicts in all strata
(Bonferroni), so all certificates hold together. Each stratum uses its longest certified verdict. Without a gain, or with too
few labels for a certificate, no rule rejects anything there.

Everything is DataFrame expressions: measures are narrow array expressions, counts combine on the map side.

Null and empty texts have no words and fail the base rule. Labels of null or unknown value, or without a document, are
ignored; repeated labels count once for each distinct (id, label), and repeated documents get a row each. A null
stratum is a stratum. Empty tables give an empty result; without labels only the base rule rejects. Columns that clash
with those made here are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .durable import cut, table

MAX_FALSE, MISS, GOOD_COST = 0.05, 0.05, 10
#: A word: no space, no U+0009 to U+000D.
_SPACE = "[\\x20\\x09-\\x0D]+"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"]
#: Rule -> (its value in whole thousandths or hundredths, from counts; candidate cutoffs, which the value must exceed).
RULES = {
    "symbols": ("n_symbols * 1000 div word_chars", [5, 10, 20, 30, 50, 75, 100, 150, 200, 300]),
    "duplicate_lines": ("n_dup_lines * 1000 div n_lines", [50, 100, 150, 200, 250, 300, 400, 500, 600, 700]),
    "repeated_words": ("n_repeat_words * 1000 div n_words", [20, 40, 60, 80, 100, 120, 140, 160, 180, 190]),
    "few_distinct_words": ("1000 - n_distinct * 1000 div n_words", [300, 350, 400, 450, 500, 550, 600, 650, 700, 800]),
    "long_words": ("word_chars * 100 div n_words", [600, 650, 700, 750, 800, 900, 1000, 1200, 1500, 2000]),
}


def measures(docs: DataFrame, keys: list[str], text_column: str = "text") -> DataFrame:
    """`keys` and the integer measures of every text."""
    d = docs.select(*keys, F.coalesce(F.col(text_column), F.lit("")).alias("_t"))
    d = d.select(
        *keys,
        F.array_remove(F.split("_t", _SPACE), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    hashes = F.when(F.size("_w") < 5, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size("_w") - 5), lambda i: F.xxhash64(*(F.col("_w")[i + k] for k in range(5))))
    )
    d = d.select(
        *keys,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        hashes.alias("_h"),
    )
    # Windows found twice: sorted by hash they are neighbours. Their words are counted once, from left to right.
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_s", F.when(twice, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda e, at: F.coalesce(F.get("_s", at)["x"] == e["x"], F.lit(False))
    found = F.transform("_s", lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
    d = d.withColumn("_p", F.sort_array(F.filter(found, lambda i: i.isNotNull())))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    # As one generated row: a later filter is then applied to values, not pushed into copies of the expressions above.
    return d.select(*keys, F.inline(F.array(F.struct(*MEASURES))))


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """Logarithm of the chance of at most k successes in n trials, summed exactly."""
    odds = F.log(F.lit(p / (1 - p)))
    start = n * F.log(F.lit(1 - p))
    step = lambda acc, j: F.struct((acc["term"] + F.log((n - j + 1) / j) + odds).alias("term"), acc["sum"].alias("sum"))
    add = lambda acc: F.struct(acc["term"].alias("term"), (F.greatest(acc["sum"], acc["term"]) + F.log1p(F.exp(-F.abs(acc["sum"] - acc["term"])))).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(start.alias("term"), start.alias("sum")), lambda acc, j: add(step(acc, j)), lambda acc: acc["sum"])
    return F.when(k < 1, start).otherwise(total)


def _value(rule: str) -> Column:
    return F.coalesce(F.expr(RULES[rule][0]), F.lit(0).cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _second_half() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1


def _chosen_cutoffs(held: DataFrame, stratum: str, max_false: float) -> DataFrame:
    """`stratum` and chosen: (-gain, rule, cutoff) of every rule with a gain, the best first."""
    above = []
    for i, (rule, (_, cutoffs)) in enumerate(RULES.items()):
        for c in cutoffs:
            over = _value(rule) > c
            above.append(F.struct(F.lit(i).alias("rule"), F.lit(c).cast("long").alias("cutoff"), F.sum((over & (F.col("quality") == 1)).cast("long")).alias("k"), F.sum((over & (F.col("quality") == 0)).cast("long")).alias("bad")))
    counts = held.groupBy(stratum).agg(F.sum("quality").cast("long").alias("n"), F.array(*above).alias("c"))
    counts = counts.select(stratum, "n", F.explode("c").alias("c")).select(stratum, "n", "c.*")
    gain = F.col("bad") - GOOD_COST * F.col("k")
    best = counts.where((gain > 0) & (F.col("k") <= max_false * F.col("n"))).groupBy(stratum, "rule").agg(F.max(F.struct(gain.alias("gain"), "cutoff")).alias("x"))
    return best.groupBy(stratum).agg(F.array_sort(F.collect_list(F.struct((-F.col("x.gain")).alias("loss"), "rule", F.col("x.cutoff").alias("cutoff")))).alias("chosen"))


def certified_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, max_false: float = MAX_FALSE, miss: float = MISS) -> DataFrame:
    """`stratum` and one array: the cutoff of every rule in the order of RULES, null where the rule is off.

    measured: doc_id, `stratum` and MEASURES; labels: doc_id and quality, 1 for good and 0 for bad.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").distinct()
    held = cut(measured.where(~base_failed()).join(known, "doc_id"))
    chosen = table(_chosen_cutoffs(held.where(~_second_half()), stratum, max_false).select(F.col(stratum).alias("_s"), "chosen"))
    tested = held.where(_second_half() & (F.col("quality") == 1)).join(chosen, F.col(stratum).eqNullSafe(F.col("_s")))
    values = F.array(*(_value(rule) for rule in RULES))
    # The first rule in the order that rejects the document decides from which verdict on it is rejected.
    first = F.array_position(F.transform("chosen", lambda x: F.element_at(values, x["rule"] + 1) > x["cutoff"]), True)
    per_verdict = [F.sum(((first > 0) & (first <= j)).cast("long")) for j in range(1, len(RULES) + 1)]
    counts = tested.groupBy(stratum).agg(F.first("chosen").alias("chosen"), F.count(F.lit(1)).alias("n"), F.array(*per_verdict).alias("k"))
    counts = table(counts)
    tests = max(1, counts.agg(F.coalesce(F.sum(F.size("chosen")), F.lit(0))).first()[0])
    each = counts.select(stratum, "chosen", "n", F.posexplode("k").alias("j", "k")).where(F.col("j") < F.size("chosen"))
    sure = log_binomial_cdf(F.col("k"), F.col("n"), max_false) <= F.lit(math.log(miss / tests))
    longest = each.where((F.col("k") <= max_false * F.col("n")) & sure).groupBy(stratum).agg(F.max(F.struct("j", "chosen")).alias("x"))
    used = longest.select(stratum, F.slice(F.col("x.chosen"), F.lit(1), F.col("x.j") + 1).alias("used"))
    cutoff = lambda i: F.get(F.transform(F.filter("used", lambda x: x["rule"] == i), lambda x: x["cutoff"]), F.lit(0))
    return used.select(stratum, F.array(*(cutoff(i) for i in range(len(RULES)))).alias("cutoffs"))


def _with_verdict(measured: DataFrame, cutoffs: DataFrame, stratum: str) -> DataFrame:
    cutoffs = cutoffs.select(F.col(stratum).alias("_cut_stratum"), F.col("cutoffs").alias("_cutoffs"))
    judged = measured.join(cutoffs, F.col(stratum).eqNullSafe(F.col("_cut_stratum")), "left")
    rejected = reduce(lambda a, b: a | b, (F.coalesce(_value(rule) > F.col("_cutoffs")[i], F.lit(False)) for i, rule in enumerate(RULES)))
    return judged.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~rejected}).drop("_cut_stratum", "_cutoffs")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_column: str = "text") -> DataFrame:
    """doc_id, stratum, MEASURES, base_failed and kept of every document."""
    measured = cut(measures(docs, ["doc_id", stratum], text_column))
    return _with_verdict(measured, certified_cutoffs(measured, labels, stratum), stratum)


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with their columns.

    Texts are measured once more beside their rows: that costs less than a shuffle of all texts to the verdicts.
    """
    measured = cut(measures(docs, ["doc_id", stratum]))
    # Written: a file's size is known, so Spark joins a short table without dealing the texts by stratum.
    cutoffs = table(certified_cutoffs(measured, labels, stratum))
    packed = docs.select(F.struct("*").alias("_row"), F.col(stratum).alias(stratum), F.col("text").alias("_text"))
    judged = _with_verdict(measures(packed, ["_row", stratum], "_text"), cutoffs, stratum)
    return judged.where("kept").select("_row.*")
