"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares one share of a text with a cutoff; a text that any rule finds above its cutoff is rejected. The
cutoffs are not guessed. They are steps of one ladder, from lenient to strict, on which all rules step at a time, so
what a step rejects is rejected by the next one too. For every stratum (language) the labelled good documents that pass the
base rules are the holdout, and a step counts only if the exact binomial test refutes "the rules together reject more than
``limit`` of the good documents" at level ``alpha / strata`` (Bonferroni). Steps are tested from the most lenient one on
and testing stops at the first that fails (fixed sequence; no further correction). With probability ``1 - alpha`` no
tested stratum loses more than ``limit`` of its good documents.

A stratum whose holdout is too small to pass even without a rejection is pooled with the others of that kind; the pool is
tested as one stratum, and its guarantee is for the documents of the pool together. If the pool is too small as well, or a
stratum has no labelled good document, nothing of it is rejected but by the base rules.

Words are runs of characters other than space and U+0009 to U+000D. A null text has no words. Three-word windows
are compared by 64-bit hash within one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens.functions.text import settle
from unitlens.llm.storage import saved, with_columns

SPACES = "[\\x20\\x09-\\x0D]+"
#: Rules: name -> (share of a text in hundredths, cutoffs from lenient to strict).
RULES = {
    "symbols": ("100.0D * n_symbols / n_words", (250.0, 200.0, 150.0, 100.0, 60.0, 40.0)),
    "repeats": ("100.0D * n_repeat_words / n_words", (45.0, 40.0, 35.0, 30.0)),
    "dup_lines": ("100.0D * n_dup_lines / n_lines", (90.0, 80.0, 70.0, 60.0, 50.0)),
    "upper": ("100.0D * n_upper / word_chars", (80.0, 60.0, 40.0)),
    "exclaims": ("100.0D * n_exclaims / n_words", (150.0, 100.0, 75.0, 50.0)),
    "word_length": ("1.0D * word_chars / n_words", (20.0, 16.0, 12.0)),
}
ALPHA, LIMIT = 0.05, 0.03
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3


def _removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def _windows_twice(df: DataFrame) -> DataFrame:
    """n_repeat_words from ``__words``: words inside a window that the text has twice or more."""
    hashes = F.when(F.size("__words") > WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("__words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("__words", i + k) for k in range(WINDOW)])))
    df = settle(df.withColumn("__hashes", hashes), "__hashes")
    again = F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), F.array_sort(F.transform(
        "__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = settle(df.withColumn("__sorted", again).drop("__words", "__hashes"), "__sorted")

    def met(x: Column, i: Column) -> Column:
        return (F.coalesce(F.get("__sorted", i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get("__sorted", i + 1)["h"] == x["h"], F.lit(False)))

    starts = F.array_sort(F.transform(F.filter("__sorted", met), lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("__sorted")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_upper, n_exclaims and
    n_repeat_words (all long, 0 for a null or empty text)."""
    t = F.coalesce(F.col("__text"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.withColumnRenamed(text, "__text")
    df = df.withColumn("__words", F.filter(F.split(t, SPACES), lambda w: w != "")).withColumn("__lines", lines)
    df = settle(df, "__words", "__lines")

    def count(c: Column, name: str) -> Column:
        return c.cast("long").alias(name)

    df = df.select(
        "*", count(F.size("__words"), "n_words"), count(F.length(_removed(t, SPACES)), "word_chars"),
        count(F.length(_removed(t, "[^#*$%&|<>]+")), "n_symbols"),
        count(F.length(_removed(t, "[^!]+")), "n_exclaims"), count(F.length(_removed(t, "[^\\p{Lu}]+")), "n_upper"),
        count(F.size("__lines"), "n_lines"), count(F.size("__lines") - F.size(F.array_distinct("__lines")), "n_dup_lines"),
    ).drop("__lines", "__text")
    return _windows_twice(df)


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(X <= k) for X binomial(n, rate), summed exactly term by term; 1 where k is at the mean or above."""
    step = F.log(F.lit(rate / (1 - rate)))
    first = n * F.log(F.lit(1 - rate))
    total = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")),
        F.struct(first.alias("lp"), F.exp(first).alias("p")),
        lambda acc, j: F.struct((acc["lp"] + F.log((n - j + 1) / j) + step).alias("lp"),
                                (acc["p"] + F.exp(acc["lp"] + F.log((n - j + 1) / j) + step)).alias("p")),
        lambda acc: acc["p"])
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(total)


def steps(rules: dict = RULES) -> list[dict[str, float]]:
    """The ladder: the cutoff of each rule at each step; a rule with fewer cutoffs stays at its strictest."""
    return [{name: cuts[min(i, len(cuts) - 1)] for name, (_, cuts) in rules.items()} for i in range(max(len(cuts) for _, cuts in rules.values()))]


def cutoffs(good: DataFrame, rules: dict = RULES, alpha: float = ALPHA, limit: float = LIMIT) -> DataFrame:
    """One row per stratum of ``good`` (stratum and features of labelled good documents past the base rules) with a
    column per rule: its cutoff at the strictest step that passed, or null."""
    ladder = steps(rules)
    hits = [F.sum(reduce(lambda a, b: a | b, [F.expr(share) > step[name] for name, (share, _) in rules.items()]).cast("long")).alias(f"k{i}")
            for i, step in enumerate(ladder)]
    counts = saved(good.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *hits), "rule-counts")
    level = alpha / max(1, counts.count())
    sized = counts.withColumn("tested", F.when(binomial_tail(F.col("n"), F.lit(0).cast("long"), limit) <= level, F.col("stratum")))
    ks = [f"k{i}" for i in range(len(ladder))]
    pools = sized.groupBy("tested").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in ks])
    passed = F.lit(None).cast("int")
    for i in reversed(range(len(ladder))):  # a step is reached only past all more lenient ones
        passed = F.when(binomial_tail(F.col("n"), F.col(f"k{i}"), limit) <= level, F.coalesce(passed, F.lit(i)))
    chosen = pools.select(F.col("tested").alias("pool"), passed.alias("step"))

    def cut(name: str) -> Column:
        return F.get(F.array(*[F.lit(step[name]) for step in ladder]), F.col("step")).alias(name)

    return sized.join(chosen, F.col("tested").eqNullSafe(F.col("pool"))).select("stratum", *[cut(name) for name in rules])


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang",
          rules: dict = RULES, alpha: float = ALPHA, limit: float = LIMIT, keep: tuple = ()) -> DataFrame:
    """Features, base_failed and kept for every row of ``docs``, with the columns ``keep``.

    ``labels`` has ``doc_id`` and ``quality``; quality 1 is good, other values and null are not used. Repeated labels
    count once, a document is good if any of its labels says so. A null stratum is a stratum of its own. Repeated
    rows of ``docs`` are judged each; no labels, or no rows, give no cutoffs and an empty holdout.
    """
    with_columns(docs, doc_id, text, stratum)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       F.coalesce(F.concat(F.lit("="), F.col(stratum)), F.lit("")).alias("stratum"), *keep)
    facts = saved(features(slim).withColumn("base_failed", base_failed()), "rule-features")
    marked = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    good = facts.where("not base_failed").join(marked, "doc_id", "left_semi")
    chosen = saved(cutoffs(good, rules, alpha, limit).withColumnsRenamed({r: f"cut_{r}" for r in rules}), "rule-cutoffs")
    over = reduce(lambda a, b: a | b, [
        F.coalesce(F.expr(share) > F.col(f"cut_{name}"), F.lit(False)) for name, (share, _) in rules.items()])
    return facts.join(chosen, "stratum", "left").withColumn(
        "kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(~over)).drop(*[f"cut_{r}" for r in rules])
