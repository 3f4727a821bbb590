"""Quality rules against their SQL and against plain counting."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from unitlens.llm import quality_rules as rules
from unitlens.llm.queries import op8_quality_rules
from unitlens.llm.sql import ORACLES


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_op8_equals_its_sql(spark, size):
    folder = f"/root/testdata/{size}"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{folder}/{name}.parquet'")
    answer = con.execute(ORACLES["op8_quality_rules"])
    names = [c[0] for c in answer.description]
    got = op8_quality_rules(spark, folder)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(answer.fetchall())


def counted(text):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again))


TEXTS = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a", "x y z\nx y z\n x y z", "日本 語 # $ é è", "a\x0bb\x0cc\rd",
         "tie " * 60, "u v w " * 3 + "q r s u v w", " ".join(f"w{i}" for i in range(80)), "one\n\none\n \none\n"]


def test_counts(spark):
    docs = spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judge(docs, labels).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(t), repr(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


def test_a_very_long_text_and_repeated_rows(spark):
    words = [f"w{i % 5000}" for i in range(150_000)]
    docs = spark.createDataFrame([(1, " ".join(words), None), (1, " ".join(words), None), (None, "a b", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, quality int")
    got = rules.judge(docs, labels).orderBy(F.desc_nulls_last("doc_id")).collect()
    assert [(r.n_words, r.n_repeat_words) for r in got] == [(150_000, 150_000)] * 2 + [(2, 0)]
    assert rules.judge(docs.where("false"), labels).collect() == []


def test_binomial_tail_is_exact(spark):
    rows = [(n, k) for n in (1, 7, 50, 400) for k in range(0, n + 1, max(1, n // 9))]
    got = spark.createDataFrame(rows, "n long, k long").select("n", "k", rules.binomial_tail(F.col("n"), F.col("k"), 0.05).alias("p")).collect()
    for r in got:
        want = 1.0 if r.k >= r.n * 0.05 else sum(math.comb(r.n, j) * 0.05**j * 0.95 ** (r.n - j) for j in range(r.k + 1))
        assert r.p == pytest.approx(want, rel=1e-9)


def test_small_strata_are_judged_together(spark):
    rows = [(f"s{i % 5}", 100, 500, 0, 5, 0, 0, 0, 0) for i in range(300)] + [("large", 100, 500, 70, 5, 0, 0, 0, 0)] * 400
    good = spark.createDataFrame(rows, GOOD)
    got = {r.stratum: r.symbols for r in rules.cutoffs(good).collect()}
    assert got == {**{f"s{i}": 40.0 for i in range(5)}, "large": 100.0}
    assert {r.symbols for r in rules.cutoffs(good.where("stratum <> 'large'").limit(60)).collect()} == {None}


def test_the_risk_is_held_in_simulation(spark):
    """Good documents are over each cutoff with a chance of its own; the chosen step may exceed the limit in 5 % of draws at most."""
    import random

    random.seed(11)
    chances = [0.0, 0.004, 0.012, 0.03, 0.05, 0.2]  # of being over the cutoff of a step and not of the one before
    cuts = [step["symbols"] for step in rules.steps()]
    rows, draws = [], 60
    for draw in range(draws):
        for _ in range(500):
            over = max((i for i in range(6) if random.random() < chances[i] - (chances[i - 1] if i else 0)), default=None)
            least = min((i for i in range(6) if over is not None and i >= over), default=None)
            rows.append((f"d{draw}", 100, 500, 0 if least is None else int(cuts[least]) + 1, 5, 0, 0, 0, 0))
    got = rules.cutoffs(spark.createDataFrame(rows, GOOD), alpha=0.05 * draws).collect()  # each draw at 5 %
    wrong = sum(r.symbols is not None and chances[cuts.index(r.symbols)] > rules.LIMIT for r in got)
    assert wrong <= 8 and sum(r.symbols is not None for r in got) > 50


GOOD = ("stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_upper long, n_exclaims long, "
        "n_repeat_words long")


def test_op8_rejects_by_its_method(spark):
    rows = op8_quality_rules(spark, "/root/testdata/sf0.01").where("not base_failed and not kept").collect()
    assert rows


def test_cutoffs_hold_the_risk_per_stratum(spark):
    """A stratum whose good documents are rich in symbols keeps them; a small one gets no cutoff; a clean one the strictest."""
    rows = []
    for stratum, n, symbols in (("clean", 3000, 0), ("rich", 3000, 120), ("small", 40, 0)):
        rows += [(stratum, 100, 500, symbols, 5, 0, 0, 0, 0)] * n
    good = spark.createDataFrame(rows, "stratum string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
                                       "n_upper long, n_exclaims long, n_repeat_words long")
    got = {r.stratum: r for r in rules.cutoffs(good).collect()}
    assert (got["clean"].symbols, got["rich"].symbols, got["small"].symbols) == (40.0, 150.0, None)
    assert got["clean"].upper == 40.0 and got["small"].upper is None
