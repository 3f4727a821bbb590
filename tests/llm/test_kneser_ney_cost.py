"""What keeps the cost of a slab low: its tokens are sorted once, its n-grams once a level."""

import numpy as np

from unitlens.llm import kneser_ney as lm


def test_tokens_and_bigrams_are_sorted_once(spark, monkeypatch):
    texts = ["a b a c", "b b a", None, "c a d", ""]
    model = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"), parts=2)
    sorts, unique = [], lm._unique
    monkeypatch.setattr(lm, "_unique", lambda keys: sorts.append(len(keys)) or unique(keys))
    given = [b"a b x a", b"", None, b"x"]
    n, known, _, score = lm.Scorer(model).texts(given)
    assert n.tolist() == [5, 1, 1, 2] and known.tolist() == [4, 1, 1, 1]
    assert len(sorts) == 2
    alone = [lm.Scorer(model).texts([t])[3][0] for t in given]
    assert np.array_equal(score, alone)


def test_start_marks_are_told_apart_without_a_model(spark):
    model = lm.fit(spark.createDataFrame([], "text string"), parts=2)
    n, known, _, _ = lm.Scorer(model).texts([b"a b", None])
    assert n.tolist() == [3, 1] and known.tolist() == [0, 0]


def test_words_are_looked_up_once_a_slab(spark):
    model = lm.fit(spark.createDataFrame([("a b a",)], "text string"), parts=2)

    class Counted(lm._Ids):
        asked = 0

        def get(self, word):
            Counted.asked += 1
            return super().get(word)

        def __getitem__(self, word):
            Counted.asked += 1
            return super().__getitem__(word)

    ids = Counted(model.levels[0])
    words = [lm.START, *[b"a", b"b", b"x"] * 1000, lm.END]
    found = ids.of(words)
    assert Counted.asked <= 2 * len(set(words))
    assert found[0] == 0 and found[-1] >= 0 and found[3] == -1 and np.array_equal(found[1:4], found[4:7])
    assert np.array_equal(ids.of(words), found)
