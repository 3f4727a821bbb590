"""The language model against plain dictionaries."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from unitlens.llm import kneser_ney as lm
from unitlens.llm.queries import op11_kneser_ney


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), None]


class Plain:
    """Interpolated modified Kneser-Ney by dictionaries of tuples."""

    def __init__(self, texts, order):
        self.order, grams = order, [Counter() for _ in range(order + 1)]
        for text in texts:
            seq = ["<s>", *tokens(text)]
            for k in range(1, order + 1):
                grams[k].update(tuple(seq[i:i + k]) for i in range(len(seq) - k + 1))
        self.words = Counter({g[0]: n for g, n in grams[1].items() if g != ("<s>",)})
        self.n, self.v = sum(self.words.values()), len(self.words)
        adjusted = [Counter() for _ in range(order + 1)]
        adjusted[order] = grams[order]
        for k in range(1, order):
            for g, n in grams[k].items():
                if g[0] == "<s>":
                    adjusted[k][g] = n
            for g in grams[k + 1]:
                adjusted[k][g[1:]] += 1
        del adjusted[1][("<s>",)]
        self.adjusted, self.cut, self.context = adjusted, [None], [None]
        for k in range(1, order + 1):
            spread = Counter(adjusted[k].values())
            n = [0, *(spread[i] for i in (1, 2, 3, 4))]
            cut = [0, 0.5, 1, 1.5]
            if all(n[1:]):
                y = n[1] / (n[1] + 2 * n[2])
                own = [0] + [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
                cut = own if all(0 < own[i] <= i for i in (1, 2, 3)) else cut
            self.cut.append(cut)
            around = defaultdict(list)
            for g, c in adjusted[k].items():
                around[g[:-1]].append(c)
            self.context.append({h: (sum(c), sum(cut[min(x, 3)] for x in c) / sum(c)) for h, c in around.items()})

    def chance(self, history, word, k):
        if k == 0:
            return 1 / (self.v + 1)
        history = history[len(history) - k + 1:] if k > 1 else ()
        less = self.chance(history[1:], word, k - 1)
        if history not in self.context[k]:
            return less
        total, free = self.context[k][history]
        c = self.adjusted[k].get((*history, word), 0)
        return max(c - self.cut[k][min(c, 3)], 0) / total + free * less

    def score(self, text):
        seq, own, base = ["<s>", *tokens(text)], 0.0, 0.0
        for i in range(1, len(seq)):
            k = min(self.order, i + 1)
            own += math.log10(self.chance(tuple(seq[max(0, i - k + 1):i]), seq[i], k))
            base += math.log10((self.words[seq[i]] + 0.5) / (self.n + 0.5 * (self.v + 1)))
        return len(seq) - 1, sum(self.words[w] > 0 for w in seq[1:]), self.n, base, own


TEXTS = [None, "", " \n\t", "a", "a b", "a b c a b c", "A b C", "the cat sat", "the cat ran", "the dog sat", "the dog ran to the cat",
         "x\x0by\x0cz\rw", "café CAFÉ    ", "İ I i", "a a a a a a", "a b\n" * 40, "tie tie", "tie tie"]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("slab", [1 << 20, 16])
def test_against_dictionaries(spark, order, slab, monkeypatch):
    monkeypatch.setattr(lm, "SLAB_BYTES", slab)  # in the driver's process; tasks keep theirs
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(TEXTS)], "doc_id long, text string, score double").repartition(3)
    learned = [t for i, t in enumerate(TEXTS) if i % 3]
    model = lm.fit(docs.where("doc_id % 3 <> 0"), order, parts=5)
    plain = Plain(learned, order)
    scorer = lm.Scorer(model)
    here = list(zip(*scorer.texts([None if t is None else t.encode() for t in TEXTS]), strict=True))
    rows = {r.doc_id: r for r in lm.score(docs, model).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        n, known, total, base, own = plain.score(text)
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total), text
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(own, rel=1e-9), text
        assert here[i][:2] == (n, known) and here[i][2:] == pytest.approx((base, own), rel=1e-9), text


def test_probabilities_of_a_context_add_up(spark):
    texts = ["a b a c", "b c a", "c c c a b", "a"]
    lm_model = lm.fit(spark.createDataFrame([(t,) for t in texts], "text string"), 3, parts=2)
    scorer, plain = lm.Scorer(lm_model), Plain(texts, 3)
    for history in ("", "a", "a b", "c c", "b zz"):
        before = scorer.texts([history.encode()])[3][0] - math.log10(plain.chance(("<s>", *history.split())[-2:], None, min(3, len(history.split()) + 2)))
        mass = 0.0
        for word in ("a", "b", "c", "zz"):
            text = f"{history} {word}"
            k = min(3, len(text.split()) + 2)
            end = math.log10(plain.chance(("<s>", *text.split())[-2:], None, k))
            mass += 10 ** (scorer.texts([text.encode()])[3][0] - end - before)
        k = min(3, len(history.split()) + 2)
        mass += plain.chance(("<s>", *history.split())[-2:], None, k)
        assert mass == pytest.approx(1, rel=1e-9), history


def test_small_blocks_in_tasks(spark, monkeypatch):
    """Parts, flushes and slabs of a few rows give the same model; the functions are run here, where the sizes are patched."""
    import pyarrow as pa

    texts = [" ".join(f"w{(i * j) % 17}" for j in range(i)) for i in range(60)]
    want = lm._words_counted(4)(iter([pa.RecordBatch.from_pydict({"text": texts})]))
    whole = Counter()
    for b in want:
        whole.update(dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)))
    for name, value in (("SLAB_BYTES", 40), ("FLUSH_WORDS", 3)):
        monkeypatch.setattr(lm, name, value)
    parts = Counter()
    for b in lm._words_counted(4)(iter([pa.RecordBatch.from_pydict({"text": texts})])):
        for key, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            parts[key] += n
    assert parts == whole and sum(whole.values()) == sum(len(t.split()) + 2 for t in texts)


def test_a_hot_word_and_a_very_long_text(spark):
    long = " ".join(f"the w{i % 997}" for i in range(400_000))
    rows = [(1, long), (1, long), (None, "the the the"), (3, "the w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = lm.fit(docs, 2, parts=8)
    sizes = [p.n for p in model.levels[1].parts]
    assert sum(sizes) == 2 * 997 + 1 + 4 and len(sizes) > 4  # the word's successors are in many parts
    plain = Plain([t for _, t in rows], 2)
    got = sorted(((r.doc_id or 0, r.n_tokens, r.score) for r in lm.score(docs, model).collect()))
    for (doc, n, own), (key, text) in zip(got, [(0, rows[2][1]), (1, long), (1, long), (3, rows[3][1])], strict=True):
        want = plain.score(text)
        assert doc == key and n == want[0] and own == pytest.approx(want[4], rel=1e-9)


def test_nothing_to_learn_or_to_score(spark):
    none = spark.createDataFrame([], "doc_id long, text string, n_known int")
    model = lm.fit(none)
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in lm.score(some, model).orderBy("doc_id").collect()] == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert lm.score(none, lm.fit(some)).collect() == []
    with pytest.raises(ValueError):
        lm.fit(some, 1)


def test_op11(spark):
    folder = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    plain = Plain([t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1], lm.ORDER)
    rows = op11_kneser_ney(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        n, known, total, base, own = plain.score(docs[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(own, rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert np.sum([r.score for r in held]) > np.sum([r.base_score for r in held])
