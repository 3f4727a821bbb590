"""Trained models: held-out accuracy, learned rows only, and edges."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitlens.llm import language_id, quality_model
from unitlens.llm.queries import op1_language_id, op6_quality_model
from unitlens.llm.sampling import per_label, share

FOLDER = "/root/testdata/sf0.01"


def test_op1_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = op1_language_id(spark, FOLDER).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def test_a_language_of_very_long_texts_is_learned(spark):
    rows = [(i, "der und die das ist nicht ein " * 4, "de") for i in range(40)]
    rows += [(100 + i, "le et la les une pas dans " * 5_000, "fr") for i in range(6)]
    docs = spark.createDataFrame([*rows, (200, "12 34", "xx"), (201, None, "yy")], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["de", "fr"]
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()} == {
        **{r[0]: r[2] for r in rows}, 200: "und", 201: "und"}


def test_language_edges(spark):
    rows = [(1, "der die das und " * 30, "de", "x"), (2, "le la les et " * 30, "fr", "x"), (3, None, "fr", "x"), (4, "", None, "x"),
            (5, "12 %% 34", "de", "x"), (None, "und der", None, "x"), (7, "la " * 300_000, None, "x"), (7, "la les", None, None)]
    docs = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string, score string")
    model = language_id.fit(docs)
    assert model.languages == ["de", "fr"] and (model.weights == 0).mean() > 0.5
    got = language_id.predict(docs, model)
    assert got.columns == ["doc_id", "lang", "lang_pred", "score"] and got.count() == 24
    by = {(r.doc_id, r.lang): r for r in got.collect()}
    assert by[3, "fr"].lang_pred == by[4, None].lang_pred == by[5, "de"].lang_pred == "und" and by[4, None].score == 0
    assert by[None, None].lang_pred == "de" and by[7, None].lang_pred == "fr"
    nothing = language_id.fit(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), model).collect() == []
    one = language_id.fit(docs.where("lang = 'de'"))
    assert one.predict("abc") == ("de", 1.0)


def test_document_frequencies_cover_all_rows(spark):
    texts = [f"text number {i}" for i in range(50)]
    n, df = language_id.document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(7))
    want = np.zeros(language_id.BINS, "i8")
    for t in texts:
        want[language_id.bins_of(t)[0]] += 1
    assert n == 50 and (df == want).all()


def test_long_texts_have_all_their_grams(monkeypatch):
    text = "abcdefgh" * 40
    whole = language_id.bins_of(text)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    parts = language_id.bins_of(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_temperature_recovers_the_scale():
    rng = np.random.default_rng(0)
    logits = rng.standard_normal((4000, 3)) * 2
    p = language_id.softmax(logits)
    y = np.array([rng.choice(3, p=r) for r in p])
    assert language_id.fit_temperature(logits * 4, y) == pytest.approx(4, rel=0.15)


def test_op6_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    scored = op6_quality_model(spark, folder)
    rows = scored.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.97


def test_quality_edges(spark):
    rows = [(i, "fine calm words here " * (1 + i % 3), "x") for i in range(40)] + [(100 + i, "JUNK!! $$$ JUNK!! " * 9, "x") for i in range(40)]
    rows += [(900, None, "x"), (901, "", "x"), (902, "calm " * 100_000, "x"), (None, "words", "x"), (0, "fine calm", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(1, 0), (None, 1), (5, None), (6, 7)],
                                   "doc_id long, quality int")
    model = quality_model.fit(docs, labels)
    got = quality_model.score(docs, model)
    assert got.columns == ["doc_id", "score"] and got.count() == len(rows)
    by = {r.doc_id: r.score for r in got.collect()}
    assert by[7] > 0.5 > by[107] and by[902] > 0.5 and 0 <= by[900] <= 1 and by[900] == by[901]
    empty = quality_model.fit(docs, labels.where("false"))
    assert {r.score for r in quality_model.score(docs, empty).collect()} == {0.5}
    assert quality_model.score(docs.where("false"), model).collect() == []


def test_samples_are_bounded_and_repeatable(spark):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("often").alias("kind"))
    counts, some = per_label(rows, "kind", "id", 500, 5)
    assert counts == {"often": 18_000, "rare": 2_000}
    got = {r.kind: r["count"] for r in some.groupBy("kind").count().collect()}
    assert all(abs(n - 500) < 110 for n in got.values())
    assert sorted(r.id for r in some.collect()) == sorted(r.id for r in per_label(rows.repartition(9), "kind", "id", 500, 5)[1].collect())
    assert per_label(rows.where("false"), "kind", "id", 5, 5)[1].count() == 0
    assert 0 <= rows.agg(F.min(share("id"))).first()[0] < rows.agg(F.max(share("id"))).first()[0] < 1
