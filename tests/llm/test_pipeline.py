"""Every stage of the pipeline against a brute-force version of it, on what the stage before it kept."""

import random

import duckdb
from test_golay_simhash import brute_fingerprint, brute_groups
from test_line_dedup import brute as brute_lines
from test_tokens import check_packed

import corpus_pipeline as pipeline
from unitlens.llm import language_id
from unitlens.llm.sql import op8

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(n):
    return pipeline.STAGES[n][1]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    kept = {r[0] for r in con.sql(f"select doc_id from ({op8()}) where kept").fetchall()}
    good = stage(0)(spark, docs, sf_dir).cache()
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == kept and 0 < len(kept) < len(rows)

    model = language_id.fit(good)
    clear = stage(1)(spark, good, sf_dir).cache()
    assert clear.columns == docs.columns
    judged = {d: model.predict(rows[d].text) for d in kept}
    kept = {d for d, (lang, score) in judged.items() if lang != "und" and score >= 0.5}
    assert {r.doc_id: r.text for r in clear.collect()} == {d: rows[d].text for d in kept}

    lines = stage(2)(spark, clear, sf_dir).cache()
    assert lines.columns == docs.columns
    places = brute_lines({d: rows[d].text for d in kept})
    texts = {}
    for d in kept:
        split = rows[d].text.split("\n")
        left = [x for i, x in enumerate(split) if places.get((d, i), (True,))[0]]
        if any(places[d, i][0] for i in range(len(split)) if (d, i) in places) or not any(p[0] == d for p in places):
            texts[d] = "\n".join(left)
    assert {r.doc_id: r.text for r in lines.collect()} == texts

    unique = stage(3)(spark, lines, sf_dir).cache()
    assert unique.columns == docs.columns
    groups = brute_groups({d: brute_fingerprint(t) for d, t in texts.items()})
    texts = {d: t for d, t in texts.items() if groups[d] == d}
    assert {r.doc_id: r.text for r in unique.collect()} == texts

    check_packed(stage(4)(spark, unique, sf_dir).collect(), texts)


def test_run_is_the_stages_one_after_the_other(spark, sf_dir):
    packed = pipeline.run(spark, sf_dir)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packed.count() > 0


def test_copies_go_and_clean_documents_stay(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(["ri", "ver", "sto", "ne", "gar", "den", "let", "ter", "mor"], k=rng.randint(2, 4)))
    text = {i: "\n".join(" ".join(word() for _ in range(25)) for _ in range(8)) for i in range(4)}
    rows = [(i, t, "en", "s", len(t)) for i, t in text.items()]
    rows += [(10, text[0], "en", "s", 1), (11, text[1] + "\nAnd one more line of its own, said at the end of it all.", "en", "s", 1),
             (12, None, "en", None, 0), (13, "", None, None, 0), (14, "$$$ ### " * 100, "en", "s", 1), (15, "1 2 3 " * 40, "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert {0, 1, 2, 3} <= got <= {0, 1, 2, 3, 11}


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_documents_that_share_an_id_or_have_none_are_judged_each(spark, tmp_path):
    rng = random.Random(5)
    text = ["\n".join(" ".join("".join(rng.choices("abcdefghijklmno", k=7)) for _ in range(20)) for _ in range(6)) for _ in range(5)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(None, text[0], "en"), (None, "too short", "en"), (5, text[1], "en"), (5, "short too", "en"), (None, text[2], None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], SCHEMA)
    good = stage(0)(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    assert sorted(r.text for r in good.collect()) == sorted(text[:3])

    rows = [(3, text[0]), (None, text[0]), (None, text[1]), (None, text[2]), (None, text[2] + " "), (6, text[3]), (6, text[4]), (4, text[4])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    unique = stage(3)(spark, docs, "")
    assert unique.columns == docs.columns
    got = {(r.doc_id, r.text.strip()) for r in unique.collect()}
    assert unique.count() == 5 and got == {(3, text[0]), (None, text[1]), (None, text[2]), (6, text[3]), (4, text[4])}


def test_language_stage_without_any_label_keeps_texts(spark):
    rows = [(1, "a clean text of words", None, "x", 21), (2, "12 %", None, "x", 4), (3, None, None, "x", 0), (None, "das ist ein Text", None, "x", 16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = pipeline.language(spark, docs, "")
    assert got.columns == docs.columns and {r.text for r in got.collect()} == {rows[0][1], rows[3][1]}
