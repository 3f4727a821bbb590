"""Encoding against the library, packing against its rules, the store against plain reading."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from unitlens.llm import packing, token_store
from unitlens.llm.queries import op2_best_fit_packing, op4_token_store
from unitlens.llm.storage import shared_path
from unitlens.llm.tokens import Encoder

FILES = {"byte_bpe_50k.json": True, "word_bpe_49k.json": False}
ENCODERS = {name: Encoder(public_tokenizers.path(name), spaces) for name, spaces in FILES.items()}
LIBRARY = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in FILES}
ODD = ["", " ", "\n", "a  b", "a   b", "\n\n x", "a\n\n\nb", " a", "a ", "it's, don't. 'll 's", "7 7 77 a7 7.", "a\t \tb\tc",
       "Ünï çödé, ß.", "é ́x", "<|endoftext|> x<|endoftext|>", " a  b", "a   b", "x\u0085 y\x1c z",
       "日本語 テスト", "word," * 30 + " " + "x" * 3000, "a.b.c. d,e, f.,!", "\n7\n7", "Ａ７ ７", "ǅ ﬁ İ", "a\r\nb\r\n\r\nc"]
ALPHABET = st.text(alphabet="ab C7'.,!\n \t ́é<|", max_size=40)


def ids(name, text):
    return LIBRARY[name].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_the_library_on_odd_texts(name):
    for texts in (ODD, ODD[::-1], [" ".join(ODD), "\n".join(ODD)]):
        for text, got in zip(texts, ENCODERS[name].encode(texts), strict=True):
            assert list(np.frombuffer(got, "<u4")) == ids(name, text), repr(text)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(ALPHABET, min_size=1, max_size=4))
def test_ids_equal_the_library(name, texts):
    for text, got in zip(texts, ENCODERS[name].encode(texts), strict=True):
        assert list(np.frombuffer(got, "<u4")) == ids(name, text), repr(text)


def best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        at = min((i for i, r in enumerate(room) if r >= n), key=lambda i: room[i], default=None)
        if at is None:
            room.append(capacity)
            at = len(room) - 1
        room[at] -= n
    return len(room), sorted(room)


@settings(max_examples=200, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 30), st.integers(0, 40)))
def test_plan_is_best_fit_decreasing(counts):
    used = {}
    for r in packing.plan(counts, 30):
        assert r.offset + r.per * r.length <= 30 and r.count % r.per == 0
        for i in range(r.count):
            used.setdefault(r.sequence + i // r.per, []).append((r.offset + i % r.per * r.length, r.length))
    for places in used.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False))
    lengths = [n for n, c in counts.items() for _ in range(c)]
    assert sorted(n for p in used.values() for _, n in p) == sorted(lengths)
    assert best_fit(lengths, 30) == (len(used), sorted(30 - sum(n for _, n in p) for p in used.values()))


def test_plan_refuses_lengths_beyond_the_capacity():
    with pytest.raises(ValueError, match="lengths"):
        packing.plan({31: 1}, 30)


def check_packed(rows, texts, end=0, capacity=packing.CAPACITY):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, own in by_doc.items():
        whole = [*ids("byte_bpe_50k.json", texts[doc] or ""), end]
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert len(own) == -(-len(whole) // capacity) and all(r.length == capacity for r in own[1:])
        at = 0
        for r in own:
            assert r.start == at
            assert r.ids_crc32 == zlib.crc32(np.asarray(whole[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(whole)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert own[0].offset == 0 and own[-1].offset + own[-1].length <= capacity
        assert all(a.offset + a.length == b.offset for a, b in zip(own, own[1:], strict=False))
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.02 * -(-total // capacity) + 1


def test_op2_against_the_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_packed(op2_best_fit_packing(spark, sf_dir).collect(), texts)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, task string, rank int, length int")


def test_packing_edges(spark):
    from pyspark.sql import functions as F

    texts = [None, "", "", "x", "same text", "same text", "long " * 9000, *["tie"] * 50]
    docs = frame(spark, [(i, t, "i", "t", 1, 2) for i, t in enumerate(texts)])
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    packed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")))
    check_packed(packed.collect(), dict(enumerate(texts)))
    empty = packing.token_pieces(docs.where("false"), public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.pack(empty).collect() == []
    nulls = packing.token_pieces(frame(spark, [(None, "a", "", "", 1, 1)] * 2), public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(r.offset for r in packing.pack(nulls).collect()) == [0, 2]
    with pytest.raises(ValueError, match="lacks"):
        packing.token_pieces(docs.drop("text"), "x")


def check_store(rows, texts, end=2):
    start = 0
    rows = sorted(rows, key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        whole = [*ids("word_bpe_49k.json", texts[r.doc_id] or ""), end]
        assert (r.start, r.n_tokens) == (start, len(whole))
        assert r.ids_crc32 == zlib.crc32(np.asarray(whole, "<u4").tobytes())
        start += len(whole)


def test_op4_against_the_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_store(op4_token_store(spark, sf_dir).collect(), texts)


def test_store_edges(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(token_store, "BLOCK_BYTES", 64)
    texts = {i: t for i, t in enumerate([None, "", "A  b", "tie", "tie", "very " * 20000, *(f"doc {i} x" for i in range(300))])}
    path = shared_path(spark, "store")
    docs = frame(spark, [(i, t, "i", "t", 1, 2) for i, t in texts.items()])
    token_store.write(docs.repartition(5), path, public_tokenizers.path("word_bpe_49k.json"))
    check_store(token_store.read(spark, path).withColumn("ids_crc32", F.crc32("ids")).collect(), texts)
    some = token_store.read(spark, path, only=[5, 120]).collect()
    assert sorted(r.doc_id for r in some) == [5, 120]
    assert spark.read.parquet(f"{path}/blocks").count() > 5
    empty = shared_path(spark, "store")
    token_store.write(docs.where("false"), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert token_store.read(spark, empty).collect() == []
    twice = shared_path(spark, "store")
    token_store.write(frame(spark, [(1, "a", "", "", 1, 1), (1, "a", "", "", 1, 1), (None, "b", "", "", 1, 1)]), twice,
                      public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.doc_id or 0, r.start, r.n_tokens) for r in token_store.read(spark, twice).collect()) == [
        (0, 0, 2), (1, 2, 2), (1, 4, 2)]
    with pytest.raises(ValueError, match="hash"):
        spark.createDataFrame([("no", 2, bytearray(b""))], "hash string, width int, bytes binary") \
            .write.mode("overwrite").parquet(f"{twice}/dictionary")
        token_store.read(spark, twice)
