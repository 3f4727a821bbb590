"""Viterbi against the tokenizers library's unigram model over the same pieces, and counts against ids."""

import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from unitlens.llm import piece_counts, piece_viterbi
from unitlens.llm.queries import op5_piece_viterbi, op9_piece_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


def library():
    vocabulary = [(SP.id_to_piece(i), SP.get_score(i)) for i in range(SP.get_piece_size())]
    # names of special pieces are no text
    vocabulary = [(p, s) if not (SP.is_control(i) or SP.is_unknown(i)) else (f"\x00{i}", s) for i, (p, s) in enumerate(vocabulary)]
    return Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))


LIBRARY = library()
ODD = ["", " ", "  ", "a", "Hello world", "Hello  world\nx", "\n", "\n\n a \n", "   lead and trail   ", "日本語のテスト 𠜎𠜎", "é ́ñß",
       "x" * 400, "ab" * 300 + "☃" * 5, "tab\tnew\r\nline", "the the the of of", "a▁b", "中文混排 text 123,456.78", "  z"]


def want(text):
    return LIBRARY.encode(SP.normalize(text), add_special_tokens=False).ids


def check(texts):
    ids = [np.frombuffer(x, "<u4").tolist() for x in piece_viterbi.encode_texts(PATH, texts)]
    counts = piece_counts.count_texts(PATH, texts)
    decode = piece_viterbi.decoder(PATH)
    for text, got, n in zip(texts, ids, counts, strict=True):
        assert got == want(text), repr(text)
        assert n == len(got), repr(text)
        assert decode(np.asarray(got, "<u4").tobytes()) == text.replace("▁", " "), repr(text)


def test_odd_texts():
    check(ODD)
    check(["\n".join(ODD), " ".join(ODD)])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aehnrst ou\n▁é☃,.T", max_size=30), min_size=1, max_size=5))
def test_random_texts(texts):
    check(texts)


def test_ties_go_to_the_piece_that_starts_first():
    class Few:
        id = {"a": 1, "b": 2, "ab": 3, "ba": 4, "bab": 5}
        score = {"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -2.0, "bab": -3.0}
        unknown_score = -20.0

        @staticmethod
        def unknown(character):
            return [0]

    for word in ("ab", "abab", "babab", "aZb", "ZZ", "bZab"):
        best = brute(Few, word)
        assert np.frombuffer(piece_viterbi.Segmenter(Few).segment({word})[word], "<u4").tolist() == best, word
        assert piece_counts.Counter(Few).count(word) == len(best)


def brute(lexicon, word):
    """Forward over starts, replaced only by more: the rule as it is written."""
    best = [(0.0, [])] + [None] * len(word)
    for s in range(len(word)):
        for e in range(s + 1, len(word) + 1):
            piece = word[s:e]
            score = lexicon.score.get(piece, lexicon.unknown_score if e == s + 1 else None)
            if score is not None and (best[e] is None or best[s][0] + score > best[e][0]):
                best[e] = (best[s][0] + score, best[s][1] + [lexicon.id.get(piece, 0)])
    return best[-1][1]


@pytest.mark.parametrize("name", ["op5", "op9"])
def test_queries_against_the_library(spark, sf_dir, name):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {d: want(t or "") for d, t in texts.items()}
    if name == "op5":
        got = {r.doc_id: (r.n_tokens, r.ids_crc32, r.round_trip) for r in op5_piece_viterbi(spark, sf_dir).collect()}
        assert got == {d: (len(x), zlib.crc32(np.asarray(x, "<u4").tobytes()), True) for d, x in ids.items()}
    else:
        assert {r.doc_id: r.n_tokens for r in op9_piece_counts(spark, sf_dir).collect()} == {d: len(x) for d, x in ids.items()}


def test_edges(spark):
    rows = [(1, None, 7, "i"), (1, None, 7, "i"), (None, "", 8, None), (3, "long " * 30_000, 9, "i"), (4, "y" * 20_000, 9, "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    got = piece_viterbi.encode(docs, PATH).collect()
    assert sorted((r.doc_id or 0, len(r.ids) // 4) for r in got) == sorted((r[0] or 0, len(want(r[1] or ""))) for r in rows)
    back = piece_viterbi.decode(piece_viterbi.encode(docs.where("doc_id = 3"), PATH), PATH).first()
    assert back.text == rows[3][1]
    counted = piece_counts.token_counts(docs, PATH)
    assert counted.columns == ["doc_id", "ids", "n_tokens"]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted.collect()) == sorted((r[0] or 0, len(want(r[1] or ""))) for r in rows)
    assert piece_counts.token_counts(docs.where("false"), PATH).collect() == []
    assert piece_viterbi.encode(docs.where("false"), PATH).collect() == []
    assert piece_viterbi.decode(spark.createDataFrame([(None,)], "ids binary"), PATH).first().text is None


def test_one_word_of_a_million_letters():
    import time

    import public_tokenizers

    from unitlens.llm import piece_viterbi, unigram

    text = "".join("qxzvwkja"[(i * i + i // 7) % 8] for i in range(1_000_000))
    segmenter = piece_viterbi.Segmenter(unigram.Lexicon(public_tokenizers.path("piece_bpe_32k.model")))
    begin = time.perf_counter()
    ids = segmenter.segment({text})[text]
    assert time.perf_counter() - begin < 60 and len(ids) // 4 > 100_000
    # a stretch of it, cut where the whole is cut, has the ids it has there
    short = text[:3000]
    whole, part = (ids, segmenter.segment({short})[short])
    assert whole[:len(part) - 200] == part[:len(part) - 200]
