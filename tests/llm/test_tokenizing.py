from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mendwell.llm import tokenizing as T

VOCABULARY = f"{T.TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not Path(VOCABULARY).exists(), reason="no vocabulary files here")


@pytest.fixture(scope="module")
def known():
    import tiktoken

    ranks = T.ranks_of(VOCABULARY)
    return ranks, tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40) | st.text("ab ", max_size=60), max_size=5))
def test_same_ids_as_the_library(known, texts):
    import regex

    ranks, enc = known
    words = sorted({w for t in texts for w in regex.findall(T.PATTERN, t)})
    ids = dict(zip(words, T.replay([w.encode("utf-8") for w in words], ranks)))
    for t in texts:
        assert [i for w in regex.findall(T.PATTERN, t) for i in ids[w]] == enc.encode_ordinary(t)


def test_frames(spark, known):
    texts = [None, "", " ", "<|endoftext|> is text", "a" * 100_000, "naïve ⁄ ½ ① 漢字 🙂", "x\r\n\ty  z"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, "no id", "c"), (1, "again", "c")], "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in T.encode(df, "doc_id", "text").collect()), key=str)
    assert got == sorted([(i, known[1].encode_ordinary(t) if t else []) for i, t in enumerate(texts)] + [(None, known[1].encode_ordinary("no id")), (1, known[1].encode_ordinary("again"))], key=str)
    assert T.encode(df.limit(0), "doc_id", "text").count() == 0


def test_round_trip_when_words_are_forgotten(spark, known, monkeypatch):
    texts = [f"word{i} and {i * 7919} more" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(T, "WORDS", 50)
    back = {v: k for k, v in known[0].items()}
    for r in T.encode(df, "doc_id", "text").collect():
        assert b"".join(back[i] for i in r.ids).decode() == texts[r.doc_id]


def test_a_vocabulary_of_any_size(spark, known, monkeypatch):
    monkeypatch.setattr(T, "VOCABULARY_BYTES", 1)
    df = spark.createDataFrame([(1, "Read from each executor's disk."), (2, None)], "doc_id bigint, text string")
    assert {r.doc_id: r.ids for r in T.encode(df, "doc_id", "text").collect()} == {1: known[1].encode_ordinary("Read from each executor's disk."), 2: []}
