from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from documents_fixture import make_docs  # noqa: F401
from shelfwise.llm import spm_lattice as sl

ODD = ["", "  two  spaces   x", " lead", "trail ", "<s> </s> <unk> <0x41>", "日本語 テキスト 梦", "emoji 😀 x\x00y", "tab\tnew\nline\r\n",
       "a" * 300, "   ", "ﬁ é é", "xxxxx" + " " * 40 + "y", "Ünïcödé ▁ mark"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=sl.default_model_path())


@pytest.fixture(scope="module")
def enc():
    return sl.Encoder(sl.default_model_path())


def test_equals_the_library(library, enc):
    rng = random.Random(1)
    syllables = ["the", "ing", "an", "é", "sch", "ión", "x", "Q", "7", "'", "ß"]
    texts = ODD + [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(60)]
    ids = list(enc.ids(texts))
    assert [np.frombuffer(i, "<u4").tolist() for i in ids] == library.encode(texts, num_threads=1)
    assert [enc.text(i) for i in ids] == library.decode(library.encode(texts, num_threads=1))
    assert [enc.text(i) for i in ids[:-61]] == ODD[:-1]


def test_suffix_array_finds_every_occurrence():
    rng = random.Random(2)
    text = "".join(rng.choice("abc") for _ in range(500))
    codes = np.array([ord(c) for c in text], np.uint32)
    words = ["a", "ab", "abc", "cab", "bb", "abcabc", "d", "ccccccc"]
    table = np.zeros((len(words), 8), np.uint32)
    for k, w in enumerate(words):
        table[k, :len(w)] = [ord(c) for c in w]
    array = sl.suffix_array(codes, 8)
    low, high = sl.occurrences(codes, array, table, np.array([len(w) for w in words]))
    for k, w in enumerate(words):
        assert sorted(array[low[k]:high[k]]) == [i for i in range(len(text)) if text.startswith(w, i)]


def test_columns(make_docs):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (4, "long " * 20_000)]
    df = make_docs(rows).select("doc_id", "text", sl.encode_column()(F.col("text")).alias("ids"))
    got = df.select("doc_id", "text", "ids", sl.decode_column()(F.col("ids")).alias("back")).collect()
    assert all(r.back == r.text for r in got) and [r.ids for r in got if r.doc_id == 1] == [None]
    both = make_docs(rows).select("text", sl.code_column()(F.col("text")).alias("c")).select("text", "c.ids", "c.decoded").collect()
    assert sorted([(r.text, r.ids) for r in both], key=str) == sorted([(r.text, r.ids) for r in got], key=str)
    assert all(r.decoded == r.text for r in both)
    assert make_docs([]).select(sl.encode_column()(F.col("text"))).count() == 0


def test_suffixes_of_text_shorter_than_the_longest_piece():
    text = "abracadab"
    codes = np.array([ord(c) for c in text])
    assert sl.suffix_array(codes, 32).tolist() == sorted(range(len(text)), key=lambda k: text[k:])
