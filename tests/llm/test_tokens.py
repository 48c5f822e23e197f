"""Ids against the tokenizer libraries."""

import random
from pathlib import Path

import pyarrow as pa
import pytest

from pagegrain.llm import tokens

pytestmark = pytest.mark.skipif(not Path(tokens.TOKENIZER_DIR).exists(), reason="tokenizer files are absent")


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.MergeTable.load(f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}.json")
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def split(ids, counts):
    out, at = [], 0
    for n in counts.tolist():
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def texts():
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "B", "'s", "'ll", "'re", "'", "''", "'S", "é", "中文", "1", "２", "½", "!", "..", " ", "　", "x" * 40, "\x1c", "​", "<|endoftext|>", "😀", "é", "\0", "aaaaaaaaa", "abcabcabcabc", "ſ", "\r\n"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(4000)]


def test_any_text(encoder, library):
    some = texts() + ["".join(map(chr, range(a, a + 500))) for a in (*range(0, 0xD000, 500), 0xE000, 0x10000, 0x1F000, 0xE0000, 0x10FE00)]
    assert split(*tokens.encode_column(encoder, pa.array(some))) == library(some)


def test_null_and_empty(encoder):
    assert split(*tokens.encode_column(encoder, pa.array([None, "", "a", None]))) == [[], [], [64], []]
    assert split(*tokens.encode_column(encoder, pa.array([], pa.string()))) == []


def test_blocks_of_long_texts(encoder, library, monkeypatch):
    long = "".join(texts()[:400])
    whole = library([long, "x" * 3000])
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 50)
    for size in (7, 50):
        assert "".join(tokens.blocks(long, size)) == long
        assert [i for b in tokens.blocks(long, size) for i in library([b])[0]] == whole[0]
    assert split(*tokens.encode_column(encoder, pa.array([long, "x" * 3000]))) == whole


def test_equal_keys_of_different_words(library, monkeypatch):
    monkeypatch.setattr(tokens, "word_keys", lambda data, starts, lengths: (lengths > 7).astype("int64") * 1_000_000_007 + _exact(data, starts, lengths))
    encoder = tokens.Encoder(tokens.MergeTable.load(f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}.json"))
    some = ["conveyor controller electromechanical conveyor thermodynamics", "crystallisation of the conveyor"] * 3
    for _ in range(2):
        assert split(*tokens.encode_column(encoder, pa.array(some))) == library(some)


def _exact(data, starts, lengths):
    import numpy as np

    short = np.array([int.from_bytes(data[s : s + n].tobytes(), "little") * 8 + n if n <= 7 else 0 for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)], dtype="int64")
    return short


def test_store_starts_anew(library, monkeypatch):
    monkeypatch.setattr(tokens, "STORE_WORDS", 5)
    encoder = tokens.Encoder(tokens.MergeTable.load(f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}.json"))
    for some in (texts()[:50], texts()[50:90], texts()[:50]):
        assert split(*tokens.encode_column(encoder, pa.array(some))) == library(some)


def test_frames(spark, library):
    df = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "x"), (None, None, "y"), (3, "", "z")], "doc_id long, text string, ids string")
    rows = sorted(map(tuple, tokens.encode_ids(df, "doc_id", "text").collect()), key=str)
    assert rows == sorted([(1, library(["one two"])[0]), (1, library(["one two"])[0]), (None, []), (3, [])], key=str)
    counted = tokens.count_tokens(df.withColumnRenamed("ids", "n_tokens"), "text")
    assert counted.columns == ["doc_id", "n_tokens"] and sorted(r.n_tokens for r in counted.collect()) == [0, 0, 2, 2]
    assert tokens.encode_ids(df.limit(0), "doc_id", "text").count() == 0
