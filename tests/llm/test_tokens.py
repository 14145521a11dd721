import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from drawlake.llm import tokens
from drawlake.llm.queries import op11_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_query_against_library(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = {(r.doc_id, len((r.text or "").encode()), n, n > 512) for r, n in zip(rows, library([r.text for r in rows]))}
    got = op11_tokens(spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_every_character(library):
    texts = [f"a{c}b 1{c}2 !{c}? {c}{c}" for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000)))]
    assert (tokens.Counter(PATH)(pa.array(texts)) == np.array(library(texts))).all()


def test_mixed_texts(library):
    parts = [*"aabst' \n\t!1x", "'s", "'ll", "'re", "'D", "é", "日", " ", "　", "<|endoftext|>", "<|endof", "²", "​", "\U0001f600", "́", "\x00", "\x85", "  "]
    draw = random.Random(3)
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 30))) for _ in range(20_000)]
    count = tokens.Counter(PATH)
    for _ in range(2):  # the second time from what is remembered
        assert count(pa.array(texts)).tolist() == library(texts)


@pytest.mark.parametrize("long", [tokens.LONG, 8, 1 << 30])
def test_long_pretokens(library, monkeypatch, long):
    """Merging rank by rank and round by round give the same counts."""
    monkeypatch.setattr(tokens, "LONG", long)
    rng = np.random.default_rng(0)
    texts = ["a" * 2001, "".join(rng.choice(list("abcdefgh"), 3000)), "日本語" * 900, "ab" * 700, " " * 3000, "!" * 999, "aaab" * 300, "x"]
    assert tokens.Counter(PATH)(pa.array(texts)).tolist() == library(texts)


def test_odd_rows(spark, library):
    long = "word " * 40_000 + "x" * 20_000
    rows = [(1, None), (2, ""), (3, long), (None, "one two"), (None, "one two"), (5, "<|endoftext|>"), (5, " \n ")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, n_tokens string, _text int")
    got = sorted((tuple(r) for r in tokens.token_counts(docs, PATH).collect()), key=repr)
    want = sorted(((i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, library([t for _, t in rows]))), key=repr)
    assert got == want
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tokens.Counter(public_tokenizers.path("word_bpe_49k.json"))
