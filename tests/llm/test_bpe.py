import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm.bpe import Vocabulary, encode_decode
from weftgraph.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def both():
    with open(TOKENIZER, "rb") as f:
        return Vocabulary(f.read()), Tokenizer.from_file(TOKENIZER)


def ids(v, text):
    return np.frombuffer(v.encode(text), "<u4").tolist()


def same(both, text):
    mine, theirs = both
    want = theirs.encode(text, add_special_tokens=False).ids
    assert ids(mine, text) == want
    assert mine.decode(mine.encode(text)) == theirs.decode(want, skip_special_tokens=False)


def test_every_token_encodes_to_itself(both):
    v = both[0]
    assert all(v.encode_piece(t) == [i] for t, i in v.ids.items())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text(both, text):
    same(both, text)


def test_hard_texts(both):
    rng = random.Random(7)
    parts = ["a", "aa", "the", "\x1c", "\x85", "\xa0", "　", " ", "\n\n", "é", "日本", "🙂", "'s", "'S", "12٣", "ǅ", "__--", "<|endoftext|>", "﻿", "\x00"]
    for _ in range(2000):
        same(both, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))))
    same(both, "a" * 3000)
    same(both, "ab " * 5000 + "<|endoftext|>" * 3)
    v = both[0]
    assert v.encode(None) == v.encode("") == b"" and v.decode(None) == ""
    assert v.decode(np.array([v.ids[b"\xe9"[:1]] if b"\xe9" in v.ids else 0], "<u4").tobytes()) == "�"


def test_frame(spark):
    rows = [(1, "hello world", "keep"), (1, "hello world", "keep"), (2, None, None), (None, "", "x"), (3, "word " * 40000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = {(r["doc_id"], r["text"]): r for r in encode_decode(df, TOKENIZER).collect()}
    assert encode_decode(df, TOKENIZER).columns == ["doc_id", "text", "n_tokens", "ids", "decoded"]
    assert encode_decode(df, TOKENIZER).count() == 5
    assert out[2, None]["n_tokens"] == 0 and out[2, None]["decoded"] == "" and out[3, "word " * 40000]["decoded"] == "word " * 40000
    assert encode_decode(df.where("doc_id > 9"), TOKENIZER).count() == 0
