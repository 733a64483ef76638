import random

import numpy as np
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from mailsieve.llm import bpe
from mailsieve.llm.queries import tokenizer_path

PATH = tokenizer_path()
WHOLE = Tokenizer.from_file(PATH)


def expected(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_tokenizers_library(spark):
    rng = random.Random(1)
    texts = [
        None, "", "a b  c\n\n d", "<|endoftext|>x <|endoftext|> y", "x" * 20_000, " " * 20_000 + "y", "ab " * 40_000, "é" * 17_000,
        "".join(rng.choice("abé12'sst!<|>") for _ in range(30_000)) + "<|endoftext|>" + "q" * 17_000,
        "".join(rng.choice("中文字符") for _ in range(18_000)), "line\n" * 5_000, "\u0085   x\t\r\n",
    ]
    rows = [(i % 4 or None, t) for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = bpe.decode(bpe.encode(df, PATH, ("doc_id", "text")), PATH).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == expected(r.text)
        assert r.decoded == WHOLE.decode(ids, skip_special_tokens=False)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aabbc'é 1", min_size=2, max_size=200), st.integers(1, 199), st.integers(1, 3))
def test_joined_halves_equal_the_whole(text, cut, window):
    text_of, encode = bpe._codec(PATH)
    symbols = "".join(s for s, _ in WHOLE.pre_tokenizer.pre_tokenize_str(text))
    cut = min(cut, len(symbols) - 1)
    joined = bpe.join_encoded(encode(symbols[:cut]), encode(symbols[cut:]), text_of, encode, window)
    assert joined.tolist() == encode(symbols).tolist()


def test_odd_rows(odd_docs, no_docs):
    found = bpe.encode(odd_docs, PATH).collect()
    assert len(found) == odd_docs.count()
    assert bpe.decode(bpe.encode(no_docs, PATH), PATH).count() == 0
