"""BPE by prefixes against the tokenizers library."""

import hashlib
import random
import time

import numpy as np
import pytest

from placewise.llm import bpe
from placewise.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")
PARTS = ["a", "b", "A", " ", "  ", "\n", "\t", "é", "漢", "😀", "'s", "'ll", "'S", "1", "23", "²", "...", "!", "_", "<|endoftext|>", "<|end", "́", " ", "\x00", "\x1c", "՘",
         "aaaa", " the", " ing", "Ġ", ""]


@pytest.fixture(scope="module")
def tok():
    return bpe.tokenizer(PATH)


def expected(tok, text):
    ids = tok.library.encode(text, add_special_tokens=False).ids
    return ids, tok.library.decode(ids, skip_special_tokens=False)


def test_equals_the_library(tok):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(chr(rnd.choice((rnd.randrange(32, 0x500), rnd.randrange(0x500, 0xD800)))) for _ in range(40)) for _ in range(300)]
    for t in texts:
        ids, text = expected(tok, t)
        assert bpe.encode(t, tok).tolist() == ids and bpe.decode(ids, tok) == text, repr(t)


def test_every_token_is_its_own_encoding(tok):
    assert len(tok.length) == 50256
    for i in range(0, 50256, 7):
        assert tok.search(tok.bytes[i].decode("latin-1") if tok.bytes[i].isascii() else tok.bytes[i].decode("utf-8", "ignore") or "a")


def test_long_words_and_stretches(tok):
    began = time.perf_counter()
    for t in ("a" * 100_000, "ab" * 50_000, "中" * 20_000, "\n" * 50_000):
        assert bpe.encode(t, tok).tolist() == expected(tok, t)[0]
    assert time.perf_counter() - began < 30
    rnd = random.Random(2)
    for _ in range(300):
        t = "".join(rnd.choice(PARTS + [" word", " écrit"] * 8) for _ in range(60))
        assert b"".join(tok.runs(t, stretch=20)) == b"".join(tok.runs(t))


def test_decoding_of_bytes_that_are_no_text(tok):
    rnd = random.Random(3)
    for _ in range(500):
        ids = [rnd.randrange(50257) for _ in range(rnd.randint(0, 12))]
        assert bpe.decode(ids, tok) == tok.library.decode(ids, skip_special_tokens=False)
    assert bpe.decode([None, -1, 60_000], tok) == ""


def test_round_trip_and_columns(spark, tok):
    texts = [None, "", "one two", "one two", "<|endoftext|>", "word, and more. " * 100_000, "퟿😀"]
    df = spark.createDataFrame(list(enumerate(texts[:-1])) + [(None, texts[-1])], "doc_id long, text string").withColumnRenamed("text", "Text")
    rows = bpe.round_trip(df, PATH, text_col="Text").collect()
    want = [expected(tok, t or "") for t in texts]
    key = lambda n, a, b: (n, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest())
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(key(len(i), np.array(i, "<u4").tobytes(), d.encode()) for i, d in want)
    wide = df.selectExpr("*", "1 as IDS", "2 as decoded")
    back = bpe.decode_column(bpe.encode_column(wide, PATH, "Text"), PATH)
    assert back.columns == ["doc_id", "Text", "ids", "decoded"]
    assert all(r.decoded == (r.Text or "") for r in back.collect())
    assert bpe.round_trip(df.limit(0), PATH, text_col="Text").count() == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBpe(tokenizer_file("word_bpe_49k.json"))
