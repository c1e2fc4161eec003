"""Patterns carry the packing; words that contain the mark between words; other tokenizer files."""

import json
import random

import numpy as np
import pytest

from placewise.llm import packing
from placewise.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def hist():
    """Lengths of documents of a heavy tail, some cut at the capacity."""
    n = np.random.default_rng(5).pareto(0.9, 30_000) * 120 + 20
    n = n.astype(np.int64)
    out = np.bincount(n % 2048, minlength=2049)
    out[0] = 0
    out[2048] = (n // 2048).sum()
    return out


@pytest.mark.parametrize("times", [1, 50])
def test_patterns_carry_the_packing(hist, times):
    hist = hist * times
    full, left = packing.pattern_plan(hist)
    assert all(sum(lengths) == 2048 for lengths, _ in full)
    assert left[1:2048].sum() < 0.35 * hist[1:2048].sum()
    plan = packing.plan(hist)
    used = np.zeros(2049, np.int64)
    for lengths, n in plan:
        np.add.at(used, list(lengths), n)
    assert (used == hist).all() and max(sum(lengths) for lengths, _ in plan) <= 2048
    bound = -(-int((hist * np.arange(2049)).sum()) // 2048)
    assert sum(n for _, n in plan) <= 1.001 * bound + 1


def test_fit_is_non_negative_least_squares():
    """Against all supports: the best of the unconstrained fits that are non-negative."""
    from itertools import chain, combinations

    rnd = np.random.default_rng(3)
    for _ in range(20):
        hist = np.r_[0, rnd.integers(0, 30, 8)]
        rows = np.array([(7, 1, 0, 0), (6, 2, 0, 0), (6, 1, 1, 0), (4, 4, 0, 0), (4, 2, 1, 1), (8, 0, 0, 0)])
        a = np.zeros((9, len(rows)))
        for k, row in enumerate(rows):
            for v in row[row > 0]:
                a[v, k] += 1
        least = (hist**2).sum()
        for pick in chain.from_iterable(combinations(range(len(rows)), n) for n in range(1, len(rows) + 1)):
            x = np.linalg.lstsq(a[:, pick], hist, rcond=None)[0]
            if (x >= -1e-9).all():
                least = min(least, ((a[:, pick] @ x - hist) ** 2).sum())
        got = packing.fit_repeats(rows, hist, 5000)
        assert (got >= 0).all() and ((a @ got - hist) ** 2).sum() <= least + 1e-2


def test_words_with_the_mark():
    tok, exact = packing.WordTokenizer(tokenizer_file("word_bpe_49k.json")), packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"))
    exact.by_words = False
    assert tok.by_words
    rnd = random.Random(4)
    for texts in (["a\x01b"], ["\x01"], ["\x01 \x01\x01", ""], ["a\x01b", "plain words"], [""], [" ".join(rnd.choice(["x\x01", "yes.", "no,\n", "Ä"]) for _ in range(900))]):
        assert tok.encode(texts) == exact.encode(texts)
        assert tok.encode(texts) == exact.encode(texts)  # and from the table


def test_pack_with_the_mark_alone(spark):
    df = spark.createDataFrame([(1, "a\x01b"), (1, "a\x01b"), (None, None)], "doc_id long, text string")
    rows = packing.pack(df, tokenizer_file("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start) for r in rows) == [(0, 0, 0), (1, 0, 0), (1, 0, 0)]
    assert len({r.sequence_id for r in rows}) == 1


def test_other_tokenizer_files_are_encoded_whole(tmp_path):
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        said = json.load(f)
    said["normalizer"]["normalizers"] = said["normalizer"]["normalizers"][:2]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(said), encoding="utf-8")
    tok = packing.WordTokenizer(str(path))
    assert not tok.by_words
    assert tok.encode(["Upper Case."]) == [np.array(tok.tokenizer.encode("Upper Case.", add_special_tokens=False).ids, "<u4").tobytes()]
