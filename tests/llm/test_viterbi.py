"""Ids and counts against the whole Viterbi search, in texts of all kinds and lengths; decoding of odd ids."""

import random

import pytest

from placewise.llm import sentencepiece
from placewise.llm.queries import tokenizer_file

from test_corpus_operators import _whole


@pytest.fixture(scope="module")
def vocab():
    return sentencepiece.vocabulary(tokenizer_file("piece_bpe_32k.model"))


def _texts():
    rnd = random.Random(6)
    bits = ["the", "end.", "no,", "a.b", "x,", ".", ",", "ing", "\n", "  ", "é", "𝒳", "internationalisation", "It's", "▁", "", "1.5", "z" * 9, "\t"]
    out = ["".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(rnd.randint(1, 40))) for _ in range(200)]
    return out + ["q" * 6000, "ab" * 4000 + "c", "".join(rnd.choice("abcde.") for _ in range(9000)), "word. " * 3000]


def test_encode_equals_whole_search(vocab):
    for t in _texts():
        assert sentencepiece.encode(t, vocab) == _whole(t, vocab)


def test_counts_equal_whole_search(vocab, monkeypatch):
    texts = _texts()
    for nodes in (sentencepiece.TRIE_NODES, 50):  # the trie is full within a word
        monkeypatch.setattr(sentencepiece, "TRIE_NODES", nodes)
        trie = sentencepiece.CountingTrie(vocab)
        for t in texts:
            assert sum(trie.tokens(w) for w in sentencepiece.pretokens(t, vocab)) == len(_whole(t, vocab))
            assert trie.nodes <= nodes


def test_scores_held_are_bounded(vocab):
    held = []
    for t in ("x" * 20_000, "the end of it " * 500):
        list(sentencepiece.stream_encode(sentencepiece.normalised(t), vocab, on_scores=held.append))
    assert max(held) <= 4 * vocab.longest + 1


def test_decode_of_odd_ids(vocab):
    good = sentencepiece.encode("some text", vocab)
    assert sentencepiece.decode([None, *good, None], vocab) == "some text"
    assert sentencepiece.decode([*good, -1, len(vocab.text)], vocab) == "some text��"
    assert sentencepiece.decode([], vocab) == ""
