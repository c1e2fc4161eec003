"""Byte-level BPE, encoded by dynamic programming over prefixes, and decoded.

The BPE ids of a pre-token's prefix end in one token, and only one: of the tokens that are suffixes of the prefix, the
one whose first byte follows a prefix with a last token that it can stand beside. An automaton over the
vocabulary lists the suffixes of every prefix in one pass over the bytes. Two tokens can stand side by side if BPE
of their joined bytes gives these two; that is tested by taking the later merge of the two back, step by step, and
asking whether a merge across the boundary would have come first. So each prefix stores one token, and the ids are
read off by following the tokens back: no merge is ever replayed, and a pre-token of n bytes costs O(n) lookups.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import slices
from .sentencepiece import Recent

#: How byte-level tokenizers cut a text into pre-tokens: English endings, letters, digits, other marks, white space.
_PRETOKEN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
MEMO = 500_000
MEMO_CHARS = 64
PAIRS = 1_000_000
STRETCH = 1 << 20
NEVER = 1 << 62


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 ones for themselves, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """A byte-level BPE tokenizer file, with what the search needs of it."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self._check(said)
        self.library = Tokenizer.from_file(path)
        chars = byte_chars()
        vocab = said["model"]["vocab"]
        raw = {i: bytes(chars[c] for c in t) for t, i in vocab.items()}
        self.rank: dict[int, int] = dict.fromkeys(raw, -1)  # when a token's last merge comes; -1: a byte
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for when, pair in enumerate(said["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[left + right]
            if made in self.parts:
                raise ValueError("a token that two merges make is beyond this search")
            self.parts[made] = (vocab[left], vocab[right])
            self.merge[vocab[left], vocab[right]] = self.rank[made] = when
        self.pairs: dict[tuple[int, int], bool] = {}
        # A token counts only if BPE of its own bytes ends in it.
        sound: set[int] = set()
        for i in sorted(raw, key=self.rank.__getitem__):
            one = i not in self.parts
            if one and len(raw[i]) == 1 or not one and sound.issuperset(self.parts[i]) and self._beside(*self.parts[i], self.rank[i]):
                sound.add(i)
        self.automaton = ahocorasick.Automaton()
        for i in sound:
            self.automaton.add_word(raw[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = {i: len(raw[i]) for i in sound}
        self.special = {t["content"]: t["id"] for t in said.get("added_tokens", [])}
        longest_first = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.specials = re.compile(f"({'|'.join(longest_first)})") if longest_first else None
        for text, i in self.special.items():
            raw[i] = bytes(chars[c] for c in text) if all(c in chars for c in text) else text.encode()
        self.bytes = np.full(max(raw) + 2, b"", object)  # the last one: ids outside the vocabulary
        for i, b in raw.items():
            self.bytes[i] = b
        self.memo: Recent = Recent(MEMO)
        self.plain: set[str] = set()  # characters met that are plain

    @staticmethod
    def _check(said: dict) -> None:
        model, first, last = said["model"], said.get("pre_tokenizer") or {}, said.get("decoder") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        cut = first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
        odd = [t for t in said.get("added_tokens", []) if t.get("single_word") or t.get("lstrip") or t.get("rstrip")]
        if model.get("type") not in (None, "BPE") or not plain or not cut or odd or said.get("normalizer") or last.get("type") != "ByteLevel":
            raise ValueError("not a plain byte-level BPE tokenizer")

    def _beside(self, a: int, b: int, bound: int = NEVER) -> bool:
        """Whether no merge across the boundary of ``a`` and ``b`` comes before what made them (and before ``bound``).

        Of equal merges the one further left comes first, so a merge across that equals one within ``b`` counts too.
        """
        rank, merge, parts = self.rank, self.merge, self.parts
        while True:
            if merge.get((a, b), NEVER) < bound:
                return False
            if rank[a] > rank[b]:
                bound = rank[a]
                a = parts[a][1]
            elif rank[b] >= 0:
                bound = rank[b] + 1
                b = parts[b][0]
            else:
                return True

    def _learn(self, pair: tuple[int, int]) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[pair] = good = self._beside(*pair)
        return good

    def search(self, word: str) -> list[int]:
        """Ids of a pre-token: the last token of each of its prefixes, then the way back."""
        raw = word if word.isascii() else word.encode().decode("latin-1")
        last = [-1] * (len(raw) + 1)
        length, known = self.length, self.pairs.get
        found = -1
        for end, token in self.automaton.iter(raw):  # of one end, the longest first
            if end == found:
                continue
            begin = end + 1 - length[token]
            if begin:
                pair = (last[begin], token)
                good = known(pair)
                if not (self._learn(pair) if good is None else good):
                    continue
            last[end + 1] = token
            found = end
        out, at = [], len(raw)
        while at:
            out.append(last[at])
            at -= length[out[-1]]
        out.reverse()
        return out

    def is_plain(self, text: str) -> bool:
        """Whether all characters are letters, digits, marks and the like in the same way for all libraries: none without a class
        when this Python was made, no number that is not a digit, no separator control."""
        new = set(text) - self.plain
        odd = {c for c in new if unicodedata.category(c) in ("Cn", "Nl", "No") or "\x1c" <= c <= "\x1f"}
        self.plain |= new - odd
        return not odd

    def pretokens(self, text: str) -> list[str]:
        """The text's pre-tokens; one with characters of doubtful class is cut by the tokenizers library."""
        if self.is_plain(text):
            return _PRETOKEN.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def runs(self, text: str | None, stretch: int = STRETCH) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of a text, stretch by stretch; a null text counts as empty."""
        for i, part in enumerate(self.specials.split(text or "") if self.specials else [text or ""]):
            if i % 2:
                yield self.special[part].to_bytes(4, "little")
                continue
            for piece in stretches(part, stretch):
                words = self.pretokens(piece)
                memo = self.memo
                ids = list(map(memo.__getitem__, words))
                if None in ids:
                    for k, word in enumerate(words):
                        if ids[k] is None:
                            ids[k] = memo[word]
                            if ids[k] is None:
                                ids[k] = pack(f"<{len(found := self.search(word))}I", *found)
                                if len(word) <= MEMO_CHARS:
                                    memo.add(word, ids[k])
                yield b"".join(ids)

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; ids outside the vocabulary have none."""
        if not len(ids):
            return b""
        inside = (ids >= 0) & (ids < len(self.bytes) - 1)
        return b"".join(self.bytes[np.where(inside, ids, len(self.bytes) - 1)].tolist())


#: Between two words of one space, a pre-token begins whatever is before and after.
_BETWEEN = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")


def stretches(text: str, stretch: int) -> Iterator[str]:
    """A text in parts of about ``stretch`` characters, cut where a pre-token begins; its whole if it has no such place."""
    at = 0
    while len(text) - at > stretch:
        cut = _BETWEEN.search(text, at + stretch)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    if at < len(text):
        yield text[at:] if at else text


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One a Python worker; its tables are bounded."""
    return ByteBpe(path)


def encode(text: str | None, bpe: ByteBpe) -> np.ndarray:
    """Ids of a whole text, as the tokenizers library gives them without special tokens added; a null or empty one has none."""
    return np.frombuffer(b"".join(bpe.runs(text)), "<u4")


def decode(ids: Iterable[int | None], bpe: ByteBpe) -> str:
    """The text, special tokens included; null ids and ids outside the vocabulary give nothing, bytes that are not UTF-8 U+FFFD."""
    return bpe.raw(np.array([i for i in ids if i is not None], np.int64)).decode("utf-8", "replace")


def _mapped(rows: DataFrame, column: str, as_col: str, kind: T.DataType, arrow: pa.DataType, path: str, one: Callable) -> DataFrame:
    """The input's columns and ``as_col``, made of each value of ``column`` by ``one``; it hides a column of its name."""
    keep = [c for c in rows.columns if c.lower() != as_col.lower()]
    if column not in keep:
        raise ValueError("the result may not replace the column that it is made of")
    at = keep.index(column)
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(as_col, kind)])

    def run(batches):
        bpe = tokenizer(path)
        for batch in slices(batches):
            made = [one(v, bpe) for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow)], names=[*keep, as_col])

    return rows.select(*[rows[c] for c in keep]).mapInArrow(run, schema)


def encode_column(docs: DataFrame, path: str, text_col: str = "text", as_col: str = "ids") -> DataFrame:
    """The input's columns and ``as_col``, an array of ids. A null or empty text has no ids; repeated rows get the same ids
    each; an empty table gives no rows. ``path``, a tokenizer file, must be readable on the executors."""
    return _mapped(docs, text_col, as_col, T.ArrayType(T.IntegerType()), pa.list_(pa.int32()), path, lambda t, b: encode(t, b).astype(np.int32))


def decode_column(rows: DataFrame, path: str, ids_col: str = "ids", as_col: str = "decoded") -> DataFrame:
    """The input's columns and ``as_col``, the text of the ids. A null or empty array gives an empty text; repeated rows
    get the same text each; an empty table gives no rows."""
    return _mapped(rows, ids_col, as_col, T.StringType(), pa.string(), path, lambda i, b: decode(i or (), b))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``ids_sha256`` (of the little-endian unsigned 32-bit ids) and
    ``decoded_sha256`` (of the text that the ids decode to).

    A null text counts as empty and has no ids. Repeated rows, null ids too, get the same result each. A very long text is
    encoded and decoded stretch by stretch. An empty table gives no rows.
    """
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    kinds = [docs.schema[id_col].dataType, T.LongType(), T.StringType(), T.StringType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def one(text: str | None, bpe: ByteBpe) -> tuple[int, str, str]:
        n, ids, decoded, rest = 0, hashlib.sha256(), hashlib.sha256(), b""
        for run in bpe.runs(text):
            n += len(run) // 4
            ids.update(run)
            rest += bpe.raw(np.frombuffer(run, "<u4"))
            whole = _whole(rest)
            decoded.update(rest[:whole].decode("utf-8", "replace").encode())
            rest = rest[whole:]
        decoded.update(rest.decode("utf-8", "replace").encode())
        return n, ids.hexdigest(), decoded.hexdigest()

    def run(batches):
        bpe = tokenizer(path)
        for batch in slices(batches):
            made = [one(t, bpe) for t in batch.column(1).to_pylist()]
            cols = [pa.array([m[k] for m in made], a) for k, a in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=names)

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, schema)


def _whole(raw: bytes) -> int:
    """Where the last character that may still go on begins: bytes before it decode alike with whatever follows."""
    for back in range(1, min(4, len(raw) + 1)):
        b = raw[-back]
        if b < 0x80:
            return len(raw)
        if b >= 0xC0:
            return len(raw) - back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else len(raw)
    return len(raw)
