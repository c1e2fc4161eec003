"""SentencePiece encoding by streaming Viterbi, decoding, and token counts by trie-shared dynamic programming.

Encoding finds the segmentation of the highest total piece score (ties: the shortest last piece, from right
to left). The search keeps a window bounded by the longest piece: a position only looks back that far, and
whenever all positions from which a piece can still grow trace back to one boundary, the ids up to it are
committed and forgotten (a look for that is taken every piece length). Characters without a piece become their UTF-8 bytes where the model has byte pieces.

The scores are the model file's own. A model of the BPE type stores merge ranks there, so its ids are the
best-scoring segmentation of its vocabulary, not those of its merge procedure; decoding gives the text back.

Counting inserts the distinct pre-tokens (a text cut where no piece goes on) of a batch in a trie and
computes the forward scores once per shared prefix; a terminal holds its number of tokens.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._shared import slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words known to a worker, at most: half of them met lately, half before.
MEMO = 1_200_000
TRIE_NODES = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field numbers and values of one serialised protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value: bytes | int = number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Recent(dict):
    """The last of up to ``most`` words with their values, in two halves: a full younger half replaces the older, and
    a word found in the older one moves to the younger, so that frequent words stay."""

    def __init__(self, most: int):
        super().__init__()
        self.half = most // 2
        self.older: dict = {}

    def __missing__(self, word):
        value = self.older.get(word)
        if value is not None:
            self.add(word, value)
        return value

    def add(self, word, value) -> None:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[word] = value


class Vocabulary:
    """Pieces with their ids and scores, read from a model file."""

    def __init__(self, path: str):
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: list[int] = [-1] * 256
        self.text: list[str] = []
        self.kind: list[int] = []
        self.unknown = 0
        with open(path, "rb") as f:
            model = f.read()
        normal: list[float] = []
        user: list[str] = []
        for field, value in _fields(model):
            if field != 1:
                continue
            piece, score, kind = "", 0.0, NORMAL
            for f, v in _fields(value):
                if f == 1:
                    piece = v.decode()
                elif f == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif f == 3:
                    kind = v
            i = len(self.text)
            self.text.append(piece)
            self.kind.append(kind)
            if kind == NORMAL:
                self.pieces[piece] = (i, score)
                normal.append(score)
            elif kind == USER:
                user.append(piece)
                self.pieces[piece] = (i, 0.0)
            elif kind == UNKNOWN:
                self.unknown = i
            elif kind == BYTE:
                self.bytes[int(piece[3:5], 16)] = i
        top, low = max(normal, default=0.0), min(normal, default=0.0)
        for piece in user:  # as the format defines it: a piece of the user's outweighs what it covers
            self.pieces[piece] = (self.pieces[piece][0], len(piece) * top - 0.1)
        self.unknown_score = low - 10.0
        self.longest = max(map(len, self.pieces), default=1)
        #: Nodes of the pieces' trie: children by character, id (-1: no piece ends here), score.
        self.root: tuple = ({}, -1, 0.0)
        for piece in sorted(self.pieces):
            node = self.root
            for char in piece[:-1]:
                node = node[0].setdefault(char, ({}, -1, 0.0))
            i, score = self.pieces[piece]
            old = node[0].get(piece[-1], ({},))
            node[0][piece[-1]] = (old[0], i, score)
        #: What an id stands for by itself; byte pieces only do together.
        self.plain = {i: {UNKNOWN: " ⁇ ", CONTROL: ""}.get(k, self.text[i]) for i, k in enumerate(self.kind) if k != BYTE}
        self.has_bytes = min(self.bytes) >= 0
        self.memo: Recent = Recent(MEMO)
        inner = {p for p in self.pieces if MARK in p.lstrip(MARK)}
        self.splits_at_marks = not inner  # no piece goes on past a mark after other characters
        pairs = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        letters = [c for c in "abcdefghijklmnopqrstuvwxyz" if c + "." not in pairs and c + "," not in pairs]
        #: Before a stop or comma after these letters no piece goes on either, nor on any side of a line end.
        self.stop = re.compile(f"(?<=[{''.join(letters)}])([.,])") if letters else None
        self.splits_at_lines = not any("\n" in p for p in self.pieces)

    def one(self, char: str) -> list[int]:
        """A character without a piece."""
        return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if self.has_bytes else [self.unknown]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def normalised(text: str) -> str:
    """Identity normalisation with a dummy prefix; spaces become marks."""
    return (MARK + text.replace(" ", MARK)) if text else ""


def stream_encode(
    chars: Iterable[str], vocab: Vocabulary, on_window: Callable[[int], None] | None = None, on_scores: Callable[[int], None] | None = None
) -> Iterator[list[int]]:
    """Ids in committed runs.

    Scores are held for the last ``longest`` positions alone; only back pointers, two numbers a character, wait until the
    paths meet. ``on_window`` gets the number of characters since the last boundary at each step, ``on_scores`` that of scores held.
    """
    root, unknown, longest = vocab.root, vocab.unknown_score, vocab.longest
    most, watched = 4 * longest, on_window or on_scores
    best: list[float] = [0.0]  # scores of the positions from ``first`` on
    first = origin = 0  # ``origin`` is the last boundary
    begins = array("q", [0])  # at each position from ``origin`` on, where its last piece begins ...
    pieces = array("q", [0])  # ... and its id, or for a character without a piece -1 less its code point
    growing: list[tuple[int, tuple]] = []  # where pieces that may still grow begin, and their trie nodes

    def ids(upto: int) -> list[int]:
        out: list[int] = []
        while upto > origin:
            i = pieces[upto - origin]
            out.extend([i] if i >= 0 else reversed(vocab.one(chr(-1 - i))))
            upto = begins[upto - origin]
        out.reverse()
        return out

    n, again = 0, longest
    for char in chars:
        score, last, piece = best[-1] + unknown, n, -1
        growing.append((n, root))
        still = []
        for begin, node in growing:
            child = node[0].get(char)
            if child is not None:
                if child[0]:
                    still.append((begin, child))
                if child[1] >= 0 and best[begin - first] + child[2] >= score:
                    score, last, piece = best[begin - first] + child[2], begin, child[1]
        growing = still
        best.append(score)
        begins.append(last)
        pieces.append(piece if piece >= 0 else -1 - ord(char))
        n += 1
        if n - first > most:
            del best[: n - longest - first]
            first = n - longest
        if watched:
            if on_window:
                on_window(n - origin)
            if on_scores:
                on_scores(len(best))
        if n < again or growing and growing[0][0] == origin:
            continue
        # A later piece begins here or where one may still grow: step those paths back until all are one. The next look
        # is a piece's length on, or an eighth of the characters held, so looks cost about a step a character in all texts.
        paths = {n, *(begin for begin, _ in growing)}
        while len(paths) > 1:
            far = max(paths)
            paths.remove(far)
            paths.add(begins[far - origin])
        meet = paths.pop()
        if meet > origin:
            yield ids(meet)
            del begins[: meet - origin], pieces[: meet - origin]
            origin = meet
        again = n + max(longest, (n - origin) // 8)
    if n > origin:
        yield ids(n)


def cut_words(text: str) -> list[str]:
    """Pre-tokens: a text cut before each run of marks."""
    parts = text.split(MARK)
    if len(parts) == 1:
        return [text] if text else []
    out = [parts[0]] if parts[0] else []
    run = 1
    for p in parts[1:-1]:
        if p:
            out.append(MARK * run + p)
            run = 1
        else:
            run += 1
    out.append(MARK * run + parts[-1])
    return out


CUT = "\ue000"
_SPACE = re.compile("(?<! ) ")


def pretokens(text: str | None, vocab: Vocabulary) -> list[str]:
    """A normalised text, cut where no piece goes on: before runs of marks, before stops, at line ends."""
    if not text:
        return []
    if CUT in text or MARK in text or text[0] == " " or not (vocab.stop and vocab.splits_at_lines):
        return cut_words(normalised(text))
    text = vocab.stop.sub(CUT + r"\1", text).replace("\n", CUT + "\n" + CUT)
    text = _SPACE.sub(CUT + " ", text) if "  " in text else text.replace(" ", CUT + " ")
    return (MARK + text.replace(" ", MARK)).split(CUT)


def encode(text: str | None, vocab: Vocabulary) -> list[int]:
    """Ids of a whole text; a null or empty one has none.

    All paths meet where no piece goes on, so the search of a pre-token depends on nothing around it; those met
    before come from a table of bounded size.
    """
    if not vocab.splits_at_marks:
        return [i for run in stream_encode(normalised(text or ""), vocab) for i in run]
    memo, out = vocab.memo, []
    for word in pretokens(text, vocab):
        ids = memo[word]
        if ids is None:
            ids = tuple(i for run in stream_encode(word, vocab) for i in run)
            if len(word) <= 64:
                memo.add(word, ids)
        out += ids
    return out


def decode(ids: Iterable[int], vocab: Vocabulary) -> str:
    """The text; control pieces and null ids give nothing, bytes that are not UTF-8 and ids outside the vocabulary U+FFFD."""
    ids = list(ids)
    parts = list(map(vocab.plain.get, ids))
    text = "".join(_odd(ids, vocab) if None in parts else parts).replace(MARK, " ")
    return text[1:] if text[:1] == " " else text


def _odd(ids: list[int | None], vocab: Vocabulary) -> list[str]:
    """The parts of a text with byte pieces, or with ids that are null or outside the vocabulary."""
    out: list[str] = []
    raw = bytearray()
    for i in ids:
        if i is None:
            continue
        if not 0 <= i < len(vocab.text):
            out += [raw.decode("utf-8", "replace"), "\ufffd"]
            raw.clear()
            continue
        if vocab.kind[i] == BYTE:
            raw.append(int(vocab.text[i][3:5], 16))
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        out.append(vocab.plain[i])
    out.append(raw.decode("utf-8", "replace"))
    return out


def encode_column(docs: DataFrame, model_path: str, text_col: str = "text", as_col: str = "ids") -> DataFrame:
    """The input's columns and ``as_col``, an array of ids (which hides a column of its name).

    A null or empty text has no ids. Repeated rows get the same ids each; an empty table gives no rows. ``model_path`` must be
    readable on the executors.
    """
    keep = [c for c in docs.columns if c.lower() != as_col.lower()]
    at = keep.index(text_col)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(as_col, T.ArrayType(T.IntegerType()))])

    def run(batches):
        vocab = vocabulary(model_path)
        for batch in slices(batches):
            ids = [encode(t, vocab) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*keep, as_col])

    return docs.select(*[docs[c] for c in keep]).mapInArrow(run, schema)


def decode_column(rows: DataFrame, model_path: str, ids_col: str = "ids", as_col: str = "decoded") -> DataFrame:
    """The input's columns and ``as_col``, the decoded text; a null or empty array gives an empty text. Repeated rows get
    the same text each; an empty table gives no rows."""
    keep = [c for c in rows.columns if c.lower() != as_col.lower()]
    at = keep.index(ids_col)
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(as_col, T.StringType())])

    def run(batches):
        vocab = vocabulary(model_path)
        for batch in slices(batches):
            texts = [decode(i or (), vocab) for i in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*keep, as_col])

    return rows.select(*[rows[c] for c in keep]).mapInArrow(run, schema)


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_ids``, ``ids_crc32`` (little-endian unsigned 32-bit ids), ``exact`` (decoding
    gives the text back). A null text counts as empty. Repeated rows get the same result each; an empty table gives none."""

    def run(batches):
        vocab = vocabulary(model_path)
        for batch in slices(batches):
            n, crc, exact = [], [], []
            for text in batch.column(1).to_pylist():
                ids = encode(text, vocab)
                n.append(len(ids))
                crc.append(zlib.crc32(np.array(ids, "<u4").tobytes()))
                exact.append(decode(ids, vocab) == (text or ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(exact)],
                names=["id", "n_ids", "ids_crc32", "exact"],
            )

    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_ids", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
            T.StructField("exact", T.BooleanType()),
        ]
    )

    def named(batches):
        for b in run(batches):
            yield b.rename_columns([id_col, "n_ids", "ids_crc32", "exact"])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(named, schema)


class CountingTrie:
    """Pre-tokens with the forward score of each prefix, computed when its node is made.

    A node holds its children, the best score and the number of tokens of its prefix, and the pieces that may
    still grow at its end with the score and the number of tokens before each. A trie of ``TRIE_NODES`` takes no more
    nodes: the rest of a pre-token goes on from node to node without keeping them, and the next one starts a new trie.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.counts: Recent = Recent(MEMO)
        self.root: tuple = ({}, 0.0, 0, ())
        self.nodes = 1

    def insert(self, word: str) -> int:
        """Add a distinct pre-token; prefixes that others made are not computed again."""
        vocab, node = self.vocab, self.root
        for char in word:
            child = node[0].get(char)
            if child is None:
                score, tokens, still = node[1] + vocab.unknown_score, -1, []
                for before, k, piece in (*node[3], (node[1], node[2], vocab.root)):
                    longer = piece[0].get(char)
                    if longer is not None:
                        if longer[0]:
                            still.append((before, k, longer))
                        if longer[1] >= 0 and before + longer[2] >= score:
                            score, tokens = before + longer[2], k + 1
                if tokens < 0:
                    tokens = node[2] + len(vocab.one(char))
                child = ({}, score, tokens, tuple(still))
                if self.nodes < TRIE_NODES:
                    node[0][char] = child
                    self.nodes += 1
            node = child
        return node[2]

    def tokens(self, word: str) -> int:
        """The terminal count of a pre-token; a full trie starts anew."""
        n = self.counts[word]
        if n is None:
            if self.nodes >= TRIE_NODES:
                self.root, self.nodes = ({}, 0.0, 0, ()), 1
            n = self.insert(word)
            if len(word) <= 64:
                self.counts.add(word, n)
        return n


@lru_cache(maxsize=2)
def _trie(path: str) -> CountingTrie:
    """One trie per Python worker; its size is bounded."""
    return CountingTrie(vocabulary(path))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_tokens`` and ``n_pretokens`` of its whole text; zero for null or empty texts.
    Repeated rows get the same result each; an empty table gives none.

    The trie lives in the task that reads the texts, so nothing is shuffled. Needs a vocabulary whose pieces do
    not go on past a mark.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_pretokens", T.LongType()),
        ]
    )

    def run(batches):
        trie = _trie(model_path)
        if not trie.vocab.splits_at_marks:
            raise ValueError("pieces of this vocabulary span pre-tokens")
        for batch in slices(batches):
            words = [pretokens(t, trie.vocab) for t in batch.column(1).to_pylist()]
            new = set().union(*words) if words else set()
            collects = gc.isenabled()
            gc.disable()  # the trie has no cycles: while it grows, the collector would only walk its nodes
            try:
                for word in new:
                    trie.tokens(word)
            finally:
                if collects:
                    gc.enable()
            n = []
            for ws in words:
                known, total = trie.counts, 0
                for w in ws:
                    k = known[w]
                    total += trie.tokens(w) if k is None else k
                n.append(total)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([sum(map(bool, w)) for w in words], pa.int64())],
                names=[id_col, "n_tokens", "n_pretokens"],
            )

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, schema)
