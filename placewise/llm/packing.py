"""Best-fit packing of tokenised documents by length patterns and non-negative least squares.

1. Documents become ids and an end id, and pieces of at most ``CAPACITY`` tokens.
2. The histogram of piece lengths (at most ``CAPACITY`` numbers, whatever the corpus) goes to the driver.
   Patterns of one to ``PARTS`` pieces that fill a sequence exactly are enumerated, one for each length; repeat counts
   are fitted to the histogram by non-negative least squares, rounded and taken as far as there are pieces; what
   is left goes through further rounds, and at last, with a small reserve of short pieces, to best fit in
   decreasing length, again on counts. The plan's size depends on ``CAPACITY`` alone.
3. Pieces of one length are numbered: within (length, salt) by a window, plus the counts of earlier salts, so
   a hot length is numbered by many tasks. A piece's number finds its sequence and offset in the plan.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import Scratch, short_batches, slices

CAPACITY = 2048
END_ID = 0
MEMO = 400_000
MARK = "\x01"
WORDS_A_CALL = 500
SALTED_ROWS = 50_000
LEAST_SALTS = 256
PARTS = 8
NNLS_STEPS = 400
RESERVE = 25

#: A full stop or comma between an ASCII letter and white space is a pre-token of its own in these tokenizers.
_STOP = re.compile(r"(?<=[a-z])([.,])(?=[ \n])")


class WordTokenizer:
    """Ids of whole texts, by way of the ids of their words.

    A tokenizer that lower-cases, splits at white space and drops it never merges across it, so a text's ids are those
    of the pieces that spaces and line ends separate; those met before come from a table of bounded size. With a
    tokenizer file that says otherwise (``by_words`` false), whole texts are encoded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.mark = self._ids([MARK])[0]
        with open(path, encoding="utf-8") as f:
            self.by_words = self._splits_at_spaces(json.load(f)) and len(self.mark) == 1

    def _splits_at_spaces(self, said: dict) -> bool:
        """Whether the file's own rules, and a try of them, allow cutting at spaces and before stops."""
        parts = [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])]
        first = ((said.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        if parts != ["NFC", "Replace", "Lowercase"] or (first.get("type"), first.get("behavior"), first.get("invert")) != ("Split", "Removed", True):
            return False
        if r"[^\s\p{L}\p{N}]+" not in first["pattern"].get("Regex", ""):
            return False
        one, *cut = self._ids(["The end.\nOf, it", "the", "end", ".", "of", ",", "it"])
        return one == [i for ids in cut for i in ids]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Words of one call are told apart by a mark between them; those that contain it are encoded alone."""
        alone = [w for w in words if MARK in w]
        words = [w for w in words if MARK not in w]
        for at in range(0, len(words), WORDS_A_CALL):
            part = words[at : at + WORDS_A_CALL]
            ids = np.array(self._ids([f" {MARK} ".join(part)])[0] + self.mark, "<u4")
            ends = np.flatnonzero(ids == self.mark[0])
            data, begin = ids.tobytes(), 0
            for w, end in zip(part, ends.tolist(), strict=True):
                self.memo[w] = data[4 * begin : 4 * end]
                begin = end + 1
        for w, ids in zip(alone, self._ids(alone), strict=True):
            self.memo[w] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.by_words:
            return [np.array(ids, "<u4").tobytes() for ids in self._ids(texts)]
        words = []
        for t in texts:
            if t.isascii():
                t = t.lower()
            words.append(_STOP.sub(r" \1", t).replace("\n", " ").split(" "))
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
        new = list(set().union(*words).difference(memo))
        if new:
            self._learn(new)
        return [b"".join(map(memo.__getitem__, ws)) for ws in words]


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def pieces_of(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut at ``capacity``."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = _tokenizer(tokenizer_path)
        for batch in slices(batches):
            cols: list[list] = [[], [], [], [], []]
            for i, ids in zip(batch.column(0).to_pylist(), tok.encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    for col, v in zip(cols, (i, k, at, len(part) // 4, zlib.crc32(part)), strict=True):
                        col.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "piece", "start", "length", "ids_crc32"]
            )

    short_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")).mapInArrow(run, PIECES)


def patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of ``PARTS`` lengths (zero: none) that sum to ``capacity``: for each length that occurs, the one pattern of up
    to ``PARTS`` pieces, it among them, whose scarcest length has most pieces left (ties: fewer pieces).

    With one pattern for each length, the least-squares fit has no more unknowns than equations, so repeats are
    not spread over patterns that could stand for each other.
    """
    have = hist.astype(np.int64).copy()
    have[0] = 0
    lengths = np.flatnonzero(have).tolist()
    # For each sum, of the best k pieces with that sum: how many the scarcest length has, and one of the lengths.
    most, one = [have], [np.arange(capacity + 1)]
    for _ in range(2, PARTS):
        m, c = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        for x in lengths:
            with_x = np.minimum(have[x], most[-1][: capacity + 1 - x])
            better = with_x > m[x:]
            c[x:][better] = x
            m[x:][better] = with_x[better]
        most.append(m)
        one.append(c)
    best = np.argmax(most, axis=0)  # the first of equals
    rows = set()
    for a in lengths:
        row, rest = [a], capacity - a
        if rest:
            k = int(best[rest])
            if not most[k][rest]:
                continue
            for j in range(k, -1, -1):
                row.append(int(one[j][rest]))
                rest -= row[-1]
        rows.add(tuple(sorted(row, reverse=True)) + (0,) * (PARTS - len(row)))
    return np.array(sorted(rows, reverse=True), np.int64).reshape(-1, PARTS)


def fit_repeats(rows: np.ndarray, hist: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """Non-negative x for the least |A x - hist|, by accelerated projected gradient steps until they stand still."""
    if not len(rows):
        return np.empty(0)
    h = hist.astype(float).copy()
    h[0] = 0
    size = len(hist)

    def forward(x):
        y = np.bincount(rows.ravel(), weights=np.repeat(x, rows.shape[1]), minlength=size)
        y[0] = 0
        return y

    adjoint = lambda y: y[rows].sum(axis=1)
    v = np.ones(len(rows))
    for _ in range(30):
        v = adjoint(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = z = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(z - adjoint(forward(z) - h) / (1.05 * top), 0)
        if (z - new) @ (new - x) > 0:  # momentum against the descent: begin it anew
            t = 1.0
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z = new + (t - 1) / after * (new - x)
        still = np.abs(new - x).max() < 1e-3
        x, t = new, after
        if still:
            break
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)`` whose lengths use up the histogram exactly; patterns first, then best fit."""
    by_patterns, left = pattern_plan(hist, capacity)
    return by_patterns + best_fit(left, capacity)


def pattern_plan(hist: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """The part of the plan made of full patterns, and what it leaves of the histogram.

    Each round enumerates patterns of what is left, fits their repeats, rounds them and takes them as far as there
    are pieces; rounds go on while they place a hundredth of what is left. One in ``RESERVE`` of the pieces under a
    quarter of the capacity is kept back for best fit, which needs short pieces to fill up what patterns leave.
    """
    left = hist.astype(np.int64).copy()
    left[0] = 0
    kept = left // RESERVE
    kept[capacity // 4 :] = 0
    left -= kept
    out: list[tuple[tuple[int, ...], int]] = []
    while True:
        rows = patterns(left, capacity)
        repeats = np.rint(fit_repeats(rows, left)).astype(np.int64)
        before = left.sum()
        for k in np.argsort(-repeats, kind="stable"):
            if not repeats[k]:
                break
            lengths, need = np.unique(rows[k][rows[k] > 0], return_counts=True)
            n = int(min(repeats[k], (left[lengths] // need).min()))
            if n > 0:
                left[lengths] -= need * n
                out.append((tuple(int(v) for v in rows[k] if v), n))
        if (before - left.sum()) * 100 < before or not left.any():
            return out, left + kept


def best_fit(hist: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing length, on counts: groups of sequences with equal contents, by the room that they have."""
    left = hist.astype(np.int64)
    room: dict[int, list[list]] = {}
    open_rooms = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(open_rooms[length:])
            if len(fits):
                r = int(fits[0]) + length
                group = room[r][-1]
                use = min(n, group[1])
                lengths = group[0] + (length,)
                group[1] -= use
                if not group[1]:
                    room[r].pop()
                    open_rooms[r] = bool(room[r])
            else:  # new sequences, each with as many of this length as fit
                r, per = capacity, min(n, capacity // length)
                use, lengths = n // per, (length,) * per
            n -= use * (len(lengths) - len(group[0]) if len(fits) else len(lengths))
            rest = r - length * (1 if len(fits) else len(lengths))
            room.setdefault(rest, []).append([lengths, use])
            open_rooms[rest] = rest > 0
    return [(g[0], g[1]) for groups in room.values() for g in groups if g[1]]


def _slots(steps: list[tuple[tuple[int, ...], int]], capacity: int):
    """Sorted arrays: the first number of each run of a length's pieces, its first sequence, its offset."""
    used = np.zeros(capacity + 1, np.int64)
    first, sequence, offset, base = [], [], [], 0
    for lengths, n in steps:
        at = 0
        for length in lengths:
            first.append((length << 44) + used[length])
            sequence.append(base)
            offset.append(at)
            used[length] += n
            at += length
        base += n
    order = np.argsort(first)
    return tuple(np.array(a, np.int64)[order] for a in (first, sequence, offset))


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A null or empty text is one piece of the end id alone. Rows that repeat an id are packed each. A null id
    stays null. An empty table gives no rows. Ids must be integers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.cut(pieces_of(docs, tokenizer_path, id_col, text_col, capacity), "pieces")
    counts = pieces.groupBy("length").count().collect()  # at most one row per length
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts:
        hist[r["length"]] = r["count"]
    slots = spark.sparkContext.broadcast(_slots(plan(hist, capacity), capacity))

    salts = max(LEAST_SALTS, int(hist.sum()) // SALTED_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = (
        salted.groupBy("length", "salt").count()
        .withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count"))
        .select("length", "salt", "base")
    )
    own = Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32")
    numbered = salted.withColumn("n", F.row_number().over(own)).join(before, ["length", "salt"])

    def place(batches):
        first, sequence, offset = slots.value
        for b in batches:
            number = b.column("n").to_numpy()
            key = (b.column("length").to_numpy() << 44) + number
            k = np.searchsorted(first, key, side="right") - 1
            arrays = [b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")]
            arrays += [pa.array(sequence[k] + key - first[k]), pa.array(offset[k])]
            yield pa.RecordBatch.from_arrays(
                arrays, names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    numbered = numbered.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("n") - 1).alias("n"))
    return numbered.mapInArrow(place, PIECES + ", sequence_id long, offset long").withColumnRenamed("id", id_col)
