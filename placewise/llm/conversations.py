"""Conversation structure repair by alignment with the alternating grammar ``(s?(ua)+)?``.

A conversation's turns are aligned, by Wagner and Fischer's table, with each feasible length of the grammar's string.
Targets of all lengths end alike, so one table over (turns left, characters left) holds the alignment with
each of them; Ukkonen's band leaves out the cells that cannot lie on a path as cheap as the incumbent, a plain repair
made beforehand. Each length of the least cost is traced back to its least audit, and the audits are compared.

Turns are put in order by a range partition, so a conversation of any size is dealt over many tasks. One that ends within
a task is repaired there. Of the others, tasks hold stretches of at most ``STRETCH_ROWS`` turns: a stretch is aligned for
each phase of the grammar that it may begin and end in (nothing yet, after the system turn, after a user, after
an assistant), one short row a stretch finds the cheapest way through, and texts meet in order once, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Scratch, join_keyed, slices

#: What edits cost, and what is added for a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
NEVER = 1 << 40
STRETCH_ROWS = 256
STRETCH_CHARS = 1 << 20
WORD = r"[^\x20\x09-\x0D]"

# A turn is one letter: s, u, a or x (another role), upper-case if truncated, - if it must be deleted (blank or duplicate).
# Phases of the grammar: B nothing yet, S after the system turn, U after a user, A after an assistant.
PHASES = "BSUA"
ENDS = {"B": (0, ""), "S": (2 * INSERT, "II"), "U": (INSERT, "I"), "A": (0, "")}  # what completes the string from a phase


def _costs(turn: str, role: str) -> int:
    """Of keeping a turn as ``role``, or making it so."""
    if turn == "-":
        return NEVER
    return (KEEP if turn.lower() == role else REROLE) + (TRUNCATED if turn.isupper() else 0)


def _keeps_system(turn: str) -> int:
    return _costs(turn, "s") if turn in "sS" else NEVER


class Table:
    """Costs of aligning the turns from i on with the last r characters of a target that ends in ``last`` (u or a).

    ``rest[i][r]`` is for targets without a system turn from there on, ``system[i][r]`` for those that still begin with
    one. Cells whose path must cost more than ``limit`` are left out: with n - i turns left and r characters, at least
    the difference is inserted or deleted. Insertions after the last turn are made only if ``open_end``.
    """

    def __init__(self, turns: str, last: str, limit: int, open_end: bool):
        n = len(turns)
        self.turns, self.roles = turns, (last, "u" if last == "a" else "a")  # of odd and even r
        self.width = n + limit // INSERT + 2
        steps = INSERT * np.arange(self.width, dtype=np.int64)
        row = np.full(self.width, NEVER)
        row[0] = 0
        if open_end:
            most = min(self.width, limit // INSERT + 1)
            row[:most] = steps[:most]
        gone = np.full(self.width, NEVER)
        self.rest, self.system = [row], [gone]
        for i in range(n - 1, -1, -1):
            low, high = max(n - i - limit // DELETE, 0), min(n - i + limit // INSERT, self.width - 1)
            turn, after = turns[i], self.rest[-1]
            row = np.full(self.width, NEVER)
            cells = after[low : high + 1] + DELETE
            if turn != "-":
                first = max(low, 1)
                stay = after[first - 1 : high].copy()
                odd = first % 2
                stay[1 - odd :: 2] += _costs(turn, self.roles[0])
                stay[odd::2] += _costs(turn, self.roles[1])
                cells[first - low :] = np.minimum(cells[first - low :], stay)
            cells = np.minimum.accumulate(cells - steps[low : high + 1]) + steps[low : high + 1]
            row[low : high + 1] = np.minimum(cells, NEVER)
            keeps = _keeps_system(turn)
            self.system.append(np.minimum(np.minimum(self.system[-1] + DELETE, after + keeps), NEVER))
            self.rest.append(row)
        self.rest.reverse()
        self.system.reverse()

    def audit(self, r: int, system: bool) -> str:
        """The least audit among the cheapest alignments with a target of r characters (and a system turn before)."""
        out, i, n = [], 0, len(self.turns)
        while i < n or r or system:
            have = (self.system if system else self.rest)[i][r]
            if i < n and (self.system if system else self.rest)[i + 1][r] + DELETE == have:
                out.append("D")
                i += 1
            elif system:
                out.append("K")
                i += 1
                system = False
            elif r and self.rest[i][r - 1] + INSERT == have:
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.turns[i].lower() == self.roles[1 - r % 2] else "R")
                i += 1
                r -= 1
        return "".join(out)

    def best(self, first: int, system: bool, step: int = 2) -> tuple[int, str] | None:
        """Cost and audit of the cheapest of the targets of ``first``, ``first + step``, ... characters; ties: the least audit."""
        costs = (self.system if system else self.rest)[0][first::step]
        if not len(costs) or costs.min() >= NEVER:
            return None
        least = int(costs.min())
        return least, min(self.audit(first + step * int(k), system) for k in np.flatnonzero(costs == least))


def _incumbent(turns: str, phase: str) -> tuple[int, str]:
    """What a plain repair costs that keeps or reroles all usable turns, and the phase it ends in."""
    cost = 0
    for t in turns:
        if t == "-":
            cost += DELETE
        elif phase == "B" and t in "sS":
            cost, phase = cost + _keeps_system(t), "S"
        else:
            role = "a" if phase == "U" else "u"
            cost, phase = cost + _costs(t, role), role.upper()
    return cost, phase


@lru_cache(maxsize=1 << 14)
def repair_whole(turns: str) -> tuple[int, str]:
    """Cost and least audit of a whole conversation."""
    cost, phase = _incumbent(turns, "B")
    gone = DELETE * len(turns)
    table = Table(turns, "a", min(gone, cost + ENDS[phase][0]), open_end=True)
    found = [(gone, "D" * len(turns)), table.best(2, False), table.best(2, True)]
    return min(f for f in found if f)


def ways(turns: str) -> dict[tuple[str, str], tuple[int, str]]:
    """Cost and least audit of a stretch for each phase that it can begin and end in, nothing inserted after its last turn."""
    n, out = len(turns), {}
    limit = max(min(_incumbent(turns, p)[0], DELETE * n) for p in PHASES) + 2 * INSERT
    for last in "au":
        table, end = Table(turns, last, limit, open_end=False), last.upper()
        for begin in PHASES:
            first = (2 if last == "a" else 1) if begin in "BS" else int(begin != end)
            found = [table.best(first, False)]
            if begin == "B":
                found.append(table.best(first, True))
            found = [f for f in found if f]
            if found:
                out[begin, end] = min(found)
    out["B", "B"] = out["S", "S"] = (DELETE * n, "D" * n)
    system = table.best(0, True, table.width)
    if system:
        out["B", "S"] = system
    return out


def through(stretches: list[dict]) -> tuple[list[tuple[str, int, str]], str]:
    """Phase, cost and audit of each stretch on the cheapest way through all (ties: the least audit), and the phase at the end."""
    after = [{p: c for p, (c, _) in ENDS.items()}]
    for s in reversed(stretches):
        ahead: dict[str, int] = {}
        for (begin, end), (cost, _) in s.items():
            if end in after[-1]:
                ahead[begin] = min(ahead.get(begin, NEVER), cost + after[-1][end])
        after.append(ahead)
    after.reverse()
    out, phase = [], "B"
    for s, here, ahead in zip(stretches, after, after[1:], strict=False):
        # No audit of a stretch begins another's: each ends with its last turn. So the first difference decides.
        audit, cost, end = min((a, c, e) for (b, e), (c, a) in s.items() if b == phase and c + ahead.get(e, NEVER) == here[phase])
        out.append((phase, cost, audit))
        phase = end
    return out, phase


def _rebuild(audit: str, phase: str, rows) -> tuple[list[str], str]:
    """The ``role:text`` of what an audit leaves of rows (role, text), begun in ``phase``, and the phase after it."""
    out, rows = [], iter(rows)
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "K" and phase == "B" and role[:1] == "s":
            phase = "S"
        else:
            wanted = "assistant" if phase == "U" else "user"
            role = role if edit == "K" else wanted
            phase = "A" if wanted == "assistant" else "U"
        out.append(f"{role}:{text}")
    return out, phase


def _illegal(initials: str) -> int:
    return sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
_LONG, _TEXT = T.LongType(), T.StringType()
_KINDS = [_LONG] * 6 + [_TEXT] * 2


def _conversation_fields(kind: T.DataType, name: str) -> list[T.StructField]:
    return [T.StructField(name, kind), *[T.StructField(n, k) for n, k in zip(RESULT, _KINDS, strict=True)]]


class Stretch:
    """Turns of one conversation that follow each other, as they come."""

    def __init__(self, conv):
        self.conv = conv
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.marks: list[str] = []  # the letters of turns, - for blank ones
        self.turns: list[int | None] = []
        self.chars = 0

    def add(self, turn, role, text, blank, cut) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        self.marks.append("-" if blank else initial.upper() if cut else initial)
        self.chars += len(text)

    def full(self, rows: int, chars: int) -> bool:
        return len(self.roles) >= rows or self.chars >= chars

    def initials(self) -> str:
        return "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r in self.roles)

    def span(self) -> tuple[int | None, int | None, int]:
        """Least and largest turn and how many there are."""
        known = {t for t in self.turns if t is not None}
        return (min(known), max(known), len(known)) if known else (None, None, 0)

    def whole(self) -> tuple:
        """The result columns of a conversation that is this stretch."""
        seen, marks, duplicate = set(), [], 0
        for row, m in zip(zip(self.roles, self.texts, strict=True), self.marks, strict=True):
            again = m != "-" and row in seen
            duplicate += again
            seen.add(row)
            marks.append("-" if again else m)
        low, high, distinct = self.span()
        cost, audit = repair_whole("".join(marks))
        repaired, _ = _rebuild(audit, "B", zip(self.roles, self.texts, strict=True))
        return (
            high - low + 1 - distinct if distinct else 0, self.marks.count("-"), duplicate, sum(m.isupper() for m in marks),
            _illegal(self.initials()), cost, audit, "\n".join(repaired),
        )

    def digests(self) -> list[str]:
        """What tells (conversation, role, text) apart, for turns of several stretches."""
        key = lambda r, t: hashlib.sha256(f"{self.conv!r}|{len(r)}|{r}{t}".encode("utf-8", "surrogatepass")).hexdigest()
        return [key(r, t) for r, t in zip(self.roles, self.texts, strict=True)]


def _in_order(rows: DataFrame, conv: str, turn: str, role: str, text: str, present: Column | None) -> DataFrame:
    """Turns in order, dealt over tasks by range; rows that are not present only name their conversation."""
    said, who = F.coalesce(rows[text].cast("string"), F.lit(" ")), F.coalesce(rows[role].cast("string"), F.lit(" "))
    rows = rows.select(
        rows[conv].alias("conv"), rows[turn].cast("long").alias("turn"), who.alias("role"), said.alias("text"),
        (present if present is not None else F.lit(True)).alias("present"),
    )
    tail = F.rtrim(F.translate("text", "\t\n\u000b\u000c\r", "     "))
    rows = rows.select(
        "*", (F.length(tail) == 0).alias("blank"), (~F.substring(tail, -1, 1).isin(".", "!", "?")).alias("cut"),
        F.substring("role", 1, 16).alias("o1"), F.substring("text", 1, 64).alias("o2"), F.xxhash64("role", "text").alias("o3"), F.monotonically_increasing_id().alias("o4"),
    )
    order = ["conv", "turn", "o1", "o2", "o3", "o4"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("o1", "o2", "o3", "o4")


def _stretched(ordered: DataFrame, stretch_rows: int, stretch_chars: int) -> DataFrame:
    """One row per conversation that a task saw whole (``part`` is null), with its result, or per stretch of another."""
    conv = ordered.schema["conv"].dataType
    fields = _conversation_fields(conv, "conv") + [
        T.StructField("part", T.IntegerType()), T.StructField("no", T.IntegerType()), T.StructField("marks", _TEXT), T.StructField("initials", _TEXT),
        T.StructField("low", _LONG), T.StructField("high", _LONG), T.StructField("distinct", _LONG),
        T.StructField("roles", T.ArrayType(_TEXT)), T.StructField("texts", T.ArrayType(_TEXT)), T.StructField("digests", T.ArrayType(_TEXT)),
    ]
    schema = T.StructType(fields)
    texts = pa.list_(pa.string())
    kinds = [*[pa.int64()] * 6, *[pa.string()] * 2, pa.int32(), pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 3, texts, texts, texts]
    empty = (None,) * len(RESULT)

    def walk(batches) -> Iterator[tuple]:
        part, now, no, first = TaskContext.get().partitionId(), None, 0, True  # the first conversation may have begun elsewhere

        def cut(s: Stretch) -> tuple:
            return (s.conv, *empty, part, no, "".join(s.marks), s.initials(), *s.span(), s.roles, s.texts, s.digests())

        split = True
        for batch in batches:
            for conv_id, turn, role, text, present, blank, short in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if now is None or now.conv != conv_id:
                    if now is not None:
                        yield cut(now) if split else (now.conv, *now.whole(), *(None,) * 10)
                        no += 1
                    split, first = first, False
                    now = Stretch(conv_id)
                elif now.full(stretch_rows, stretch_chars):
                    yield cut(now)
                    no += 1
                    split = True
                    now = Stretch(conv_id)
                if present:
                    now.add(turn, role, text, blank, short)
        if now is not None:  # the last one may go on elsewhere
            yield cut(now)

    def run(batches):
        names, kind, held, size = schema.names, None, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate([kind, *kinds])], names=names)

        def watched():
            nonlocal kind
            for b in slices(batches):
                kind = b.schema.field(0).type
                yield b

        for row in walk(watched()):
            held.append(row)
            size += len(row[8] or "") + sum(map(len, row[17] or ()))
            if len(held) >= 512 or size > stretch_chars:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return ordered.mapInArrow(run, schema)


def _with_ways(nodes: DataFrame) -> DataFrame:
    """Stretches, their duplicates marked, with the cost and audit of each way through them."""
    schema = T.StructType([*nodes.schema.fields, T.StructField("keys", T.ArrayType(_TEXT)), T.StructField("costs", T.ArrayType(_LONG)), T.StructField("audits", T.ArrayType(_TEXT))])
    marks, again = nodes.columns.index("marks"), nodes.columns.index("again")

    def run(batches):
        for batch in slices(batches):
            keys, costs, audits, marked = [], [], [], []
            for m, dup in zip(batch.column(marks).to_pylist(), batch.column(again).to_pylist(), strict=True):
                m = list(m)
                for i in dup or ():
                    m[i] = "-"
                marked.append("".join(m))
                found = ways(marked[-1])
                keys.append(["".join(k) for k in found])
                costs.append([c for c, _ in found.values()])
                audits.append([a for _, a in found.values()])
            columns = list(batch.columns)
            columns[marks] = pa.array(marked, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(keys, pa.list_(pa.string())), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], names=schema.names
            )

    return nodes.mapInArrow(run, schema)


def _grouped(batches, at: int) -> Iterator[list[dict]]:
    """Rows of sorted batches by runs of equal column ``at``."""
    held: list[dict] = []
    for batch in slices(batches):
        name = batch.schema.names[at]
        for row in batch.to_pylist():
            if held and held[-1][name] != row[name]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _decided(found: DataFrame) -> DataFrame:
    """For each stretch the phase it begins in, its cost and audit, and what the last of a conversation adds.

    A conversation's stretches, a short row each, meet in one task: its transcript is one value, so they are at most its
    2 GB by ``STRETCH_ROWS`` turns.
    """
    kind = found.schema["conv"].dataType
    extra = [T.StructField("phase", _TEXT), T.StructField("spent", _LONG), T.StructField("edits", _TEXT), T.StructField("ending", _TEXT)]
    schema = T.StructType([T.StructField("conv", kind), T.StructField("part", T.IntegerType()), T.StructField("no", T.IntegerType()), *extra])

    def run(batches):
        arrow = None

        def watched():
            nonlocal arrow
            for b in batches:
                arrow = b.schema.field(0).type
                yield b

        for group in _grouped(watched(), 0):
            choice, end = through([{(k[0], k[1]): (c, a) for k, c, a in zip(g["keys"], g["costs"], g["audits"], strict=True)} for g in group])
            last = [None] * (len(group) - 1) + [end]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g["conv"] for g in group], arrow), pa.array([g["part"] for g in group], pa.int32()), pa.array([g["no"] for g in group], pa.int32()),
                 pa.array([c[0] for c in choice], pa.string()), pa.array([c[1] for c in choice], pa.int64()), pa.array([c[2] for c in choice], pa.string()),
                 pa.array(last, pa.string())], names=schema.names,
            )

    rows = found.select("conv", "part", "no", "keys", "costs", "audits")
    return rows.repartition("conv").sortWithinPartitions("conv", "part", "no").mapInArrow(run, schema)


def _joined(stretches: DataFrame) -> DataFrame:
    """Conversations of several stretches: of each, a row with its edits stands before the one with its texts."""
    kind = stretches.schema["conv"].dataType
    schema = T.StructType(_conversation_fields(kind, "conv"))

    def run(batches):
        arrow, conv, now = None, None, None

        def done():
            values = (now["gaps"] + 1 - now["distinct"] if now["distinct"] else 0, *[now[k] for k in RESULT[1:6]], "".join(now["audit"]), "\n".join(now["repaired"]))
            kinds = [arrow, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((conv, *values), kinds, strict=True)], names=schema.names)

        for batch in slices(batches, 16):
            arrow = batch.schema.field(0).type
            for row in batch.to_pylist():
                if now is None or row["conv"] != conv:
                    if now is not None:
                        yield done()
                    conv = row["conv"]
                    now = dict.fromkeys(RESULT, 0) | {"distinct": 0, "low": None, "high": None, "tail": "", "audit": [], "repaired": [], "choice": None}
                if row["roles"] is None:
                    now["choice"] = row
                    continue
                choice = now["choice"]
                marks = choice["marks"]
                now["blank"] += row["blanks"]
                now["duplicate"] += marks.count("-") - row["blanks"]
                now["truncated"] += sum(m.isupper() for m in marks)
                now["illegal"] += _illegal(now["tail"] + row["initials"])
                now["tail"] = row["initials"][-1:] or now["tail"]
                if row["distinct"]:
                    now["distinct"] += row["distinct"] - (now["high"] == row["low"])
                    now["low"] = row["low"] if now["low"] is None else now["low"]
                    now["high"] = row["high"]
                    now["gaps"] = now["high"] - now["low"]
                pieces, _ = _rebuild(choice["edits"], choice["phase"], zip(row["roles"], row["texts"], strict=True))
                now["cost"] += choice["spent"]
                now["audit"].append(choice["edits"])
                now["repaired"] += pieces
                if choice["ending"]:
                    cost, edits = ENDS[choice["ending"]]
                    now["cost"] += cost
                    now["audit"].append(edits)
                    now["repaired"] += _rebuild(edits, choice["ending"], ())[0]
        if now is not None:
            yield done()

    return stretches.repartition("conv").sortWithinPartitions("conv", "part", "no", "texts_row").mapInArrow(run, schema)


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None,
    stretch_rows: int = STRETCH_ROWS, stretch_chars: int = STRETCH_CHARS,
) -> DataFrame:
    """One row per conversation: its id, faults, the cheapest repair's ``cost`` and ``audit``, and the ``repaired`` transcript.

    Turns are taken by ``turn``, nulls first; rows of one turn by the beginnings of role and text, then by a hash of
    both. A null role or text counts as one space. A turn's first fault counts: ``blank``, ``duplicate`` (role and text
    stood earlier), ``truncated`` (its last character that is not white space is none of ``.!?``). ``gaps`` are missing turn numbers, ``illegal``
    neighbours whose roles may not follow each other. ``audit`` has the edits' initials in order (Delete, Insert, Keep,
    Rerole), the least text of equal cost; ``repaired`` is ``role:text`` by lines, and must fit a string (2 GB).

    Rows with a null conversation id are one conversation. A row for which ``present`` does not hold only names its
    conversation; one without turns has zeros and empty texts. Repeated rows are duplicates. A very long conversation or text
    goes by stretches. An empty table gives no rows; other columns change nothing.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "conversations")
    table = scratch.cut(_stretched(_in_order(rows, conv_col, turn_col, role_col, text_col, present), stretch_rows, stretch_chars), "stretches")
    parts = table.filter("part is not null").withColumn("blanks", F.length("marks") - F.length(F.replace("marks", F.lit("-"), F.lit(""))))
    # Duplicates of stretches: all but the first of equal digests.
    turns = parts.select("part", "no", F.posexplode("digests").alias("i", "digest"))
    at = F.struct("part", "no", "i")
    firsts = turns.groupBy("digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    firsts = scratch.cut(firsts, "firsts", rows="rows")
    again = join_keyed(turns, firsts, "digest").filter(at != F.col("first")).groupBy("part", "no").agg(F.collect_list("i").alias("again"))
    nodes = parts.select("conv", "part", "no", "marks").join(again, ["part", "no"], "left").select("conv", "part", "no", "marks", "again")
    found = scratch.cut(_with_ways(nodes), "ways")
    chosen = _decided(found).join(found.select("part", "no", "marks"), ["part", "no"])
    none = lambda c: F.lit(None).cast(parts.schema[c].dataType).alias(c)
    body = ["initials", "low", "high", "distinct", "roles", "texts", "blanks"]
    before = chosen.select("conv", "part", "no", F.lit(False).alias("texts_row"), "phase", "spent", "edits", "ending", "marks", *[none(c) for c in body])
    said = parts.select(
        "conv", "part", "no", F.lit(True).alias("texts_row"), *[F.lit(None).cast(t).alias(c) for c, t in (("phase", "string"), ("spent", "long"), ("edits", "string"), ("ending", "string"))],
        "marks", *body,
    )
    several = _joined(before.unionByName(said))
    out = table.filter("part is null").select("conv", *RESULT).unionByName(several)
    return out.withColumnRenamed("conv", conv_col)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a checksum of conversation and turn, and ``present``, false for dropped turns.

    Of 20 residues 0 drops a turn, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it,
    4 makes it the user's. A null counts as one space.
    """
    text = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    said = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(text("role")).alias("role"), said.alias("text"), (fault != 0).alias("present"),
        F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
