"""Conversation repair against a search over all edits."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from placewise.llm import conversations as C
from placewise.llm.queries import op12_conversations

WHITE = " \t\n\v\f\r"


def brute(rows):
    """The contract's columns of turns (turn, role, text) in order, by the least (cost, audit) over states, one turn at a time."""
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.rstrip(WHITE)
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, phase, inserted):
        # phases: B nothing, S system, U user, A assistant
        options = []
        if i == len(rows) and phase in "BA":
            options.append((0, "", ()))
        if inserted < 2:
            role = "assistant" if phase == "U" else "user"
            c, a, r = best(i, "A" if phase == "U" else "U", inserted + 1)
            options.append((5 + c, "I" + a, ((role, ""), *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, phase, 0)
            options.append((2 + c, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                if role[:1] == "s" and phase == "B":
                    c, a, r = best(i + 1, "S", 0)
                    options.append((more + c, "K" + a, ((role, text), *r)))
                want = "assistant" if phase == "U" else "user"
                c, a, r = best(i + 1, want[0].upper(), 0)
                kept = role[:1] == want[0]
                options.append((more + (0 if kept else 1) + c, ("K" if kept else "R") + a, ((role if kept else want, text), *r)))
        return min(options) if options else (10**9, "", ())

    cost, audit, out = best(0, "B", 0)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def damage(rows):
    """Rows (conv, turn, role, text) after the contract's damage, by conversation and in order."""
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if role is None else role), (" " if text is None else text)
        fault = zlib.crc32(key.encode()) % 20
        mine = out.setdefault(conv, [])
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if fault == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def got(frame):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, present string, part int, marks int"


def rows_of(seed, conversations, turns):
    rnd = random.Random(seed)
    said = ["One.", "Two!", "three", "Four? ", " ", "", None, "x.\n", "…", "Long text. " * 3]
    out = []
    for c in [None, *range(conversations)]:
        for t in range(rnd.randint(1, turns)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "su", ""])
            if t == 0 and rnd.random() < 0.5:
                role = "system"
            out.append((c, None if rnd.random() < 0.03 else t + rnd.randint(0, 1) * 100_000 * (t == 9), role, rnd.choice(said), "x", 1, 2))
    lost = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)  # loses its only turn
    return [*out, (lost, 0, "user", "Hi.", "x", 1, 2)]


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("seed", [1, 2])
def test_whole_query_equals_search(spark, tmp_path, seed):
    rows = rows_of(seed, 300, 9)
    want = {c: brute(r) for c, r in damage([x[:4] for x in rows]).items()}
    assert got(op12_conversations(spark, write(spark, tmp_path, rows))) == want


def test_stretches_equal_whole(spark, tmp_path):
    rows = rows_of(3, 12, 90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    base = {c: brute(r) for c, r in damage([x[:4] for x in rows]).items()}
    for size in (1, 3, 7, 64):
        found = C.repair(C.damaged(df), present=C.F.col("present"), stretch_rows=size)
        assert got(found.withColumn("repaired_sha256", C.F.sha2("repaired", 256))) == base


def test_alignment_equals_search_in_all_ways():
    rnd = random.Random(4)
    for _ in range(1500):
        marks = "".join(rnd.choice("suaxSUAX-") for _ in range(rnd.randint(0, 9)))
        whole = C.repair_whole(marks)
        cut = rnd.randint(0, len(marks))
        choice, end = C.through([C.ways(marks[:cut]), C.ways(""), C.ways(marks[cut:])])
        assert (sum(c for _, c, _ in choice) + C.ENDS[end][0], "".join(a for *_, a in choice) + C.ENDS[end][1]) == whole


def test_one_conversation_of_many_turns(spark, tmp_path):
    rows = [(7, t, ("user", "assistant")[t % 2], f"Turn {t % 500}.", "x", 1, 2) for t in range(20_000)]
    found = got(op12_conversations(spark, write(spark, tmp_path, rows)))
    after = damage([r[:4] for r in rows])[7]
    seen = set()
    dup = 0
    for _, r, t in after:
        dup += t.strip(WHITE) != "" and (r, t) in seen
        seen.add((r, t))
    gaps, blank, duplicate, truncated, illegal, cost, audit, digest = found[7]
    assert duplicate == dup and len(audit.replace("I", "")) == len(after)
    whole = C.repair(C.damaged(spark.createDataFrame(rows, SCHEMA)), present=C.F.col("present"), stretch_rows=10**6).collect()[0]
    assert (whole.cost, whole.audit, hashlib.sha256(whole.repaired.encode()).hexdigest()) == (cost, audit, digest)


def test_equal_rows_without_turns_and_empty(spark, tmp_path):
    rows = [(None, None, None, None, "x", 1, 2)] * 50 + [(1, None, "user", "Same.", "x", 1, 2)] * 50
    want = {c: brute(r) for c, r in damage([x[:4] for x in rows]).items()}
    assert got(op12_conversations(spark, write(spark, tmp_path, rows))) == want
    assert C.repair(spark.createDataFrame([], SCHEMA)).count() == 0
