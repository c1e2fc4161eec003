"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base kinds are found by pattern in each whole text. A span's place is known without row-at-a-time code: the
matches of a pattern and the pieces that splitting by it leaves alternate, so running sums of their lengths
give starts and ends in code points. Sums and cuts go over runs of about sqrt(n) items, so a text of very many
matches costs little more than its length.

Linking. An access identifier, a secret and an endpoint that stand in one scope (``SCOPE`` code points
between the end of one and the start of the next) make a credential. Identifiers are base ``access`` spans; weak
secrets (``key``) are runs of 32 or more base64 characters, also right after ``=`` as in env files, and weak endpoints (``endpoint``) are http(s) addresses or cloud host names. Weak candidates are
reported only where complementary parts co-occur: a key with an identifier in scope; an endpoint with both an
identifier and a secret (a key or a base ``assign`` span) in scope. The nearest end
before a part and the nearest start after it come from running windows over starts, so no pairs of parts are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import Scratch, free_name

#: The kinds in the order of listing, their patterns and least lengths.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "key", "endpoint")

KEY = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{32,}+={0,2}+(?![A-Za-z0-9+/=_-])"
#: A cloud host begins where a run of host characters begins and ends at a name that no further label follows, so each run
#: is read once, by loops over single characters, which need no stack.
ENDPOINT = r"(?:https?://[A-Za-z0-9./:_-]+|(?<![a-z0-9.-])(?=[a-z0-9-])[a-z0-9.-]*?\.amazonaws\.com(?![a-z0-9-]|\.[a-z0-9-]))"
SCOPE = 256

_SPANS = "array<struct<start:int,end:int,kind:string>>"


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once however often ``then`` uses it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _runs(items: Column) -> Column:
    """An array cut into about as many runs as each has items, so that work per run and across runs stays small."""
    side = lambda a: F.greatest(F.ceil(F.sqrt(F.size(a))).cast("int"), F.lit(1))
    last = lambda a, n: F.greatest(F.ceil(F.size(a) / n).cast("int") - 1, F.lit(0))
    cut = lambda a, n: F.transform(F.sequence(F.lit(0), last(a, n)), lambda r: F.slice(a, r * n + 1, n))
    return _let(items, lambda a: _let(side(a), lambda n: cut(a, n)))


def spans_of(text: Column, pattern: str, kind: str, least: int = 0) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as structs (start, end, kind), in order.

    With ``least``, those whose first group is shorter are left out. Places are running sums of the lengths of gaps
    and matches, taken within runs and then over the runs' totals, so n matches cost n to the power of 1.5 copies
    of a reference at most, and the patterns are read once per text.
    """
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"),
        (F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if least else F.array().cast("array<string>")).alias("v"),
    )
    lengths = lambda f: F.transform(
        f["m"],
        lambda m, i: F.struct(
            F.char_length(F.get(f["g"], i)).alias("g"), F.char_length(m).alias("m"),
            (F.char_length(F.get(f["v"], i)) >= least if least else F.lit(True)).alias("keep"),
        ),
    )
    span = lambda start, end: F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"))
    empty = F.array().cast(_SPANS)

    def within(run: Column) -> Column:
        """The run's spans, counted from its own beginning, and its length."""
        return F.aggregate(
            run,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["g"] + x["m"]).alias("at"),
                F.when(x["keep"], F.concat(a["out"], F.array(span(a["at"] + x["g"], a["at"] + x["g"] + x["m"])))).otherwise(a["out"]).alias("out"),
            ),
        )

    placed = lambda runs: F.aggregate(
        F.transform(runs, within),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out")),
        lambda a, r: F.struct(
            (a["at"] + r["at"]).alias("at"),
            F.concat(a["out"], F.array(F.transform(r["out"], lambda s: span(a["at"] + s["start"], a["at"] + s["end"])))).alias("out"),
        ),
        lambda a: F.flatten(a["out"]),
    )
    spans = _let(found, lambda f: _let(lengths(f), lambda n: placed(_runs(n))))
    return F.when(text.rlike(pattern), spans).otherwise(empty)


def base_spans(text: Column) -> dict[str, Column]:
    """The base kinds' spans. Runs of hex digits and of upper-case letters are whole, so their least length is in the pattern."""
    return {
        "assign": spans_of(text, ASSIGN, "assign", ASSIGN_LEAST),
        "access": spans_of(text, ACCESS, "access"),
        "hex": spans_of(text, HEX, "hex"),
    }


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(s["start"].alias("s"), F.array_position(rank, s["kind"]).alias("k"), s["end"].alias("e"), s["kind"].alias("n")),
        )
    )
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["n"], s["s"], s["e"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: the id, carried columns, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256``, ``spans``,
    ``found`` (structs start, end, kind; end exclusive, in code points).

    A null text counts as empty and has no spans; result columns hide carried ones of their names. Repeated
    rows get the same result each. Rows with a null id are scanned like others. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    result = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "found")
    carry = [c for c in (carry or []) if c != id_col and c not in result]
    text = F.coalesce(docs[text_col], F.lit(""))
    kinds = base_spans(text)
    rows = docs.select(
        docs[id_col].alias("_id"),
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("_")).alias("_carry"),
        F.sha2(text, 256).alias("_sha"),
        *[c.alias(f"_{k}") for k, c in kinds.items()],
        F.when(text.rlike(ACCESS), F.concat(spans_of(text, KEY, "key"), spans_of(text, ENDPOINT, "endpoint"))).alias("_weak"),
    )
    rows = scratch.cut(rows, "spans")

    # Texts with weak candidates: a text is known by its digest, so rows that repeat it are linked once.
    has_parts = F.coalesce((F.size("_weak") > 0) & (F.size("_access") > 0), F.lit(False))
    open_ = rows.filter(has_parts).groupBy("_sha").agg(F.first(F.struct("_assign", "_access", "_weak")).alias("p"))
    parts = open_.select("_sha", F.inline(F.concat("p._assign", "p._access", "p._weak")))
    before = Window.partitionBy("_sha").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_sha").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)

    def some(*wanted: str) -> Column:
        is_one = F.col("kind").isin(*wanted)
        last, first = F.max(F.when(is_one, F.col("end"))).over(before), F.min(F.when(is_one, F.col("start"))).over(after)
        return F.coalesce(last >= F.col("start") - SCOPE, F.lit(False)) | F.coalesce(first <= F.col("end") + SCOPE, F.lit(False))

    linked = (
        parts.select("*", some("access").alias("ids"), some("key", "assign").alias("secrets"))
        .filter((F.col("kind") == "key") & F.col("ids") | (F.col("kind") == "endpoint") & F.col("ids") & F.col("secrets"))
        .groupBy("_sha").agg(F.collect_list(F.struct("start", "end", "kind")).alias("_linked"))
    )
    # Only rows with parts are joined; the others, with the texts that they carry, stay where they are.
    out = rows.filter(has_parts).join(linked, "_sha", "left").unionByName(
        rows.filter(~has_parts).withColumn("_linked", F.lit(None).cast(_SPANS))
    )
    base = F.concat("_assign", "_access", "_hex")
    found = F.concat(base, F.coalesce("_linked", F.array().cast(_SPANS)))
    return out.select(
        F.col("_id").alias(id_col),
        *[F.col(f"_carry.c{i}").alias(c) for i, c in enumerate(carry)],
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in kinds],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(found).alias("spans"),
        found.alias("found"),
    )


def redact(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with each maximal covered stretch replaced by ``mark``; a text without spans stays as it is.

    Spans are taken in order by runs: the text is first cut between runs, then each part within its run, so that
    no cut looks for its place from the beginning of a long text.
    """
    pair = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def reach(run: Column) -> Column:
        """A run's starts with the farthest end before each, and the farthest of all."""
        return F.aggregate(
            run,
            F.struct(F.lit(-1).alias("far"), none.alias("out")),
            lambda a, s: F.struct(F.greatest(a["far"], s["end"]).alias("far"), F.concat(a["out"], F.array(pair(s["start"], a["far"]))).alias("out")),
        )

    reached = lambda runs: F.aggregate(
        F.transform(runs, reach),
        F.struct(F.lit(-1).alias("far"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out")),
        lambda a, r: F.struct(
            F.greatest(a["far"], r["far"]).alias("far"),
            F.concat(a["out"], F.array(F.transform(r["out"], lambda s: pair(s["start"], F.greatest(a["far"], s["end"]))))).alias("out"),
        ),
        lambda a: F.struct(F.filter(F.flatten(a["out"]), lambda s: s["start"] > s["end"]).alias("heads"), a["far"].alias("far")),
    )
    # A stretch begins beyond every earlier end and goes up to the farthest end before the next one.
    stretches = lambda spans: _let(_let(_runs(spans), reached), lambda h: F.transform(
        h["heads"], lambda s, i: pair(s["start"], F.coalesce(F.get(h["heads"], i + 1)["end"], h["far"]))
    ))

    def cut(run: Column) -> Column:
        """A run (spans, the text's place it begins at, its part of the text) with its spans replaced."""
        return F.aggregate(
            run["spans"],
            F.struct(run["at"].alias("at"), F.array().cast("array<string>").alias("out")),
            lambda a, s: F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.array(F.substring(run["part"], a["at"] - run["at"] + 1, s["start"] - a["at"]), F.lit(mark))).alias("out"),
            ),
            lambda a: F.array_join(a["out"], ""),
        )

    ordered = F.array_sort(F.transform(found, lambda s: pair(s["start"], s["end"])))
    parts = lambda runs: F.transform(
        runs,
        lambda spans, i: _let(
            F.when(i > 0, F.element_at(F.get(runs, F.greatest(i - 1, F.lit(0))), -1)["end"]).otherwise(F.lit(0)),
            lambda at: F.struct(spans.alias("spans"), at.alias("at"), F.substring(text, at + 1, F.element_at(spans, -1)["end"] - at).alias("part")),
        ),
    )
    last = lambda runs: F.element_at(F.element_at(runs, -1), -1)["end"]
    made = lambda runs: F.concat(F.array_join(F.transform(parts(runs), cut), ""), F.substring(text, last(runs) + 1, F.char_length(text)))
    return F.when(F.size(found) > 0, _let(stretches(ordered), lambda m: _let(_runs(m), made))).otherwise(text)


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns with secrets replaced in its texts; ``n_chars``, where it is, counts the new text.

    A null text stays null and an empty one empty; repeated rows are all kept. An empty table gives no rows.
    """
    names = docs.columns
    plain = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)])
    rows = scan(plain, f"c{names.index(id_col)}", f"c{names.index(text_col)}", carry=plain.columns)
    new = free_name(rows, "new")
    rows = rows.withColumn(new, redact(F.col(f"c{names.index(text_col)}"), F.col("found")))
    changed = F.size("found") > 0
    cols = []
    for i, c in enumerate(names):
        col = F.col(f"c{i}")
        if c == text_col:
            col = F.col(new)
        elif c == "n_chars":
            col = F.when(changed, F.char_length(new).cast(docs.schema[c].dataType)).otherwise(col)
        cols.append(col.alias(c))
    return rows.select(*cols)
