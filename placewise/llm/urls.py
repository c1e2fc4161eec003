"""URL filters: prefix rules first, then the ratio of two character language models.

Everything here is DataFrame functions. URLs that a rule accepts or rejects are the two training sets. Each
set gets a variable-order Markov model: the probability of a character after a context of ``order``
characters interpolates the longest context with the next shorter one by Witten and Bell's smoothing,
``P(c | ctx) = (n(ctx, c) + d(ctx) * P(c | shorter ctx)) / (n(ctx) + d(ctx))`` with ``d`` the number of distinct
characters seen after the context, down to a uniform distribution over ``ALPHABET`` characters. A URL's score
is the mean over the characters of all of it, scheme, query and fragment included, of ``log P_accepted - log P_rejected``.
The threshold is calibrated on URLs that the models have not seen: one distinct URL in ``CALIBRATED`` of those that a
rule judges, by a hash of the URL; it lies halfway between the mean scores of their two sets.

Pages of one URL are counted first, and a window's counts are summed before they are shuffled. Probabilities are
computed once for each distinct window of ``order`` + 1 characters. Windows and URLs that very many rows share are
joined by a broadcast of those alone (``join_keyed``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, join_keyed

ORDER = 4
ALPHABET = 256
CALIBRATED = 5
START = "\u0002"

#: (host, path prefix, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as a struct ``(rule, verdict)``, null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, hit).otherwise(found)
    return found


def windows_of(text: Column, order: int = ORDER) -> Column:
    """One string of ``order`` + 1 characters for each character: its context, padded at the start, and itself.

    A pattern that looks ahead and goes on by one character reads a text once, however long it is.
    """
    padded = F.concat(F.lit(START * order), text)
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))."), F.lit(1))


def window_scores(counts: DataFrame, order: int = ORDER, alphabet: int = ALPHABET) -> DataFrame:
    """``(w, gain)`` for each distinct window of ``counts(w, n_allow, n_block)``, seen in training or not.

    Orders go from the shortest to the longest: each gram takes the probability of its suffix, so a row of an
    order is joined once and the plan grows with the orders alone.
    """
    sides = ("allow", "block")
    shorter = None
    for k in range(order + 1):
        grams = counts.groupBy(F.substring("w", order + 1 - k, k + 1).alias("g")).agg(
            *[F.sum(f"n_{s}").alias(f"c_{s}") for s in sides]
        )
        grams = grams.withColumn("ctx", F.substring("g", 1, k))  # the context of k characters before the last one
        contexts = grams.groupBy("ctx").agg(
            *[F.sum(f"c_{s}").alias(f"t_{s}") for s in sides],
            *[F.count_if(F.col(f"c_{s}") > 0).alias(f"d_{s}") for s in sides],
        )
        scored = grams.join(contexts, "ctx").drop("ctx")
        if shorter is None:
            scored = scored.withColumns({f"p_{s}": F.lit(1.0 / alphabet) for s in sides})
        else:
            scored = scored.withColumn("suffix", F.substring("g", 2, k)).join(shorter, "suffix")
        p = {}
        for s in sides:
            mixed = (F.col(f"c_{s}") + F.col(f"d_{s}") * F.col(f"p_{s}")) / (F.col(f"t_{s}") + F.col(f"d_{s}"))
            p[s] = F.when(F.col(f"t_{s}") > 0, mixed).otherwise(F.col(f"p_{s}")).alias(f"p_{s}")
        scored = scored.select("g", *p.values())
        shorter = scored.withColumnRenamed("g", "suffix")
    return scored.select(F.col("g").alias("w"), (F.log("p_allow") - F.log("p_block")).alias("gain"))


def calibrates(text: Column) -> Column:
    """Whether a URL is kept from training, for the threshold."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % CALIBRATED == 0


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """The input's columns and ``host``, ``path``, ``rule``, ``verdict`` (which hide columns of these names).

    The verdict is the longest fitting rule's, else ``allow`` where the score reaches the threshold, else
    ``block``. The score takes the whole URL as it is written; host and path serve the rules and the output. A null
    URL or one without ``://`` has an empty host and path and no rule; a null or empty URL scores 0. Repeated rows
    are all judged, and weigh each in training. Without calibrating URLs of both kinds, the threshold is 0. An
    empty table gives no rows.
    """
    base = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    kept = [f"c{i}" for i in range(len(base))]  # free of clashes
    url = pages[url_col]
    rows = pages.select(
        *[pages[c].alias(k) for c, k in zip(base, kept, strict=True)], host_of(url).alias("host"), path_of(url).alias("path"),
        F.coalesce(url, F.lit("")).alias("text"),
    )
    rows = rows.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    scores, threshold = _scores(rows, order)
    scored = join_keyed(rows.filter("text <> ''"), scores, "text", how="left").drop("allow", "block", "apart")
    out = scored.unionByName(rows.filter("text = ''").withColumn("score", F.lit(0.0))).crossJoin(F.broadcast(threshold))  # one row
    learned = F.when(F.col("score") >= F.col("cut"), "allow").otherwise("block")
    return out.select(
        *[F.col(k).alias(c) for c, k in zip(base, kept, strict=True)], "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), learned).alias("verdict"),
    )


def _scores(rows: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """``text``, ``score``, ``rows`` (and more) of each distinct URL that is not empty, and the threshold as one row ``cut``."""
    scratch = Scratch(rows.sparkSession, "urls")
    texts = rows.filter("text <> ''").groupBy("text").agg(
        F.count_if(F.col("hit.verdict") == "allow").alias("allow"), F.count_if(F.col("hit.verdict") == "block").alias("block"), F.count("*").alias("rows")
    )
    texts = texts.withColumn("apart", calibrates(F.col("text"))).withColumn("id", F.monotonically_increasing_id())
    texts = scratch.cut(texts, "texts")  # numbered once, as this is written
    trains = lambda c: F.when(F.col("apart"), 0).otherwise(F.col(c)).alias(c)
    seen = texts.select("id", trains("allow"), trains("block"), F.explode(windows_of(F.col("text"), order)).alias("w"))
    counts = seen.groupBy("w").agg(F.sum("allow").alias("n_allow"), F.sum("block").alias("n_block"), F.count("*").alias("rows"))
    counts = scratch.cut(counts, "windows")
    gains = scratch.cut(window_scores(counts, order).join(counts.select("w", "rows"), "w"), "gains", "rows")
    by_id = join_keyed(seen.select("id", "w"), gains, "w").groupBy("id").agg(F.avg("gain").alias("score"))
    scores = scratch.cut(texts.join(by_id, "id").select("text", "score", "allow", "block", "apart", "rows"), "scores", "rows")
    mean = lambda c: F.sum(F.col("score") * F.col(c)) / F.nullif(F.sum(c), F.lit(0))
    cut = scores.filter("apart").agg(F.coalesce((mean("allow") + mean("block")) / 2, F.lit(0.0)).alias("cut"))
    return scores, scratch.cut(cut, "threshold")


def oracle_sql(rules=RULES, order: int = ORDER, alphabet: int = ALPHABET) -> str:
    """The same in DuckDB SQL, for a ``pages`` table."""
    fits = "\n".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p}:{v}'"
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    )
    sql = f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS txt, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, CASE {fits} END AS hit FROM parts),
texts AS (SELECT txt, count(*) FILTER (hit LIKE '%:allow') AS allow, count(*) FILTER (hit LIKE '%:block') AS block,
    ('0x' || substr(md5(txt), 1, 8))::BIGINT % {CALIBRATED} = 0 AS apart
  FROM ruled WHERE txt <> '' GROUP BY txt),
seen AS (SELECT txt, CASE WHEN apart THEN 0 ELSE allow END AS allow, CASE WHEN apart THEN 0 ELSE block END AS block,
    substr(repeat(chr(2), {order}) || txt, i, {order + 1}) AS w
  FROM (SELECT *, unnest(range(1, length(txt) + 1)) AS i FROM texts)),
s0 AS (SELECT w, sum(allow) AS na, sum(block) AS nb, 1.0::DOUBLE / {alphabet} AS pa, 1.0::DOUBLE / {alphabet} AS pb
  FROM seen GROUP BY w)"""
    for k in range(order + 1):
        sql += f""",
g{k} AS (SELECT substr(w, {order + 1 - k}) AS g, sum(na) AS ca, sum(nb) AS cb FROM s{k} GROUP BY 1),
c{k} AS (SELECT left(g, {k}) AS ctx, sum(ca) AS ta, sum(cb) AS tb, count(*) FILTER (ca > 0) AS da,
  count(*) FILTER (cb > 0) AS db FROM g{k} GROUP BY 1),
s{k + 1} AS (SELECT w, na, nb, CASE WHEN ta > 0 THEN (ca + da * pa) / (ta + da) ELSE pa END AS pa,
  CASE WHEN tb > 0 THEN (cb + db * pb) / (tb + db) ELSE pb END AS pb
  FROM s{k} JOIN g{k} ON substr(w, {order + 1 - k}) = g JOIN c{k} ON left(g, {k}) = ctx)"""
    sql += f""",
scores AS (SELECT txt, avg(ln(pa) - ln(pb)) AS score FROM seen JOIN s{order + 1} USING (w) GROUP BY txt),
cut AS (SELECT coalesce((sum(score * allow) / nullif(sum(allow), 0) + sum(score * block) / nullif(sum(block), 0)) / 2, 0) AS cut
  FROM texts JOIN scores USING (txt) WHERE apart)
SELECT page_id, host, path, split_part(hit, ':', 1) AS rule,
  CASE WHEN hit IS NOT NULL THEN split_part(hit, ':', 2) WHEN coalesce(score, 0) >= cut THEN 'allow' ELSE 'block' END AS verdict
FROM ruled LEFT JOIN scores USING (txt) CROSS JOIN cut"""
    return sql
