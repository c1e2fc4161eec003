"""URL scores against brute force: all of a URL counts, also what follows ``?`` or ``#`` and URLs without ``://``."""

import hashlib
import math
from collections import Counter

from placewise.llm import urls

GOOD = [f"https://shop{i}.com/item?ref=news{i % 7}#top" for i in range(20)] + ["HTTPS://Shop1.com/item?ref=news1#top"]
BAD = [f"https://shop{i}.net/es/item?ad=zzz{i % 5}#spam" for i in range(20)]
ASKED = ["https://x.org/item?ref=news3#top", "https://x.org/item?ad=zzz3#spam", "ref=news2#top", "ad=zzz2#spam", "https://x.org/item", "", None]


def _brute(texts, order=urls.ORDER):
    """The verdicts of the texts by models of whole URLs; the two training sets as counts of (context, character)."""
    def windows(t):
        padded = urls.START * order + t
        return [padded[i : i + order + 1] for i in range(len(t))]

    sides = []
    apart = [[t for t in train if int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 5 == 0] for train in (GOOD, BAD)]
    assert all(apart)
    for train, out in zip((GOOD, BAD), apart):
        train = [t for t in train if t not in out]
        n = Counter(w[-k - 1 :] for t in train for w in windows(t) for k in range(order + 1))
        total, kinds = Counter(), Counter()
        for g, c in n.items():
            total[len(g), g[:-1]] += c
            kinds[len(g), g[:-1]] += 1
        sides.append((n, total, kinds))

    def p(side, w):
        n, total, kinds = side
        out = 1 / urls.ALPHABET
        for k in range(order + 1):
            g = w[-k - 1 :]
            t, d = total[k + 1, g[:-1]], kinds[k + 1, g[:-1]]
            out = (n[g] + d * out) / (t + d) if t else out
        return out

    def score(t):
        return sum(math.log(p(sides[0], w)) - math.log(p(sides[1], w)) for w in windows(t)) / len(t) if t else 0.0

    cut = sum(sum(map(score, train)) / len(train) for train in apart) / 2
    return ["allow" if score(t or "") >= cut else "block" for t in texts]


def test_clashing_names_repeats_and_no_training(spark):
    df = spark.createDataFrame([(1, u, "a", "b", "c", "d", 1.0) for u in ASKED * 2], "page_id int, url string, text string, Verdict string, hit string, rows string, score double")
    rows = urls.judge(df).collect()
    assert len(rows) == 14 and {r.verdict for r in rows} == {"allow"} and {r.hit for r in rows} == {"c"}  # no rule fits: all score 0


def test_hot_windows_and_urls(spark, monkeypatch):
    from placewise.llm import _shared

    df = spark.createDataFrame(list(enumerate((ASKED + GOOD + BAD) * 3)), "page_id long, url string")
    want = {r.page_id: r.verdict for r in urls.judge(df).collect()}
    monkeypatch.setattr(_shared, "HOT_ROWS", 2)
    assert {r.page_id: r.verdict for r in urls.judge(df).collect()} == want


def test_whole_url_is_judged(spark):
    df = spark.createDataFrame(list(enumerate(ASKED + GOOD + BAD)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [got[i].verdict for i in range(len(ASKED))] == _brute(ASKED)
    assert [got[i].verdict for i in range(4)] == ["allow", "block", "allow", "block"]
    assert (got[0].host, got[0].path, got[2].host, got[2].path) == ("x.org", "/item", "", "")


def test_windows_and_a_very_long_url(spark):
    from pyspark.sql import functions as F

    texts = ["a", "ab", "𝒳é\nx", "x" * 5 + "#?", "http://h/" + "q" * 300_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, w in df.select("t", urls.windows_of(F.col("t"))).collect():
        padded = urls.START * urls.ORDER + t
        assert w == [padded[i : i + urls.ORDER + 1] for i in range(len(t))]
    assert urls.judge(spark.createDataFrame([(1, texts[-1])], "page_id int, url string")).first().verdict == "allow"
