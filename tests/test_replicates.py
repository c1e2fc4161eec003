"""The bootstrap against brute force, in one block of doorways and in many."""

import numpy as np
import pytest

from placewise.operators import figures
from placewise.plans import queries

WORD = 0xFFFFFFFF
KINDS = f"{queries.KIND} string, door string, tn long, tr long, nn long, nr long"


def mix(x):
    for _ in range(2):
        x = ((x ^ x >> 16) * 0x45D9F3B) & WORD
    return x ^ x >> 16


def draws(seed, rep, part, n):
    stream = mix((mix((seed + rep) & WORD) + part) & WORD)
    k = np.arange(n, dtype=np.uint64)
    other = mix(stream ^ 0x9E3779B9)
    return (mix(np.uint64(stream) ^ k) + mix((np.uint64(other) + k) & np.uint64(WORD))) & np.uint64(WORD)


def resample(seed, rep, n, block=figures.BLOCK_DOORS):
    """How often a replicate draws each doorway."""
    picks = np.zeros(n, int)
    many = np.bincount((draws(seed, rep, 0, n) % np.uint64(n) // np.uint64(block)).astype(int), minlength=-(-n // block)) if n > block else [n]
    for b, m in enumerate(many):
        size = min(block, n - b * block)
        picks[b * block : b * block + size] = np.bincount((draws(seed, rep, b + 1, int(m)) % np.uint64(size)).astype(int), minlength=size)
    assert picks.sum() == n
    return picks


def interval(differences):
    d = sorted(differences)
    return d[round(0.025 * (len(d) - 1))], d[round(0.975 * (len(d) - 1))]


def difference(picks, t):
    tn, tr, nn, nr = picks @ t
    return 100 * (tr / tn - nr / nn)


def in_order(spark, rows):
    """The tallies by the numbers that doorways get."""
    got = figures.numbered_doors(rows, [queries.KIND]).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(len(got))) and {r.n for r in got} == {len(got)}
    return np.array([(r.tn, r.tr, r.nn, r.nr) for r in got])


DOORS = [(f"d{i}", 3 + i % 4, i % 3, 4 + i % 3, (i * 7) % 5) for i in range(9)]


def test_registered_queries_draw_all_replicates(spark, monkeypatch):
    rows = spark.createDataFrame([("x", *d) for d in DOORS], KINDS)
    monkeypatch.setattr(queries, "type_tallies", lambda t: rows)
    t = in_order(spark, rows)
    lo, hi = interval(difference(resample(figures.SEED, rep, 9), t) for rep in range(2000))
    r = queries.cluster_bootstrap.__wrapped__(None).first()
    assert (r.replicates, r.boot_lo, r.boot_hi) == (2000, pytest.approx(lo, abs=1e-6), pytest.approx(hi, abs=1e-6))
    b = queries.effect_bound.__wrapped__(None).first()
    assert (b.boot_lo, b.boot_hi) == (round(lo, 1), round(hi, 1))
    assert queries.tow_verdict.__wrapped__(None).first().tow_verdict == figures.tow_verdict(figures.effect_bound(rows, [queries.KIND], 2000)).first().tow_verdict


@pytest.mark.parametrize("n", [1024, 1025, 5000])
def test_many_doorways_are_drawn_from_all(spark, n):
    rnd = np.random.default_rng(n)
    tn, nn = rnd.poisson(3, n), rnd.poisson(5, n)
    t = np.stack([tn, rnd.binomial(tn, 0.3), nn, rnd.binomial(nn, rnd.random(n))], axis=1)
    rows = spark.createDataFrame([("x", f"door {i}", *map(int, r)) for i, r in enumerate(t)] + [("y", *d) for d in DOORS], KINDS)
    got = {r[0]: r for r in figures.cluster_bootstrap(rows, [queries.KIND], replicates=400).collect()}
    t = in_order(spark, rows.filter(f"{queries.KIND} = 'x'"))
    mine = [difference(resample(figures.SEED, rep, n), t) for rep in range(400)]
    lo, hi = interval(mine)
    assert (got["x"].replicates, got["x"].boot_lo, got["x"].boot_hi) == (400, pytest.approx(lo, abs=1e-9), pytest.approx(hi, abs=1e-9))
    plain = [difference(np.bincount(rnd.integers(0, n, n), minlength=n), t) for _ in range(4000)]  # n draws over all of them
    assert np.std(mine) == pytest.approx(np.std(plain), rel=0.12) and np.mean(mine) == pytest.approx(np.mean(plain), abs=5 * np.std(plain) / 20)
    assert got["y"].replicates == 400


def test_counts_of_draws_are_as_chance_has_them():
    n = 3000
    picks = np.array([resample(7, rep, n) for rep in range(300)])
    assert abs(picks.mean() - 1) < 1e-12 and abs(picks.var() - (1 - 1 / n)) < 0.01  # multinomial
    blocks = picks.reshape(300, 3, 1000)[:, :2].sum(axis=2)
    assert np.var(blocks) == pytest.approx(n * (1 / 3) * (2 / 3), rel=0.2)  # blocks are not resampled to their own size
    assert abs(np.mean(picks == 0) - np.exp(-1)) < 0.005


def test_type_record_has_all_types(spark):
    row = ("a", "d1", 4, 1, 5, 2, 3, 7, 6)
    measures = spark.createDataFrame([row, ("a", "d2", 1, 0, 1, 1, 0, 9, 9)], KINDS.replace("nr long", "nr long, calls_12mo long, vehicles_seen long, vehicles_distinct long"))
    dim = spark.createDataFrame([("x", "a", "assigned"), ("y", "none", "assigned"), ("z", None, "excluded")], f"raw_label string, {queries.KIND} string, status string")
    got = {r[0]: r for r in figures.type_record(measures, dim, replicates=20).collect()}
    assert (got["a"].tn, got["a"].nr, got["a"].seen, got["a"].doorways) == (5, 3, 7, 1)
    assert (got["none"].tn, got["none"].comparable, got["none"].tow_verdict, got["none"].doorways) == (0, False, "sample_too_small", 0)
