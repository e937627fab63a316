import numpy as np
import pytest

from kelpline.llm import mixing as X
from kelpline.llm.tokens import encoder

TARGET = "source STRING, target_share DOUBLE, max_repeats INT"
DOC = "doc_id BIGINT, text STRING, source STRING, block STRING, uses STRING"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOC)


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 256, 1000):
        assert sorted(X.feistel(np.arange(n), n, 5)) == list(range(n))
    assert (X.feistel(np.arange(1000), 1000, 1) != X.feistel(np.arange(1000), 1000, 2)).mean() > 0.9


def test_slot_plan_fills_the_gap_of_short_sources():
    plan = X.slot_plan({"a": 100, "b": 10, "c": 1000}, {"a": (0.5, 2), "b": (0.3, 2), "c": (0.2, 1), "none": (0.1, 4)}, 300)
    assert plan["b"] == 20 and plan["none"] == 0 and plan["a"] + plan["b"] + plan["c"] == 300
    assert X.slot_plan({"a": 1}, {"a": (1.0, 2)}, 100) == {"a": 2}


def draws(totals, per, seed, first=0, last=10**12):
    return list(X.shard_draws(totals, per, seed, first, last))


def test_draws_are_exact_in_total_and_alike_in_every_task():
    totals = [500, 400, 0, 77]
    for seed in range(20):
        d = draws(totals, 64, seed)
        counts, before = np.array([c for _, _, c in d]), np.array([b for _, b, _ in d])
        assert counts.sum(0).tolist() == totals and (counts >= 0).all() and (counts.sum(1)[:-1] == 64).all() and counts.sum(1)[-1] == 977 % 64
        assert (before == counts.cumsum(0) - counts).all()
        assert draws(totals, 64, seed, 3, 7) == d[3:7]
    assert draws([], 64, 0) == [] and draws([0, 0], 64, 0) == [] and len(draws([5], 64, 0)) == 1


def test_draws_follow_the_multinomial_law():
    d = np.array([c for _, _, c in draws([300_000, 100_000], 1000, 1)])
    assert abs(d[:, 0].mean() - 750) < 1e-9 and 0.8 < d[:, 0].std() / np.sqrt(1000 * 0.75 * 0.25) < 1.2


def test_very_many_slots():
    """10**11 slots, most of one source: two shards in the middle are drawn without the others."""
    totals = [8 * 10**10, 2 * 10**10, 3]
    n = -(-sum(totals) // 16384)
    (one, b1, c1), (two, b2, c2) = draws(totals, 16384, 5, n // 2 + 1, n // 2 + 3)
    assert (one, two) == (n // 2 + 1, n // 2 + 2) and sum(c1) == sum(c2) == 16384 and [x + y for x, y in zip(b1, c1)] == b2
    assert sum(b1) == one * 16384 and abs(c1[0] / 16384 - 0.8) < 0.02 and abs(b1[0] / sum(b1) - 0.8) < 0.001
    plan = X.slot_plan({"a": 10**10, "b": 10**11}, {"a": (0.5, 4), "b": (0.5, 4)}, 10**12)
    assert plan == {"a": 4 * 10**10, "b": 4 * 10**11}


@pytest.mark.parametrize("chunk", [50_000, 7])
def test_shares_and_repeats(spark, monkeypatch, chunk):
    monkeypatch.setattr(X, "laid_out", lambda d, t, v, f=X.laid_out: f(d, t, v, chunk))
    text = "tide gauge river shore " * 40
    rows = [(i, text, [" Big ", "big", "BIG"][i % 3]) for i in range(120)] + [(200 + i, text, "small") for i in range(6)] + [(300, text, None), (301, text, "other"), (302, None, "big"), (303, "", "big")]
    t = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2), (None, 0.5, 1), ("zero", 0.0, 1)], TARGET)
    got, shares = X.mix(docs(spark, rows), t, total_tokens=8000, block=32)
    used, share = got.collect(), {r.source: r for r in shares.collect()}
    assert set(share) == {"big", "small", "absent"} and share["absent"].limited and share["absent"].tokens_used == 0
    n = len(encoder().encode_ordinary(text))
    for r in used:
        assert r.n_tokens == n and r.n_uses <= {"big": 1, "small": 3}[r.source] and 0 < r.tokens_used <= r.n_tokens * r.n_uses
    assert share["small"].tokens_used <= 3 * share["small"].tokens_available
    assert abs(share["big"].actual_share - 2 / 3) < 0.1 and abs(sum(s.actual_share for s in share.values()) - 1) < 1e-9
    assert abs(sum(s.tokens_used for s in share.values()) - 8000) <= 300
    assert sum(r.tokens_used for r in used if r.source == "big") == share["big"].tokens_used


def test_all_used_up(spark):
    got, shares = X.mix(docs(spark, [(1, "one two three", "a"), (1, "one two three", "a")]), spark.createDataFrame([("a", 1.0, 2)], TARGET), total_tokens=10**6, block=2)
    assert {r.n_uses for r in got.collect()} == {2} and got.count() == 2 and shares.first().limited


def test_copies_and_missing_ids(spark, monkeypatch):
    rows = [(None, "one two", "a")] * 30 + [(7, "one two", "a")] * 30 + [(8, "three", "a")]
    got, shares = X.mix(docs(spark, rows), spark.createDataFrame([("a", 1.0, 1)], TARGET), total_tokens=10**6, block=2)
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(None) == 30 and ids.count(7) == 30 and ids.count(8) == 1
    assert shares.first().tokens_used == shares.first().tokens_available


def test_empty(spark):
    none = spark.createDataFrame([], TARGET)
    got, shares = X.mix(docs(spark, []), spark.createDataFrame([("a", 1.0, 2)], TARGET))
    assert got.count() == 0 and shares.first().actual_share == 0
    got, shares = X.mix(docs(spark, [(1, "x", "a")]), none)
    assert got.count() == 0 and shares.count() == 0


def test_faults_are_found(spark):
    drawn = spark.createDataFrame([(1, "a", 10, 2, 20), (2, "b", 10, 1, 10)], "doc_id BIGINT, source STRING, n_tokens BIGINT, n_uses BIGINT, tokens_used BIGINT")
    of = "source STRING, target_share DOUBLE, max_repeats INT, tokens_available BIGINT, limited BOOLEAN, tokens_used BIGINT, n_documents BIGINT, actual_share DOUBLE"
    rows = [("a", 0.5, 1, 20, True, 20, 1, 2 / 3), ("b", 0.3, 1, 10, False, 10, 1, 1 / 3), ("c", 0.2, 1, 0, True, 0, 0, 0.0)]
    got = {r.source: (r.kept_repeats, r.on_target) for r in X.mixing_faults(drawn, spark.createDataFrame(rows, of)).collect()}
    assert got == {"a": (False, True), "b": (True, True), "c": (True, True)}
    worse = [("a", 0.5, 2, 20, True, 20, 1, 0.5), ("b", 0.3, 1, 10, False, 10, 1, 0.3), ("c", 0.2, 1, 0, False, 0, 0, 0.2)]
    assert [r.on_target for r in X.mixing_faults(drawn, spark.createDataFrame(worse, of)).collect()] == [False, True, True]
