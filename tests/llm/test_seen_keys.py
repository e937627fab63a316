import random

import numpy as np
import pandas as pd
import pytest

from kelpline.llm import seen_keys as S
from kelpline.session import job_dir

PROBE = "probe_id BIGINT, user_key BINARY, part STRING, h1 STRING, first_id STRING"


def probes(spark, rows):
    return spark.createDataFrame([(i, None if k is None else bytearray(k), "x", "y", "z") for i, k in rows], PROBE)


def stored(spark, keys):
    return spark.createDataFrame([(None if k is None else bytearray(k), 1) for k in keys], "user_key BINARY, part INT")


def index(spark, *batches, n_parts=1):
    i = S.SeenIndex.create(spark, job_dir(spark, "index"), n_parts, 1)
    for keys in batches:
        i.add(stored(spark, keys))
    return i


def test_perfect_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 63, 64, 65, 20_000):
        h = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        p = S.PerfectHash.build(h)
        assert sorted(p.slots(h)) == list(range(len(h)))
    assert len(p.bits) / len(h) < 4
    assert (p.slots(np.arange(100, dtype=np.uint64)) < len(h)).all()


@pytest.mark.parametrize("seed,n_parts", [(1, 1), (2, 7)])
def test_against_brute_force(spark, seed, n_parts):
    r = random.Random(seed)
    keys = [None, b"", b"\x00", b"hot", *[b"k%d" % r.randrange(300) for _ in range(200)]]
    rows = [(i, r.choice([None, b"hot", b"hot", b"", b"K1", b"k%d" % r.randrange(600)])) for i in range(400)]
    r.shuffle(rows)
    known, want = {k for k in keys if k is not None}, set()
    for i, k in sorted(rows):
        if k is not None:
            if k in known:
                want.add(i)
            known.add(k)
    i = index(spark, keys[:90], keys[90:], n_parts=n_parts)
    again = S.SeenIndex(spark, i.path)  # opened again: only its folder is needed
    got = S.seen_probes(probes(spark, rows), again)
    assert sorted(x.probe_id for x in got.collect()) == sorted(want) and got.columns == ["probe_id"]


def test_empty_and_repeated(spark):
    none = probes(spark, [])
    assert S.seen_probes(none, index(spark, [b"a"])).count() == 0
    some = probes(spark, [(1, b"a"), (2, b"a"), (None, b"a"), (3, None)])
    assert [r.probe_id for r in S.seen_probes(some, index(spark)).collect()] == [2]
    assert [r.probe_id for r in S.seen_probes(some, index(spark, [], [None])).collect()] == [2]
    assert sorted(r.probe_id for r in S.seen_probes(some, index(spark, [b"a"])).collect()) == [1, 2]


def test_equal_slot_hashes_go_to_extras():
    h1, h2 = np.array([5, 6], np.uint64), np.array([1 << 40, 2 << 40], np.uint64)
    mph = S.PerfectHash.build(h1)
    sealed = pd.DataFrame({"part": [0], "n_keys": [3], "level_bits": [mph.level_bits], "bits": [np.packbits(mph.bits).tobytes()],
                           "fingerprints": [np.zeros(2, np.uint32).tobytes()], "extras": [np.array([[5, 1 << 40]], np.uint64).tobytes()]})
    assert S.agreed_bits(sealed, h1, h2).tolist()[0] == 32 and S.agreed_bits(sealed.iloc[:0], h1, h2).tolist() == [-1, -1]


def test_agreed_bits():
    h1 = np.arange(2000, dtype=np.uint64)
    mph, h2 = S.PerfectHash.build(h1), np.random.default_rng(0).integers(0, 2**63, 2000).astype(np.uint64)
    prints = np.zeros(2000, np.uint32)
    prints[mph.slots(h1)] = (h2 >> np.uint64(32)).astype(np.uint32)
    sealed = pd.DataFrame({"part": [0], "n_keys": [2000], "level_bits": [mph.level_bits], "bits": [np.packbits(mph.bits).tobytes()], "fingerprints": [prints.tobytes()], "extras": [b""]})
    for bit in range(32):
        assert set(S.agreed_bits(sealed, h1, h2 ^ np.uint64(1 << (63 - bit)))) == {bit}
    assert set(S.agreed_bits(sealed, h1, h2)) == {32}


def test_error_rate_is_measured(spark):
    keys = [b"s%d" % i for i in range(2000)] + [b"q1"]
    rows = S.error_rate(probes(spark, [(i, b"q%d" % i) for i in range(20_000)]), stored(spark, keys), index(spark, keys, n_parts=3), 50_000).collect()
    assert [r.bits for r in sorted(rows)] == list(S.WIDTHS)
    for r in rows:
        assert (r.n_keys, r.n_stored, r.n_absent, r.n_false_no) == (70_000, 1, 69_999, 0)
        assert r.low <= r.false_yes_rate <= r.high and r.low <= r.expected and (r.bits > 12 or r.n_false_yes > 0)
    assert max(rows).n_false_yes == 0
