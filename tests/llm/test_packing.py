import random

import pandas as pd
import pytest

from kelpline.llm import packing as P
from kelpline.llm.tokens import encoder

SPEC = "spec_name STRING, capacity_tokens INT"
DOC = "doc_id BIGINT, text STRING, n_tokens STRING, grp STRING, open STRING"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], DOC)


def specs(spark, *caps):
    return spark.createDataFrame([(f"s{c}", c) for c in caps], SPEC)


def verify(rows, sizes, capacities):
    for cap in capacities:
        mine = [r for r in rows if r.capacity_tokens == cap]
        got, fills = {}, {}
        for r in mine:
            got.setdefault(r.doc_id, []).append((r.tok_start, r.tok_end))
            fills.setdefault(r.container_id, []).append(r)
        for doc, n in sizes.items():
            pieces = sorted(got.pop(doc))
            assert pieces[0][0] == 0 and pieces[-1][1] == n and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))
            assert len(pieces) == max(1, -(-n // cap))  # divided only if larger than the capacity
        assert not got
        for c in fills.values():
            fill = sum(r.tok_end - r.tok_start for r in c)
            assert fill <= cap and all(r.fill == fill and r.unused == cap - fill for r in c)
            assert sorted(r.place for r in c) == list(range(len(c)))


def first_fit_decreasing(sizes, cap):
    whole, left = sum(n // cap for n in sizes), []
    for n in sorted((n % cap for n in sizes), reverse=True):
        for i, space in enumerate(left):
            if n <= space:
                left[i] -= n
                break
        else:
            left.append(cap - n)
    return whole + len(left)


@pytest.mark.parametrize("per", [25_000, 20])
def test_everything_is_packed_once(spark, monkeypatch, per):
    monkeypatch.setattr(P, "WINDOWS", 3)
    monkeypatch.setattr(P, "FAN_IN", 2)
    r = random.Random(4)
    texts = [(i, " ".join(r.choice(["tide", "gauge", "Ряд", "列"]) for _ in range(r.choice([0, 1, 3, 9, 40, 200])))) for i in range(150)] + [(900, None), (901, ""), (902, "tide " * 5000)]
    e = encoder()
    sizes = {i: len(e.encode_ordinary(t or "")) for i, t in texts}
    out = P.pack_documents(docs(spark, texts), specs(spark, 64, 512), docs_per_partition=per)
    verify(out.collect(), sizes, [64, 512])
    report = {x.capacity_tokens: x for x in P.packing_report(out).collect()}
    for cap, x in report.items():
        assert x.n_tokens == sum(sizes.values()) and x.n_containers <= 1.2 * first_fit_decreasing(sizes.values(), cap) + 3


def test_best_fit_and_bound():
    done, left = P.pack(iter([(1, 6), (2, 5), (3, 4), (4, 5)]), 10, windows=2)
    assert sorted(sorted(p[0] for p in c) for c in done + left) == [[1, 3], [2, 4]]
    done, left = P.pack(iter((i, 7) for i in range(10)), 10, windows=3)
    assert len(done) == 7 and len(left) == 3
    done, left = P.pack(iter([(1, 25)]), 10)
    assert done == [[(1, 0, 10)], [(1, 10, 20)]] and left == [[(1, 20, 25)]]
    done, left = P.pack(iter([(1, 20)]), 10)
    assert sum(len(c) for c in done + left) == 2


def test_odd_inputs(spark):
    d = docs(spark, [(2**60 + 1, "one two"), (None, "three"), (5, "a"), (5, "a")])
    rows = P.pack_documents(d, spark.createDataFrame([("a", 10), ("a", 10), ("b", None), ("c", 0), ("d", -1), (None, 10)], SPEC)).collect()
    assert {(r.spec_name, r.capacity_tokens) for r in rows} == {("a", 10), (None, 10)}
    assert sorted((r.doc_id for r in rows if r.spec_name == "a"), key=str) == sorted([5, 5, 2**60 + 1, None], key=str)
    assert P.pack_documents(docs(spark, []), specs(spark, 10)).count() == 0
    assert P.pack_documents(d, specs(spark)).count() == 0


def test_copies_are_spread(spark, monkeypatch):
    monkeypatch.setattr(P, "COPIES", 4)
    monkeypatch.setattr(P, "WINDOWS", 1)
    rows = [(None, "same")] * 50 + [(3, "same")] * 50 + [(None, "other text")] * 9
    out = P.pack_documents(docs(spark, rows), specs(spark, 8), docs_per_partition=10).collect()
    assert len(out) == 109 and sum(r.doc_id == 3 for r in out) == 50
    assert len({r.container_id.split(".")[1] for r in out}) > 1 and all(r.fill <= 8 for r in out)


def test_faults_are_found(spark):
    d = docs(spark, [(i, "tide gauge " * (3 + i % 9)) for i in range(60)] + [(99, None)])
    out = P.pack_documents(d, specs(spark, 32))
    good = P.packing_faults(out, d).first()
    assert (good.n_documents, good.n_wrong_documents, good.n_wrong_containers) == (61, 0, 0)
    rows = out.toPandas().sort_values("tok_end", ascending=False)
    for spoil, want in ((lambda r: r.iloc[1:], (0, 1)), (lambda r: pd.concat([r, r.iloc[:1]]), (1, 1)), (lambda r: r.assign(container_id="one"), (0, 1))):
        bad = P.packing_faults(spark.createDataFrame(spoil(rows), out.schema), d).first()
        assert bad.n_wrong_documents >= want[0] and bad.n_wrong_containers >= want[1] and bad.n_wrong_documents + bad.n_wrong_containers > 0
