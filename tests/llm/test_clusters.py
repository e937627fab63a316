import numpy as np
import pytest

from kelpline.llm import clusters as C

DIM = 16


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, leaf INT")


def sample(seed, n_groups=25, hot=200, noise=120):
    r = np.random.default_rng(seed)
    x = [c + r.normal(0, 0.05, DIM) for c in r.normal(0, 1.5, (n_groups, DIM)) for _ in range(r.integers(2, 9))]
    x += [np.full(DIM, 2.0) + r.normal(0, 0.05, DIM) for _ in range(hot)] + list(r.normal(0, 1.5, (noise, DIM)))
    order = r.permutation(len(x))
    return [(int(i), x[j].astype(np.float32).tolist()) for i, j in enumerate(order)]


def brute(rows, link):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], np.float64)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= link
    lead = list(range(len(ids)))
    changed = True
    while changed:
        new = [min(lead[j] for j in np.flatnonzero(d[i])) for i in range(len(ids))]
        changed, lead = new != lead, new
    return {ids[i]: min(ids[j] for j in range(len(ids)) if lead[j] == lead[i]) for i in range(len(ids))}


def found(spark, rows):
    m, leaves = C.groups(C.valid_vectors(frame(spark, rows), DIM), DIM)
    return {r.vec_id: (r.lead_id, r["size"]) for r in m.collect()}, leaves


@pytest.mark.parametrize("seed,block", [(1, C.BLOCK_ROWS), (2, 40)])
def test_groups_are_the_linked_ones(spark, monkeypatch, seed, block):
    rows = sample(seed)
    for f in (C.grow, C.leaves):  # small blocks: the tree is grown over the cluster and groups are cut
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], block))
    got, leaves = found(spark, rows + rows[:30])
    want = brute(rows, C.LINK)
    assert {k: v[0] for k, v in got.items()} == want
    sizes = {}
    for lead in want.values():
        sizes[lead] = sizes.get(lead, 0) + 1
    assert all(n == sizes[lead] for lead, n in got.values())
    assert all(r.radius <= C.LINK / 2 + 1e-6 and r.typical_ids for r in leaves.collect())


def test_bisect_leaves_are_compact():
    x = np.array([v for _, v in sample(3)], np.float64)
    leaf = C.bisect(x, 0.45)
    for n in range(leaf.max() + 1):
        part = x[leaf == n]
        assert len(part) and np.sqrt(((part - part.mean(0)) ** 2).sum(1)).max() <= 0.45 + 1e-9
    assert C.bisect(np.ones((50, 4)), 0.1).max() == 0
    assert len(set(C.bisect(np.array([[0.0], [1e-9], [5.0]]), 0.0))) >= 2


def test_reach_never_misses():
    r = np.random.default_rng(0)
    for dim in (2, 5, 16):
        t, x, open_ = C.Tree(), r.normal(size=(120, dim)), [0]
        for _ in range(25):
            open_ += t.split(open_.pop(r.integers(len(open_))), r.normal(size=dim), r.normal(size=dim))
        node = t.descend(x)
        for i in range(0, 120, 7):
            d = np.sqrt(((x - x[i]) ** 2).sum(1))
            for j in range(120):
                rows, nodes = t.reach(x[i][None], np.array([d[j]]))
                assert node[j] in nodes and not rows.any() and len(set(nodes)) == len(nodes)
        assert node[3] in t.reach(x[3][None], np.array([0.0]))[1]


def test_components():
    assert C.components(6, np.array([5, 3, 1]), np.array([3, 1, 4])).tolist() == [0, 1, 2, 1, 1, 1]
    chain = np.arange(999)
    assert not C.components(1000, chain, chain + 1).any()
    assert C.components(3, chain[:0], chain[:0]).tolist() == [0, 1, 2]


def test_one_pair_of_members_links_two_leaves(spark):
    """Two leaves with 35 members each, of which one pair alone is within the link distance."""
    r, axis = np.random.default_rng(5), np.eye(DIM)[0]
    def leaf(at):
        v = r.normal(size=(33, DIM))
        v[:, 0] = 0
        v *= 0.43 / np.linalg.norm(v, axis=1)[:, None]
        return [at + 0.02 * axis, at - 0.02 * axis, *(at + v)]
    a, b = leaf(0 * axis), leaf(1.65 * axis)
    up = 0.4 * np.eye(DIM)[1]
    a[0], b[0] = 0.4 * axis + 0.01 * up, 1.25 * axis + 0.01 * up
    a += [0.43 * z for z in np.eye(DIM)[2:12]] + [0.05 * z for z in np.eye(DIM)[2:8]]
    rows = [(i, v.tolist()) for i, v in enumerate([*a, *b])]
    want = brute(rows, C.LINK)
    got, _ = found(spark, rows)
    assert {k: v[0] for k, v in got.items()} == want and set(want.values()) == {0}


@pytest.mark.parametrize("seed,sent", [(1, 25), (3, C.SENT_ROWS)])
def test_links_near_the_limit(spark, monkeypatch, seed, sent):
    """Chains of members in few dimensions: most pairs of leaves are settled by their members alone."""
    for f in (C.grow, C.leaves):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 30))
    monkeypatch.setattr(C.links, "__defaults__", (C.LINK, sent))
    monkeypatch.setattr(C, "COMPARED_ROWS", 7)
    r = np.random.default_rng(seed)
    x = np.zeros((260, DIM))
    x[:, :3] = r.uniform(0, 8, (260, 3)) + (1e4 if seed == 3 else 0)
    x[200:] = x[:60]
    rows = [(int(i), v.astype(np.float32).tolist()) for i, v in zip(r.permutation(260), x)]
    want = brute(rows, C.LINK)
    got, _ = found(spark, rows)
    assert {k: v[0] for k, v in got.items()} == want and len(set(want.values())) > 3
    v = C.valid_vectors(frame(spark, rows), DIM)
    m = spark.createDataFrame([(k, v[0]) for k, v in got.items()], "vec_id BIGINT, lead_id BIGINT")
    report = C.missed(v, m, DIM).first()
    assert report.n_missed == 0 and report.n_asked == 13 and report.n_links > 0
    split = spark.createDataFrame([(k, k) for k in got], "vec_id BIGINT, lead_id BIGINT")
    assert C.missed(v, split, DIM).first().n_missed == report.n_links


def test_typical_members(spark):
    rows = [(1, [0.0] * DIM), (2, [0.1] * DIM), (3, [0.02] * DIM), (4, [0.02] * DIM), (9, [5.0] * DIM)]
    v = C.valid_vectors(frame(spark, rows), DIM)
    m = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (9, 9)], "vec_id BIGINT, lead_id BIGINT")
    got = {x.lead_id: (x["size"], x.typical_ids) for x in C.described(v, m, DIM, 3).collect()}
    assert got == {1: (4, [3, 4, 1]), 9: (1, [9])}


def test_more_blocks_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_NODES", 1)
    with pytest.raises(ValueError):
        C.grow(C.valid_vectors(frame(spark, sample(1)), DIM), DIM, 0.45, 10)


def test_dirty_and_empty(spark):
    v, nan = [1.0] * DIM, float("nan")
    rows = [(1, v), (1, v), (2, v), (3, v), (4, None), (5, []), (6, v + [1.0]), (7, [nan] + v[1:]), (None, v), (8, [None] + v[1:]), (9, [-1.0] * DIM)]
    got, _ = found(spark, rows)
    assert got == {1: (1, 3), 2: (1, 3), 3: (1, 3), 9: (9, 1)}
    assert found(spark, [])[0] == {}


def test_hot_copies(spark):
    v, w = [1.0] * DIM, [1.5] + [1.0] * (DIM - 1)
    rows = [(7, v)] * 3000 + [(8, w), (7, v), (7, w), (9, [9.0] * DIM)]
    valid = C.valid_vectors(frame(spark, rows), DIM).repartition(3)
    thin = C.once_a_task(valid, 1)
    assert thin.count() < 20 and thin.distinct().count() == 4
    assert found(spark, rows)[0] == {7: (7, 3), 8: (7, 3), 9: (9, 1)}


def test_merging_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (101, 102)], "a BIGINT, b BIGINT")
    got = {r.node: r.root for r in C.merged(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100, 102: 100}
    assert C.merged(edges.limit(0)).count() == 0
