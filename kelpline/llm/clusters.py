"""Grouping vectors into clusters of mutually similar members, by bisecting k-means.

The tree is grown from the root: every node that is not compact is split in two by k-means. A node is
compact if all its members lie within ``radius`` of its centre; with a radius of half the link
distance any two members are then within the link distance of each other. Nodes of largest dispersion
come first; as all that break the limit must be split anyway, a whole level is split at once.

1. Across the cluster: while a node has more than ``BLOCK_ROWS`` rows and isn't compact, its split is
   refined by Lloyd steps, each one pass in which every task sends sums per node, not rows. The nodes
   number about rows / BLOCK_ROWS, and the list of their centres is what the driver holds; more than
   ``MAX_NODES`` raise an error.
2. Within blocks: each remaining node (a compact but large one in hashed chunks) is one task's block of
   at most about BLOCK_ROWS rows, and is split on by the same rule, all nodes of a level in one array step.
3. A split may cut through a group of near vectors. So each leaf's centre is sent to every block that may
   hold a vector within the link distance of its members: those whose region is no farther from the
   centre than link distance and radius. Leaves that are surely linked are joined there, within the
   task, so a dense node puts out a tree of links and not its pairs; pairs that centres, radii and the
   most typical members don't settle are compared by all their members. No link is lost.
   Linked leaves are merged by label propagation on tables.

Leaves report centre, size, radius and the members nearest to the centre.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpline.llm.vectors import packed, unpack
from kelpline.session import job_dir, materialize

LINK = 0.9
BLOCK_ROWS = 16384
LLOYD_STEPS = 2
LOCAL_STEPS = 4
TYPICAL = 4
MAX_LEVELS = 64
#: Lowest nodes of the upper tree, which the driver and every task hold; with more, an error is raised.
MAX_NODES = 131_072
TILE = 2048
#: Centres that one task of the links compares its block with, and rows that it compares a leaf with.
SENT_ROWS = 65_536
COMPARED_ROWS = 65_536
#: Relative error of a value kept in half precision, and the largest such value.
HALF_ERROR, HALF_MOST = 2.0**-11, 6e4


class Tree:
    """The upper tree. Node 0 is the root; an inner node has two children and their centres."""

    def __init__(self) -> None:
        self.children: dict[int, tuple[int, int]] = {}
        self.centres: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.size = 1

    def split(self, node: int, a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
        kids = (self.size, self.size + 1)
        self.size += 2
        self.children[node], self.centres[node] = kids, (a, b)
        return kids

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The lowest node of each row."""
        at = np.zeros(len(x), np.int64)
        work = [(0, np.arange(len(x)))]
        while work:
            node, rows = work.pop()
            if node not in self.children or not len(rows):
                at[rows] = node
                continue
            a, b = self.centres[node]
            right = x[rows] @ (b - a) > ((b @ b) - (a @ a)) / 2
            work += [(self.children[node][0], rows[~right]), (self.children[node][1], rows[right])]
        return at

    def reach(self, x: np.ndarray, within: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, lowest nodes): every node that may hold a point within ``within[i]`` of row i.

        A node's region is what lies on its side of all planes above it. Let m be the margins by which x
        misses some of these planes, and n their unit normals: each y in the region has (y - x) n >= m, so with
        u = sum m n and s = sum m^2, (y - x) u >= s, and y is no nearer than s / |u|. Nor is it nearer than
        the largest single margin. Nodes beyond ``within`` by either bound are left out, and no others.
        """
        rows_out, nodes_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        n = len(x)
        work = [(0, np.arange(n), np.zeros(n), np.zeros_like(x))]
        while work:
            node, rows, s, u = work.pop()
            if not len(rows):
                continue
            if node not in self.children:
                rows_out.append(rows)
                nodes_out.append(np.full(len(rows), node))
                continue
            a, b = self.centres[node]
            w = b - a
            norm = float(np.sqrt(w @ w)) or 1.0
            margin = (x[rows] @ w - (b @ b - a @ a) / 2) / norm
            for kid, miss in zip(self.children[node], (margin, -margin)):  # > 0: on the wrong side of the plane
                m = np.maximum(miss, 0)
                s2, u2 = s + m * m, u + m[:, None] * (w / norm * (-1 if kid == self.children[node][0] else 1))
                far = np.maximum(m, s2 / np.maximum(np.sqrt((u2 * u2).sum(1)), 1e-300))
                keep = far <= within[rows] * (1 + 1e-9) + 1e-9
                work.append((kid, rows[keep], s2[keep], u2[keep]))
        return np.concatenate(rows_out), np.concatenate(nodes_out)


def _sums(x: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, sums and sums of squares per group."""
    order = np.argsort(group, kind="stable")
    g, y = group[order], x[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
    count, s, sq = np.zeros(n), np.zeros((n, x.shape[1])), np.zeros((n, x.shape[1]))
    if len(g):
        count[g[start]] = np.diff(np.r_[start, len(g)])
        s[g[start]], sq[g[start]] = np.add.reduceat(y, start), np.add.reduceat(y * y, start)
    return count, s, sq


def _seeds(count: np.ndarray, s: np.ndarray, sq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First centres of a split: the mean, moved both ways along the coordinate of largest variance."""
    mean = s / count[..., None]
    var = np.maximum(sq / count[..., None] - mean * mean, 0)
    axis = var.argmax(-1)
    step = np.zeros_like(mean)
    np.put_along_axis(step, axis[..., None], np.sqrt(np.take_along_axis(var, axis[..., None], -1)), -1)
    return mean - step, mean + step


def bisect(x: np.ndarray, radius: float, steps: int = LOCAL_STEPS) -> np.ndarray:
    """Leaf numbers of the rows of one block: nodes are split until each is within ``radius`` of its
    centre. Identical rows are never parted. Splits that part nothing cut at the mean coordinate."""
    node, n_nodes = np.zeros(len(x), np.int64), 1
    active = np.arange(len(x))
    for _ in range(MAX_LEVELS * 4):
        if not len(active):
            break
        names, local = np.unique(node[active], return_inverse=True)
        y = x[active]
        count, s, sq = _sums(y, local, len(names))
        far = np.zeros(len(names))
        np.maximum.at(far, local, np.sqrt(((y - (s / count[:, None])[local]) ** 2).sum(1)))
        keep = far > radius
        if not keep.any():
            break
        rows = keep[local]
        active, y = active[rows], y[rows]
        remap = np.cumsum(keep) - 1
        local, names, count, s, sq = remap[local[rows]], names[keep], count[keep], s[keep], sq[keep]
        a, b = _seeds(count, s, sq)
        for step in range(steps + 1):
            w = b - a
            right = np.einsum("ij,ij->i", y, w[local]) > (((b * b).sum(1) - (a * a).sum(1)) / 2)[local]
            if step == steps:
                break
            c2, s2, _ = _sums(y, local * 2 + right, 2 * len(names))
            both = (c2[0::2] > 0) & (c2[1::2] > 0)
            a[both], b[both] = (s2[0::2] / np.maximum(c2[0::2], 1)[:, None])[both], (s2[1::2] / np.maximum(c2[1::2], 1)[:, None])[both]
        n_right = np.bincount(local, weights=right, minlength=len(names))
        stuck = (n_right == 0) | (n_right == count)
        if stuck.any():  # the seeds' plane parts any node of more than one point
            sa, sb = _seeds(count, s, sq)
            axis = (sb - sa).argmax(1)
            cut = y[np.arange(len(y)), axis[local]] > (s / count[:, None])[np.arange(len(names)), axis][local]
            right = np.where(stuck[local], cut, right)
        node[active] = n_nodes + 2 * local + right
        n_nodes += 2 * len(names)
    return np.unique(node, return_inverse=True)[1]


def grow(vectors: DataFrame, dim: int, radius: float, block_rows: int = BLOCK_ROWS) -> tuple[Tree, dict[int, int]]:
    """The upper tree over ``vec_id, v``, and the row count of each of its lowest nodes."""
    tree = Tree()

    def passed(tries: dict[int, tuple[np.ndarray, np.ndarray]], centres: dict[int, np.ndarray]) -> dict[int, tuple]:
        """One pass: for each open node, or each side of a split on trial, (count, sum, sum of squares, farthest)."""
        frozen = (tree, tries, centres)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t, tries, centres = frozen
            total: dict[int, list] = {}
            for df in it:
                if not len(df):
                    continue
                x = unpack(df["v"], dim).astype(np.float64)
                at = t.descend(x)
                for node in np.unique(at):
                    y = x[at == node]
                    side = np.zeros(len(y), int)
                    if node in tries:
                        a, b = tries[node]
                        side = (y @ (b - a) > (b @ b - a @ a) / 2).astype(int)
                    elif node not in centres and centres:
                        continue
                    for z in (0, 1):
                        p = y[side == z]
                        if not len(p):
                            continue
                        far = float(np.sqrt(((p - centres[node]) ** 2).sum(1).max())) if node in centres else 0.0
                        got = total.setdefault(2 * int(node) + z, [0, np.zeros(dim), np.zeros(dim), 0.0])
                        got[0] += len(p)
                        got[1] += p.sum(0)
                        got[2] += (p * p).sum(0)
                        got[3] = max(got[3], far)
            if total:
                yield pd.DataFrame({"slot": list(total), "n": [g[0] for g in total.values()], "s": [g[1].tobytes() for g in total.values()], "sq": [g[2].tobytes() for g in total.values()], "far": [g[3] for g in total.values()]})

        def add(df: pd.DataFrame) -> pd.DataFrame:
            s, sq = (np.frombuffer(b"".join(df[c])).reshape(-1, dim).sum(0) for c in ("s", "sq"))
            return pd.DataFrame({"slot": [df["slot"].iloc[0]], "n": [df["n"].sum()], "s": [s.tobytes()], "sq": [sq.tobytes()], "far": [df["far"].max()]})

        schema = "slot BIGINT, n BIGINT, s BINARY, sq BINARY, far DOUBLE"
        rows = vectors.mapInPandas(run, schema).groupBy("slot").applyInPandas(add, schema).collect()  # two rows per open node
        return {r.slot: (r.n, np.frombuffer(r.s), np.frombuffer(r.sq), r.far) for r in rows}

    got = passed({}, {})
    if not got:
        return tree, {}
    stats, closed = {0: got[0]}, {}
    open_ = {0} if got[0][0] > block_rows else set()
    closed.update({} if open_ else {0: got[0][0]})
    for _ in range(MAX_LEVELS):
        if not open_:
            break
        tries = {}
        for node in open_:
            n, s, sq, _ = stats[node]
            tries[node] = tuple(z[0] for z in _seeds(np.array([float(n)]), s[None], sq[None]))
        for step in range(LLOYD_STEPS):
            got = passed(tries, {n: stats[n][1] / stats[n][0] for n in open_} if step == 0 else {})
            if step == 0:
                for node in list(open_):
                    if max(got[2 * node + z][3] for z in (0, 1) if 2 * node + z in got) <= radius:
                        closed[node] = stats[node][0]
                        open_.discard(node)
                        del tries[node]
            for node in open_ if step < LLOYD_STEPS - 1 else ():
                sides = [got.get(2 * node + z) for z in (0, 1)]
                if all(sides):
                    tries[node] = tuple(s[1] / s[0] for s in sides)
        following = set()
        for node in open_:
            sides = [got.get(2 * node + z) for z in (0, 1)]
            if not all(sides):  # numerically one point: cannot be parted
                closed[node] = stats[node][0]
                continue
            for kid, side in zip(tree.split(node, *tries[node]), sides):
                stats[kid] = side
                if side[0] > block_rows:
                    following.add(kid)
                else:
                    closed[kid] = side[0]
        if tree.size > 2 * MAX_NODES:
            raise ValueError(f"more than {MAX_NODES} blocks: raise BLOCK_ROWS, or divide the vectors")
        open_ = following
    closed.update({n: stats[n][0] for n in open_})
    return tree, closed


LEAF = "block BIGINT, leaf BIGINT, size BIGINT, radius DOUBLE, centre BINARY, medoid BINARY, member_ids ARRAY<BIGINT>"


def leaves(vectors: DataFrame, dim: int, link: float = LINK, block_rows: int = BLOCK_ROWS) -> tuple[Tree, DataFrame]:
    """(upper tree, one row per leaf) of ``vec_id, v`` with unique ids. A leaf is named by its smallest
    vec_id; ``member_ids`` (at most a block's rows) come nearest to the centre first, and ``medoid`` is the
    first of them (null where it is the only one, and thus the centre)."""
    radius = link / 2
    tree, closed = grow(vectors, dim, radius, block_rows)
    chunks = {n: -(-c // (2 * block_rows)) for n, c in closed.items()}

    def place(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            if len(df):
                at = tree.descend(unpack(df["v"], dim).astype(np.float64))
                many = np.array([chunks.get(int(n), 1) for n in at])
                yield pd.DataFrame({"vec_id": df["vec_id"], "v": df["v"], "block": at, "chunk": (df["h"].to_numpy() % many).astype(np.int32)})

    placed = vectors.withColumn("h", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))).mapInPandas(place, "vec_id BIGINT, v BINARY, block BIGINT, chunk INT")

    def split(df: pd.DataFrame) -> pd.DataFrame:
        df = df.drop_duplicates(["vec_id", "v"]).sort_values(["vec_id", "v"])
        x, ids = unpack(df["v"], dim).astype(np.float64), df["vec_id"].to_numpy()
        leaf = bisect(x, radius)
        count, s, _ = _sums(x, leaf, int(leaf.max()) + 1)
        centre = (s / count[:, None]).astype("<f4")
        d = np.sqrt(((x - centre.astype(np.float64)[leaf]) ** 2).sum(1))
        order = np.lexsort((ids, d, leaf))
        ends = np.cumsum(count).astype(int)
        lead = np.full(len(count), np.iinfo(np.int64).max)
        np.minimum.at(lead, leaf, ids)
        out = []
        for n in range(len(count)):
            rows = order[ends[n] - int(count[n]) : ends[n]]
            medoid = x[rows[0]].astype("<f4").tobytes() if len(rows) > 1 else None
            out.append((int(df["block"].iloc[0]), int(lead[n]), len(rows), float(d[rows[-1]]), centre[n].tobytes(), medoid, ids[rows].tolist()))
        return pd.DataFrame(out, columns=["block", "leaf", "size", "radius", "centre", "medoid", "member_ids"])

    return tree, materialize(placed.groupBy("block", "chunk").applyInPandas(split, LEAF), "leaves")


def components(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest row that each of n rows is connected to by the edges (a, b), on top of ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        low, before = np.minimum(label[a], label[b]), label.copy()
        for end in (a, b):
            np.minimum.at(label, end, low)
            np.minimum.at(label, before[end], low)  # hook the old roots too
        label = label[label]
        if (label == before).all():
            return label


def _short(v: np.ndarray) -> bytes:
    """Half precision where the values allow it."""
    return v.astype("<f2").tobytes() if np.abs(v).max(initial=0) < HALF_MOST else v.astype("<f4").tobytes()


def _long(column: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bound on the error of each) of ``_short`` vectors."""
    half = np.array([len(c) == 2 * dim for c in column], bool)
    x = np.zeros((len(column), dim))
    for kind, which in (("<f2", half), ("<f4", ~half)):
        if which.any():
            x[which] = np.frombuffer(b"".join(c for c, w in zip(column, which) if w), kind).reshape(-1, dim)
    return x, np.where(half, HALF_ERROR, 2.0**-24) * np.sqrt((x * x).sum(1)) * (1 + 1e-3) + 1e-6


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances between all rows of x and of y."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def links(tree: Tree, leaf_rows: DataFrame, vectors: DataFrame, dim: int, link: float = LINK, sent_rows: int = SENT_ROWS) -> DataFrame:
    """``a, b``: edges between leaves (named by their smallest vec_id) that connect exactly those leaves
    which members within ``link`` connect; ``vectors`` are the rows ``vec_id, v`` of the leaves.

    A leaf goes to its own block and to those of larger number within its reach, so each pair of blocks
    meets once. If a block may be sent more than ``sent_rows`` leaves, these are spread over copies of it.
    """
    salts: dict[int, int] = {}
    slim = leaf_rows.select("block", "leaf", "size", "radius", "centre", "medoid")

    def reached(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = unpack(df["centre"], dim).astype(np.float64)
        rows, at = tree.reach(c, link + df["radius"].to_numpy() + 1e-5)
        later = at > df["block"].to_numpy()[rows]
        return c, np.r_[np.arange(len(df)), rows[later]], np.r_[df["block"].to_numpy(), at[later]]

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            if len(df):
                at, n = np.unique(reached(df)[2], return_counts=True)
                yield pd.DataFrame({"at": at, "n": n})

    if leaf_rows.count() > sent_rows:  # else none can be sent more
        per = slim.mapInPandas(count, "at BIGINT, n BIGINT").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") > sent_rows)
        salts = {r["at"]: -(-r["n"] // sent_rows) for r in per.collect()}  # at most one row a block

    def send(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            if not len(df):
                continue
            c, rows, at = reached(df)
            block, leaf = df["block"].to_numpy(), df["leaf"].to_numpy()
            many = np.array([salts.get(int(n), 1) for n in at])
            own = np.arange(len(rows)) < len(df)
            salt = (leaf[rows] % 1_000_003) % many
            if salts:  # own leaves go to all copies of their block, and are compared with each other in the first
                again = np.repeat(np.flatnonzero(own), many[own] - 1)
                turn = np.concatenate([np.arange(1, m) for m in many[own]]) if len(again) else np.zeros(0, int)
                salt = np.r_[np.where(own, 0, salt), turn]
                rows, at = np.r_[rows, rows[again]], np.r_[at, at[again]]
            short = np.array([_short(x) for x in c.astype("<f4")] + [None], object)
            near = np.array([None if m is None else _short(np.frombuffer(m, "<f4")) for m in df["medoid"]] + [None], object)
            yield pd.DataFrame({"at": at, "salt": salt.astype(np.int32), "block": block[rows], "leaf": leaf[rows], "radius": df["radius"].to_numpy()[rows], "c": short[rows], "m": near[rows]})

    def near(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("leaf")
        leaf, r, own = df["leaf"].to_numpy(), df["radius"].to_numpy(), df["block"].to_numpy() == df["at"].to_numpy()
        c, ec = _long(list(df["c"]), dim)
        m, em = _long([x if y is None else y for x, y in zip(df["c"], df["m"])], dim)
        mid = c.mean(0)  # nearer to the origin, differences are more exact
        c, m = c - mid, m - mid
        mine, other = np.flatnonzero(own), np.arange(len(df)) if df["salt"].iloc[0] == 0 else np.flatnonzero(~own)
        label, open_ = np.arange(len(df)), []
        for s in range(0, len(mine), TILE):
            o = mine[s : s + TILE]
            for t in range(0, len(other), TILE):
                z = other[t : t + TILE]
                d = _apart(c[o], c[z])
                e = ec[o][:, None] + ec[z][None]
                wide = r[o][:, None] + r[z][None]
                i, j = np.nonzero((d <= link + wide + e) & ((o[:, None] < z[None]) | ~own[z][None]))
                sure = d[i, j] + wide[i, j] <= link - e[i, j]
                i2, j2 = o[i], z[j]
                for q in range(0, len(i2), 1 << 16):
                    w = slice(q, q + (1 << 16))
                    sure[w] |= np.sqrt(((m[i2[w]] - m[j2[w]]) ** 2).sum(1)) <= link - em[i2[w]] - em[j2[w]]
                sure |= leaf[i2] == leaf[j2]
                label = components(len(df), i2[sure], j2[sure], label)
                open_.append(np.stack([i2[~sure], j2[~sure]], 1))
        rest = np.concatenate([np.zeros((0, 2), np.int64), *open_])
        rest = rest[label[rest[:, 0]] != label[rest[:, 1]]]
        tied = np.flatnonzero(label != np.arange(len(df)))
        edges = np.concatenate([np.stack([leaf[label[tied]], leaf[tied]], 1), np.sort(leaf[rest], axis=1)])
        return pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1], "sure": np.arange(len(edges)) < len(tied)})

    sent = slim.mapInPandas(send, "at BIGINT, salt INT, block BIGINT, leaf BIGINT, radius DOUBLE, c BINARY, m BINARY")
    found = materialize(sent.groupBy("at", "salt").applyInPandas(near, "a BIGINT, b BIGINT, sure BOOLEAN"), "links")
    sure = found.where("sure").select("a", "b")
    doubtful = found.where("NOT sure").select("a", "b").distinct()
    if found.where("NOT sure").limit(1).count() == 0:
        return sure
    root = merged(sure)
    named = doubtful.join(root.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(root.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    doubtful = materialize(named.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b"), "doubtful")
    return sure.unionByName(compared(doubtful, leaf_rows, vectors, dim, link))


def compared(pairs: DataFrame, leaf_rows: DataFrame, vectors: DataFrame, dim: int, link: float = LINK) -> DataFrame:
    """The pairs ``a, b`` of leaves that have members within ``link``, by comparing all of them.

    The members of a that lie within reach of b are gathered at b, in copies of b if they are very many."""
    used = pairs.select(F.col("a").alias("leaf")).union(pairs.select("b")).distinct()
    names = leaf_rows.join(used, "leaf", "left_semi").select("leaf", "radius", "centre", F.explode("member_ids").alias("vec_id"))
    rows = materialize(vectors.join(materialize(names, "names"), "vec_id").select("leaf", "radius", "centre", "vec_id", "v").distinct(), "members")
    sides = leaf_rows.select(F.col("leaf").alias("b"), F.col("radius").alias("rb"), F.col("centre").alias("cb"))
    asked = pairs.join(sides, "b").join(rows.select(F.col("leaf").alias("a"), "v"), "a")

    def within(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            if len(df):
                d = np.sqrt(((unpack(df["v"], dim).astype(np.float64) - unpack(df["cb"], dim)) ** 2).sum(1))
                yield df.loc[d <= link + df["rb"].to_numpy() + 1e-5, ["b", "a", "v"]]

    asked = materialize(asked.select("b", "a", "v", "cb", "rb").mapInPandas(within, "b BIGINT, a BIGINT, v BINARY"), "asked")
    many = materialize(asked.groupBy("b").agg(F.ceil(F.count("*") / COMPARED_ROWS).alias("many")), "many")
    left = asked.join(many, "b").withColumn("salt", F.pmod(F.xxhash64("a", "v"), F.col("many")))
    right = rows.select(F.col("leaf").alias("b"), F.col("v")).join(many, "b").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("many") - 1)))

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        yes: set[int] = set()
        if len(p) and len(q):
            x, a, y = unpack(p["v"], dim).astype(np.float64), p["a"].to_numpy(), unpack(q["v"], dim).astype(np.float64)
            for s in range(0, len(x), TILE):
                for t in range(0, len(y), TILE):
                    i, j = np.nonzero(_apart(x[s : s + TILE], y[t : t + TILE]) <= link + 1e-4)
                    for w in range(0, len(i), 1 << 16):
                        k, z = i[w : w + (1 << 16)] + s, j[w : w + (1 << 16)] + t
                        yes.update(a[k[np.sqrt(((x[k] - y[z]) ** 2).sum(1)) <= link]].tolist())
        b = int((p if len(p) else q)["b"].iloc[0])
        return pd.DataFrame({"a": sorted(yes), "b": [b] * len(yes)}, dtype=np.int64)

    return left.select("b", "salt", "a", "v").groupBy("b", "salt").cogroup(right.select("b", "salt", "v").groupBy("b", "salt")).applyInPandas(meet, "a BIGINT, b BIGINT")


def merged(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of an edge: root is the smallest node it is connected to.

    Each round every node takes the smallest root of its neighbours, then that root's root; rounds are
    written to the shared folder, and end when nothing changes.
    """
    edges = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    roots = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "roots")
    while True:
        near = edges.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        step = roots.join(near, "node").select("node", "root", F.least("root", "seen").alias("next"))
        jump = step.alias("s").join(step.select(F.col("node").alias("n2"), F.col("next").alias("root2")), F.col("s.next") == F.col("n2"), "left")
        after = materialize(jump.select("node", F.col("root").alias("was"), F.least("next", F.coalesce("root2", "next")).alias("root")), "roots")
        roots = after.select("node", "root")
        if after.where("root <> was").limit(1).count() == 0:
            return roots


def once_a_task(vectors: DataFrame, held: int = 100_000) -> DataFrame:
    """``vec_id, v`` without most of the repeated rows: a task passes over those equal to the last row of their id, of the
    ``held`` ids that it met last. So an id that holds a third of all rows sends a few rows a task, without a shuffle."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, bytes] = {}
        for b in batches:
            keep = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keep.append(last.get(i) != v)
                last[i] = v
            yield b.filter(pa.array(keep, pa.bool_()))
            if len(last) > held:
                last = {}

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id BIGINT, v BINARY")


def groups(vectors: DataFrame, dim: int, link: float = LINK) -> tuple[DataFrame, DataFrame]:
    """(``vec_id, lead_id, size``; one row per leaf with its ``lead_id``). lead_id is the group's smallest id."""
    vectors = materialize(once_a_task(vectors), "vectors")
    tree, leaf_rows = leaves(vectors, dim, link)
    roots = merged(links(tree, leaf_rows, vectors, dim, link))
    led = leaf_rows.join(roots.withColumnRenamed("node", "leaf"), "leaf", "left").withColumn("lead_id", F.coalesce("root", "leaf")).drop("root")
    sizes = led.groupBy("lead_id").agg(F.sum("size").alias("group_size"))
    named = materialize(led.select("leaf", "lead_id").distinct().join(sizes, "lead_id"), "named")
    members = leaf_rows.select("leaf", F.explode("member_ids").alias("vec_id"))
    typical = F.slice("member_ids", 1, TYPICAL).alias("typical_ids")
    return (
        members.join(named, "leaf").select("vec_id", "lead_id", F.col("group_size").alias("size")).distinct(),
        leaf_rows.select("leaf", "size", "radius", typical).join(named, "leaf"),
    )


def described(vectors: DataFrame, members: DataFrame, dim: int, typical: int = TYPICAL) -> DataFrame:
    """``lead_id, size, typical_ids`` of each group: the ``typical`` members nearest to the group's mean, ties
    to the smaller id. Sums and the nearest are combined within tasks, so a hot group sends few rows."""
    rows = vectors.join(members.select("vec_id", "lead_id"), "vec_id")

    def sums(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            if len(df):
                leads, group = np.unique(df["lead_id"].to_numpy(), return_inverse=True)
                n, s, _ = _sums(unpack(df["v"], dim).astype(np.float64), group, len(leads))
                yield pd.DataFrame({"lead_id": leads, "n": n.astype(np.int64), "s": list(s)})

    part = rows.select("lead_id", "v").mapInPandas(sums, "lead_id BIGINT, n BIGINT, s ARRAY<DOUBLE>")
    total = part.select("lead_id", "n", F.posexplode("s").alias("pos", "x")).groupBy("lead_id", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    means = materialize(total.groupBy("lead_id").agg(F.max("n").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("s")), "means")

    def near(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            if len(df):
                mean = np.stack(df["s"].to_list()) / df["size"].to_numpy()[:, None]
                d = np.sqrt(((unpack(df["v"], dim).astype(np.float64) - mean) ** 2).sum(1))
                best = pd.DataFrame({"lead_id": df["lead_id"], "size": df["size"], "d": d, "vec_id": df["vec_id"]}).sort_values(["lead_id", "d", "vec_id"])
                yield best.groupby("lead_id").head(typical)

    close = rows.join(means, "lead_id").select("lead_id", "size", "s", "vec_id", "v").mapInPandas(near, "lead_id BIGINT, size BIGINT, d DOUBLE, vec_id BIGINT")
    place = F.row_number().over(Window.partitionBy("lead_id").orderBy("d", "vec_id"))
    few = close.withColumn("place", place).where(F.col("place") <= typical)
    return few.groupBy("lead_id").agg(F.max("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("place", "vec_id"))), lambda z: z["vec_id"]).alias("typical_ids"))


def missed(vectors: DataFrame, members: DataFrame, dim: int, link: float = LINK, every: int = 20) -> DataFrame:
    """One row, for measuring: of the vectors whose id ``every`` divides, the links to all vectors, and how many
    of these have ends in different groups. Compared block by block; tasks send counts, no pairs."""
    rows = vectors.distinct().join(members.select("vec_id", "lead_id").distinct(), "vec_id")
    path = job_dir(vectors.sparkSession, "asked")
    asked = rows.where(F.col("vec_id") % every == 0)
    asked.write.parquet(path)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(path)
        files = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet"))
        n = lost = 0
        for df in it:
            x, lead, ids = unpack(df["v"], dim).astype(np.float64), df["lead_id"].to_numpy(), df["vec_id"].to_numpy()
            for f in files if len(df) else ():
                with fs.open_input_file(f) as h:
                    for b in pq.ParquetFile(h).iter_batches(TILE // 4):
                        q = b.to_pandas()
                        y, qi, ql = unpack(q["v"], dim).astype(np.float64), q["vec_id"].to_numpy(), q["lead_id"].to_numpy()
                        i, j = np.nonzero(_apart(y, x) <= link)
                        other = qi[i] != ids[j]
                        n += int(other.sum())
                        lost += int((ql[i[other]] != lead[j[other]]).sum())
        yield pd.DataFrame({"n": [n], "lost": [lost]})

    got = rows.select("vec_id", "v", "lead_id").mapInPandas(run, "n BIGINT, lost BIGINT").agg(F.sum("n").alias("n_links"), F.sum("lost").alias("n_missed"))
    return got.withColumn("n_asked", F.lit(asked.count()))


def valid_vectors(df: DataFrame, dim: int) -> DataFrame:
    """``vec_id, v`` of the valid vectors of ``vec_id, embedding``. Repeated rows are thinned out in each task, and those
    left fall into one block, where they are made one; an id with several different vectors is a member with each of them."""
    return packed(df, "vec_id", "embedding", dim)
