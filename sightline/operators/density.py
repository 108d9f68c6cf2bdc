"""Density clusters of vectors, exactly and without all pairs in one task.

1. Rows are dealt to blocks. Each block meets all others, and keeps the `KEPT` nearest rows of each of its rows, itself included. The `min_samples`-th distance is a
   row's core distance. Most pairs are dismissed by one matrix product; only those that may be nearer than the nearest so far are measured.
2. Two rows are as far apart as the largest of their distance and both core distances. The least spanning tree grows by rounds in which each component but the largest
   takes its shortest edge out. The kept neighbours name a candidate; it is certain if all rows beyond the kept ones are farther. Only rows for which they might be
   nearer, mostly few, are compared with all rows again.
3. Clusters grow along the tree's edges in their order, a bounded range of edges at a time. A component below `min_cluster_size` rows is no cluster; when it reaches
   that size or meets a cluster, its rows enter there, and when two clusters meet, both end in a new one.
4. A cluster's stability is the sum over its rows of the range of inverse distances in which they belong to it. Clusters are chosen that are more stable than all below
   them together; the last one, of all rows, is never chosen. Only clusters meet in this step, at most 2 / min_cluster_size of the rows.

Equal distances are ordered by rows, so results do not depend on partitions. Distances of zero count as 1e-150.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.lineage import stored
from sightline.functions.vectors import clean, matrix, width

#: Vectors in a tile, about (the tree of two tiles needs no rounds); tiles of a block; edges of the tree in a range, about.
TILE, BLOCK, EDGES = 1024, 8, 200_000
#: Nearest rows that are kept of each row, at least; blocks that a group meets in one task, at most; rows compared with rows at a time.
KEPT, RUN, PART = 32, 64, (512, 2048)
TINY = 1e-150
#: One product of two parts, used again by each task's process.
_ROOM = np.empty(PART[0] * PART[1])

_EDGES = "a long, b long, w double"
_STEP = "kind int, label long, to long, size long, cluster long, parent long, w double"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    schema = _arrow(ddl)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(schema), schema, strict=True)], schema=schema)


def _from_one(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of one vector to all others, formed alike wherever two vectors meet."""
    return np.sqrt(((x - y) ** 2).sum(axis=1))


def _pack(rows: DataFrame, tiles: int) -> DataFrame:
    """tile, ids, x: vectors by tile, in order of id and vector. A row's node is its tile and its place there."""

    def pack(got: pa.Table) -> pa.Table:
        ids, x = got.column("vec_id").to_numpy(), matrix(got.column("e").combine_chunks())
        order = np.lexsort((*x.T[::-1], ids))
        return _table([(got.column("tile")[0].as_py(), ids[order].astype("<i8").tobytes(), x[order].tobytes())], "tile long, ids binary, x binary")

    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "e"), F.lit(tiles)).alias("tile"), F.col("vec_id").cast("long").alias("vec_id"), "e")
    return dealt.groupBy("tile").applyInArrow(pack, "tile long, ids binary, x binary")


def _blocks(rows: DataFrame, n: int, size: int) -> tuple[DataFrame, int]:
    """Rows (node, e and numbers) in blocks of some `size`, their columns as bytes, and the number of blocks."""
    names, many = [c for c in rows.columns if c not in ("node", "e")], max(1, -(-n // size))

    def pack(got: pa.Table) -> pa.Table:
        columns = [got["node"].to_numpy().tobytes(), matrix(got["e"].combine_chunks()).tobytes(), *[got[c].to_numpy().tobytes() for c in names]]
        return pa.table([got["block"][:1], *[pa.array([c], pa.binary()) for c in columns]], names=["block", "node", "e", *names])

    ddl = ", ".join(["block long", *[f"{c} binary" for c in ("node", "e", *names)]])
    return stored(rows.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(many))).groupBy("block").applyInArrow(pack, ddl)), many


def _met(queries: DataFrame, groups: int, blocks: DataFrame, many: int, run, ddl: str) -> DataFrame:
    """`run` over each group of queries and each run of blocks: group and run with what it returns."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    length = max(1, min(RUN, groups * many // (4 * cores)))
    runs = -(-many // length)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumnRenamed("block", "group").select("*", every(runs).alias("run"))
    right = blocks.withColumn("run", F.floor(F.col("block") / length)).select("*", every(groups).alias("group"))
    right = right.toDF(*right.columns)  # columns of its own, as both sides may come from the same rows
    # few bytes mean much work here, so the number of tasks does not follow the bytes
    dealt = [side.repartition(groups * runs, "group", "run").groupBy("group", "run") for side in (left, right)]
    return dealt[0].cogroup(dealt[1]).applyInArrow(run, ddl)


def _product(l: np.ndarray, bound: np.ndarray, m: np.ndarray) -> np.ndarray:  # noqa: E741
    """Squared distances less the squared bound of each row of l, and less what rounding may add to them; valid until the next call."""
    ll, mm = (l * l).sum(axis=1), (m * m).sum(axis=1)
    slack = 8 * (l.shape[1] + 6) * np.finfo(float).eps * (ll.max() + mm.max())
    one = np.ones((len(m), 1))
    out = _ROOM[: len(l) * len(m)].reshape(len(l), len(m)) if len(l) * len(m) <= len(_ROOM) else None
    return np.matmul(np.hstack([-2 * l, (ll - bound * bound - slack)[:, None], np.ones((len(l), 1))]), np.hstack([m, one, mm[:, None]]).T, out=out)


def _near(l: np.ndarray, bound: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """Rows of l and of m whose distance is at most the bound of the row of l, and the distance."""
    near = np.zeros(-(-len(l) * len(m) // 8) * 8, bool)
    np.logical_not(_product(l, bound, m).reshape(-1) > 0, out=near[: len(l) * len(m)])
    some = np.flatnonzero(near.view(np.uint64))  # eight pairs at a time, as most are far
    found = (some[:, None] * 8 + np.arange(8))[near.reshape(-1, 8)[some]]
    at, to = np.divmod(found, len(m))
    d = _from_one(l[at], m[to])
    held = d <= bound[at]
    return at[held], to[held], d[held]


def _least(at: np.ndarray, d: np.ndarray, node: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k least (d, node) of each of n rows, in order; places beyond have an infinite distance and the node -1."""
    order = np.lexsort((node, d, at))
    at, d, node = at[order], d[order], node[order]
    place = np.arange(len(at)) - np.searchsorted(at, at)
    some = place < k
    best, nodes = np.full((n, k), np.inf), np.full((n, k), -1, np.int64)
    best[at[some], place[some]], nodes[at[some], place[some]] = d[some], node[some]
    return best, nodes


def _parts(blob: bytes, dim: int, size: int):
    x = np.frombuffer(blob).reshape(-1, dim)
    return [(a, x[a : a + size]) for a in range(0, len(x), size)]


def _nearest(rows: DataFrame, n: int, dim: int, k: int, size: int) -> DataFrame:
    """node, near (list of d and node, nearest first): the k nearest rows of each row, itself included, fewer where there are fewer."""
    shape = "group long, node binary, d binary, near binary"

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        if not own.num_rows or not others.num_rows:  # a hash may leave a block empty
            return _table([], shape)
        nodes, others = own["node"][0].as_py(), others.select(["node", "e"]).to_pylist()
        found = []
        for _, x in _parts(own["e"][0].as_py(), dim, PART[0]):
            best, near = np.full((len(x), k), np.inf), np.full((len(x), k), -1, np.int64)
            for o in others:
                names = np.frombuffer(o["node"], np.int64)
                for b, y in _parts(o["e"], dim, PART[1]):
                    bound = best[:, -1]
                    if np.isinf(bound).any() and len(y) > k:  # the first rows give a bound for all others
                        square = np.partition(_product(x, np.zeros(len(x)), y), k - 1, axis=1)[:, k - 1]
                        widened = np.sqrt(np.maximum(square, 0) + 16 * (dim + 6) * np.finfo(float).eps * ((x * x).sum(axis=1).max() + (y * y).sum(axis=1).max()))
                        bound = np.minimum(bound, np.where(np.isfinite(widened), widened, np.inf))
                    at, to, d = _near(x, bound, y)
                    if len(at):
                        touched, row = np.unique(at, return_inverse=True)
                        old = np.isfinite(best[touched])
                        merged = _least(
                            np.concatenate([np.nonzero(old)[0], row]), np.concatenate([best[touched][old], d]), np.concatenate([near[touched][old], names[b + to]]), len(touched), k)
                        best[touched], near[touched] = merged
            found.append((best, near))
        best, near = (np.concatenate(c) for c in zip(*found))
        return _table([(own["group"][0].as_py(), nodes, best.tobytes(), near.tobytes())], shape)

    def merge(got: pa.Table) -> pa.Table:
        nodes = got["node"][0].as_py()
        many = len(nodes) // 8
        d, near = (np.hstack([np.frombuffer(v, kind).reshape(many, k) for v in got[c].to_pylist()]) for c, kind in (("d", np.float64), ("near", np.int64)))
        some = near >= 0
        best, near = _least(np.nonzero(some)[0], d[some], near[some], many, k)
        some = near >= 0
        entries = pa.StructArray.from_arrays([pa.array(best[some]), pa.array(near[some])], names=["d", "node"])
        bounds = pa.array(np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32))
        return pa.table([pa.array(np.frombuffer(nodes, np.int64)), pa.ListArray.from_arrays(bounds, entries)], names=["node", "near"])

    blocks, many = _blocks(rows, n, size)
    lists = _met(blocks, many, blocks.select("block", "node", "e"), many, run, shape)
    return lists.groupBy("group").applyInArrow(merge, "node long, near array<struct<d: double, node: long>>")


def tree(x: np.ndarray, core: np.ndarray, node: np.ndarray) -> list[tuple[int, int, float]]:
    """The least spanning tree of some rows; equal weights are ordered by the smaller node, then the larger. Nodes ascend."""
    n, now, out = len(x), 0, []
    best, via, outside = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n - 1):
        outside[now] = False
        w = np.maximum(np.maximum(_from_one(x, x[now]), core), core[now])
        closer = outside & ((w < best) | ((w == best) & (now < via)))
        best[closer], via[closer] = w[closer], now
        rest = np.flatnonzero(outside)
        near = rest[best[rest] == best[rest].min()]
        low, high = np.minimum(near, via[near]), np.maximum(near, via[near])
        now = int(near[np.lexsort((high, low))[0]])
        a, b = sorted((int(node[now]), int(node[via[now]])))
        out.append((a, b, float(best[now])))
    return out


def _small_tree(held: DataFrame, dim: int, samples: int) -> DataFrame:
    """The tree of two tiles at most."""

    def run(got: pa.Table) -> pa.Table:
        tiles = sorted(got.to_pylist(), key=lambda r: r["tile"])
        x = np.concatenate([np.frombuffer(r["x"]).reshape(-1, dim) for r in tiles])
        node = np.concatenate([(r["tile"] << 32) + np.arange(len(r["x"]) // (8 * dim)) for r in tiles])
        core = np.array([np.partition(_from_one(x, v), min(samples, len(x)) - 1)[min(samples, len(x)) - 1] for v in x])
        return _table(tree(x, core, node), _EDGES)

    return held.select("tile", "x").withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, _EDGES)


def _searched(active: DataFrame, n_active: int, points: DataFrame, n: int, dim: int, size: int) -> DataFrame:
    """l, w, a, b, o: the shortest edges out of components l, of weight u or less, that start at the active rows (node, e, core, l, u); a few for each component."""
    shape = "l long, w double, a long, b long, o long"

    def run(own: pa.Table, others: pa.Table) -> pa.Table:
        if not own.num_rows or not others.num_rows:
            return _table([], shape)
        q, found = own.to_pylist()[0], []
        cols = lambda r: (np.frombuffer(r["node"], np.int64), np.frombuffer(r["e"]).reshape(-1, dim), np.frombuffer(r["core"]), np.frombuffer(r["l"], np.int64))
        names, x, core, label = cols(q)
        labels, of = np.unique(label, return_inverse=True)
        best = np.full(len(labels), np.inf)
        np.minimum.at(best, of, np.frombuffer(q["u"]))
        for other in others.to_pylist():
            to_names, y, to_core, to_label = cols(other)
            for a in range(0, len(x), PART[0]):
                mine = slice(a, a + PART[0])
                for b in range(0, len(y), PART[1]):
                    bound = best[of[mine]]
                    theirs = b + np.flatnonzero(to_core[b : b + PART[1]] <= bound.max())
                    if not len(theirs):
                        continue
                    if np.isinf(bound).any():  # any row outside gives a bound
                        for k in np.flatnonzero(np.isinf(bound)):
                            out = theirs[to_label[theirs] != label[a + k]]
                            if len(out):
                                w = np.maximum(np.maximum(_from_one(y[out], x[a + k]), to_core[out]), core[a + k]).min()
                                best[of[a + k]] = min(best[of[a + k]], w)
                        bound = best[of[mine]]
                    at, to, d = _near(x[mine], bound, y[theirs])
                    at, to = a + at, theirs[to]
                    w = np.maximum(np.maximum(d, core[at]), to_core[to])
                    held = (label[at] != to_label[to]) & (w <= best[of[at]])
                    at, to, w = at[held], to[held], w[held]
                    if len(at):
                        low, high = np.minimum(names[at], to_names[to]), np.maximum(names[at], to_names[to])
                        order = np.lexsort((high, low, w, of[at]))
                        first = order[np.unique(of[at][order], return_index=True)[1]]
                        best[of[at[first]]] = w[first]
                        found += zip(label[at[first]].tolist(), w[first].tolist(), low[first].tolist(), high[first].tolist(), to_label[to[first]].tolist())
        least: dict[int, tuple] = {}
        for row in found:
            if row[0] not in least or row < least[row[0]]:
                least[row[0]] = row
        return _table(list(least.values()), shape)

    groups, many = _blocks(active, n_active, size)
    blocks, all_blocks = _blocks(points, n, size)
    return _met(groups, many, blocks, all_blocks, run, shape)


def _spanning_tree(rows: DataFrame, n: int, dim: int, samples: int, tile: int) -> DataFrame:
    """The least spanning tree of all rows (node, e), equal weights ordered by a and b."""
    size = lambda n: min(BLOCK * tile, max(tile, n // 24))
    kept = max(KEPT, samples)
    near = stored(_nearest(rows, n, dim, kept, size(n)))
    # beyond the kept rows, none is nearer than `reach`
    reach = F.when(F.size("near") < kept, float("inf")).otherwise(F.col("near")[kept - 1]["d"])
    core = near.select("node", F.col("near")[min(samples, n) - 1]["d"].alias("core"), reach.alias("reach"))
    points = stored(rows.join(core, "node").withColumn("l", F.col("node")))
    pairs = near.select(F.col("node").alias("p"), F.inline("near")).withColumnRenamed("node", "q").filter("p <> q")
    sides = [points.select(F.col("node").alias(s), F.col("core").alias(f"core_{s}")) for s in "pq"]
    edges = pairs.join(sides[0], "p").join(sides[1], "q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.greatest("d", "core_p", "core_q").alias("w"))
    live = stored(edges.distinct().select("a", "b", "w", F.col("a").alias("la"), F.col("b").alias("lb")))
    taken = []
    while True:
        components = stored(points.groupBy("l").agg(F.count(F.lit(1)).alias("n")))
        top = components.agg(F.max(F.struct("n", -F.col("l"))).alias("m"), F.count(F.lit(1)).alias("left")).first()
        if top.left == 1:
            return reduce(DataFrame.unionByName, taken)
        largest = -top.m[1]
        both = live.select("a", "b", "w", F.col("la").alias("l"), F.col("lb").alias("o")).unionByName(live.select("a", "b", "w", F.col("lb").alias("l"), F.col("la").alias("o")))
        pick = lambda some: some.groupBy("l").agg(F.min(F.struct("w", "a", "b", "o")).alias("m")).select("l", "m.*")
        near_best = stored(pick(both.filter(F.col("l") != largest)))
        bound = F.coalesce("w", F.lit(float("inf")))
        active = points.filter(F.col("l") != largest).join(near_best.select("l", "w"), "l", "left").filter(F.col("reach") <= bound)
        active = stored(active.select("node", "e", "core", "l", bound.alias("u")))
        n_active = active.count()
        best = near_best
        if n_active:
            best = stored(pick(near_best.unionByName(_searched(active, n_active, points.select("node", "e", "core", "l"), n, dim, size(n_active)).select(near_best.columns))))
        taken.append(best.select("a", "b", "w").distinct())
        # each component follows its edge; of two that follow each other, the smaller one stays, and so does the largest of all
        back = best.select(F.col("l").alias("o"), F.col("o").alias("oo"))
        up = best.join(back, "o", "left").select("l", F.when((F.col("oo") == F.col("l")) & (F.col("l") < F.col("o")), F.col("l")).otherwise(F.col("o")).alias("up"))
        up = stored(up.unionByName(components.filter(F.col("l") == largest).select("l", F.col("l").alias("up"))))
        while True:
            after = stored(up.join(up.select(F.col("l").alias("up"), F.col("up").alias("top")), "up").select("l", "up", "top"))
            done = after.filter("up <> top").isEmpty()
            up = after.select("l", F.col("top").alias("up"))
            if done:
                break
        points = stored(points.join(up, "l").drop("l").withColumnRenamed("up", "l"))
        named = live.join(up.select(F.col("l").alias("la"), F.col("up").alias("ta")), "la").join(up.select(F.col("l").alias("lb"), F.col("up").alias("tb")), "lb")
        live = stored(named.filter("ta <> tb").select("a", "b", "w", F.col("ta").alias("la"), F.col("tb").alias("lb")))


def grow(edges: list[dict], least: int, first: int) -> list[tuple]:
    """What a range of edges, in order, does to components: rows of _STEP of kind 0 (a component's new one), 1 (rows of a component enter a cluster), 2 (a cluster ends in another).

    Edges have the labels, sizes and clusters of both sides (la, lb, sa, sb, ca, cb). New clusters are numbered from `first`.
    """
    up: dict[int, int] = {}
    size, cluster, small, out = {}, {}, {}, []

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for e in edges:
        for s in "ab":
            x = e[f"l{s}"]
            if x not in up:
                up[x], size[x], cluster[x], small[x] = x, e[f"s{s}"], e[f"c{s}"], [x] if e[f"c{s}"] is None else []
    for e in edges:
        x, y = sorted((find(e["la"]), find(e["lb"])))
        both = size[x] + size[y]
        if cluster[x] is not None and cluster[y] is not None:
            out += [(2, None, None, size[z], cluster[z], first, e["w"]) for z in (x, y)]
            cluster[x], first = first, first + 1
        else:
            into = cluster[x] if cluster[y] is None else cluster[y]
            if into is None and both >= least:
                into, first = first, first + 1
            waiting = small[x] + small[y] if len(small[x]) >= len(small[y]) else small[y] + small[x]
            if into is not None:
                out += [(1, label, None, None, into, None, e["w"]) for label in waiting]
                waiting = []
            cluster[x], small[x] = into, waiting
        up[y], size[x] = x, both
    return out + [(0, label, find(label), size[find(label)], cluster[find(label)], None, None) for label in up]


def choose(clusters: list[dict]) -> dict[int, int | None]:
    """The chosen cluster that each cluster's rows belong to, or None. Clusters have parent, w (where they end in it), size, and fall and rows: the sum of inverse distances at which rows entered, and their number."""
    by, below = {c["cluster"]: c for c in clusters}, {}
    inverse = lambda w: 1 / max(w, TINY)
    for c in clusters:
        below.setdefault(c["parent"], []).append(c["cluster"])
    value, chosen = {}, set()
    for k in sorted(by):  # a cluster's number is above those of clusters that end in it
        c, held = by[k], below.get(k, [])
        birth = inverse(c["w"]) if c["parent"] is not None else 0.0
        own = c["fall"] - c["rows"] * birth + sum(by[x]["size"] * (inverse(by[x]["w"]) - birth) for x in held)
        under = sum(value[x] for x in held)
        if c["parent"] is not None and not under > own:
            chosen.add(k)
        value[k] = max(own, under)
    out: dict[int, int | None] = {}
    for k in sorted(by, reverse=True):
        above = out.get(by[k]["parent"])
        out[k] = above if above is not None else k if k in chosen else None
    return out


def _stage(least: int, first: int):
    def run(got: pa.Table) -> pa.Table:
        return _table(grow(got.sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")]).to_pylist(), least, first), _STEP)

    return run


def _clusters(edges: DataFrame, nodes: DataFrame, n: int, least: int, per_range: int) -> tuple[DataFrame, DataFrame]:
    """(node, cluster, w): where rows enter; and (cluster, parent, w, size) of clusters that end."""
    ranges = max(1, -(-(n - 1) // per_range))
    if ranges > 1:
        edges = stored(edges.repartitionByRange(ranges, "w", "a", "b").withColumn("range", F.spark_partition_id()))
    points = nodes.select("node", F.col("node").alias("label"))
    state = points.select("label", F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("cluster"))
    fell, ended = [], []
    for k in range(ranges):
        e = edges.filter(F.col("range") == k) if ranges > 1 else edges
        for s in "ab":
            info = points.join(state, "label").select(F.col("node").alias(s), F.col("label").alias(f"l{s}"), F.col("size").alias(f"s{s}"), F.col("cluster").alias(f"c{s}"))
            e = e.join(info, s)

        done = stored(e.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_stage(least, k << 40), _STEP))  # one bounded range of edges
        fell.append(points.join(done.filter("kind = 1").select("label", "cluster", "w"), "label").select("node", "cluster", "w"))
        ended.append(done.filter("kind = 2").select("cluster", "parent", "w", "size"))
        if k + 1 < ranges:
            moved = done.filter("kind = 0")
            points = stored(points.join(moved.select("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
            state = stored(state.join(moved.select("label"), "label", "left_anti").unionByName(moved.select(F.col("to").alias("label"), "size", "cluster").distinct()))
    return stored(reduce(DataFrame.unionByName, fell)), stored(reduce(DataFrame.unionByName, ended))


def hdbscan(vectors: DataFrame, min_cluster_size: int = 40, min_samples: int = 10, key: str = "vec_id", column: str = "embedding", tile: int = TILE, per_range: int = EDGES) -> DataFrame:
    """vec_id and label: clusters count from 0 in order of their smallest vec_id; -1 is noise.

    Tables with fewer rows than `min_cluster_size`, or than two, are noise. Rows whose id or vector is null, or whose vector is empty or holds null or non-finite
    components, are left out; vectors of unequal lengths raise; repeated rows each count; an empty table gives no rows.
    """
    rows = clean(vectors, key, column).filter("vec_id is not null")
    n, dim = rows.count(), width(rows)
    if n < max(min_cluster_size, 2):
        return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(-1).alias("label"))
    wanted = -(-n // tile)
    held = stored(_pack(rows, wanted))

    def name(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["x"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array((r["tile"] << 32) + np.arange(len(ids))), pa.array(ids), lists], names=["node", "vec_id", "e"])

    named = stored(held.select("tile", "ids", "x").mapInArrow(name, "node long, vec_id long, e array<double>"))
    edges = _small_tree(held, dim, min_samples) if wanted <= 2 else _spanning_tree(named.select("node", "e"), n, dim, min_samples, tile)
    edges, nodes = stored(edges), named.select("node", "vec_id")
    fell, ended = _clusters(edges, nodes, n, min_cluster_size, per_range)
    # the cluster of all rows ends nowhere
    sums = fell.groupBy("cluster").agg(F.sum(1 / F.greatest("w", F.lit(TINY))).alias("fall"), F.count(F.lit(1)).alias("rows"))
    every = ended.select("cluster").unionByName(ended.select(F.col("parent").alias("cluster"))).unionByName(fell.select("cluster")).distinct()
    known = every.join(ended, "cluster", "left").join(sums, "cluster", "left").fillna(0, ["fall", "rows"])

    def pick(got: pa.Table) -> pa.Table:
        return _table([(k, c) for k, c in choose(got.to_pylist()).items() if c is not None], "cluster long, chosen long")

    chosen = known.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(pick, "cluster long, chosen long")  # clusters only
    labelled = stored(nodes.join(fell.join(chosen, "cluster").select("node", "chosen"), "node", "left"))
    numbers = labelled.filter("chosen is not null").groupBy("chosen").agg(F.min(F.struct("vec_id", "node")).alias("first"))
    one = numbers.groupBy().agg(F.sort_array(F.collect_list(F.struct("first", "chosen")))["chosen"].alias("order"))  # clusters only
    numbered = one.select(F.posexplode("order").alias("label", "chosen"))
    return labelled.join(numbered, "chosen", "left").select("vec_id", F.coalesce("label", F.lit(-1)).alias("label"))
