"""Paired bootstrap of a difference in mean average precision.

Resamples are Poisson: each image counts w times, w drawn from Poisson(1) by a hash of the seed, the image and the replicate. That needs no numbering
of images and no counts over partitions, approaches drawing with replacement as images grow many, and gives both models the same weights. Matching
never depends on weights, so it is done once.

Weights are never stored: a task makes those of its rows, for all replicates at once, from the image's hash. Detections of a (model, slice, class) are
cut into chunks at quantiles of their score. One pass forms each chunk's weighted counts, their running sums become each chunk's starting point, and a
second pass turns the chunk's rows into the largest precision for each of the 101 recall points and each replicate.

Only the largest precision at a recall or beyond counts, so most rows need no look: the counts of a block of rows, from one matrix product, bound its
precision (all its true detections over its false ones so far). Blocks whose bound stays below a precision known at their recall or beyond are left out,
replicate by replicate; only the others are walked row by row. Counts are whole numbers, and division keeps order, so nothing is lost to rounding.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.functions import partitions
from sightline.functions.lineage import cut, stored
from sightline.operators.average_precision import POINTS
from sightline.operators.match import masks

#: P(w <= k) of Poisson(1), to where doubles end.
CUMULATIVE = np.array([sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(17)])
#: The draw of each value of a hash's first 16 bits, and those that hold a bound, so that further bits decide.
_EDGES = np.searchsorted(CUMULATIVE, np.arange((1 << 16) + 1) * 2.0**-16, side="right")
DRAWN, SPLIT = _EDGES[:-1].astype(np.uint8), _EDGES[:-1] != _EDGES[1:]
#: As DRAWN, but for values that further bits decide.
UNDECIDED = 255
_TABLE = np.where(SPLIT, np.uint8(UNDECIDED), DRAWN)
CHUNK_ROWS = 20_000
#: Chunks of a (model, slice, class): beyond this many, chunks grow with the data.
MAX_CHUNKS = 1024
#: Replicates whose recall points travel together.
WIDTH = 128
#: Rows of a block (a multiple of 8, at most 128), and weights that a task holds at a time.
STEP, HELD = 128, 1 << 24
#: Blocks of a replicate and threshold that are walked together.
WALKED = 4096

GROUP = ["model", "slice", "cls"]
KEYS = "model int, slice string, cls int"


def draws(keys: np.ndarray, replicates: int) -> np.ndarray:
    """The weights of images, a row a replicate: row 0 is the data as they are (1), the others are draws from Poisson(1)."""
    out = np.ones((replicates + 1, len(keys)), np.uint8)
    for low in range(1, replicates + 1, 512):
        high = min(low + 512, replicates + 1)
        x = np.arange(low, high, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + keys.astype(np.uint64)
        room = np.empty_like(x)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= np.right_shift(x, np.uint64(shift), out=room)
            x *= np.uint64(factor)
        # the last step of the hash (x ^= x >> 31) leaves the first 16 bits as they are
        np.right_shift(x, np.uint64(48), out=room)
        drawn = out[low:high].reshape(-1)
        np.take(_TABLE, room.reshape(-1).view(np.int64), out=drawn, mode="clip")
        split = np.flatnonzero(drawn == UNDECIDED)
        rest = x.reshape(-1)[split]
        rest ^= rest >> np.uint64(31)
        drawn[split] = np.searchsorted(CUMULATIVE, (rest >> np.uint64(11)) * 2.0**-53, side="right")
    return out


def weights(keys: np.ndarray, replicates: int) -> np.ndarray:
    """An image's weights, one row a key: column 0 is the data as they are (1), the others are draws from Poisson(1)."""
    return draws(keys, replicates).T.astype(float)


def image_key(seed: int):
    """The hash of an image that its weights come from."""
    return F.xxhash64(F.lit(seed), F.col("image_id").cast("string"))


def _keys(table: pa.Table) -> np.ndarray:
    return table["key"].to_numpy().view(np.uint64)


def _bits(table: pa.Table, name: str, n: int) -> np.ndarray:
    return (table[name].to_numpy()[:, None] >> np.arange(n)) & 1


def _plain(key: tuple) -> list:
    return [k.as_py() for k in key]


def reached(found: np.ndarray, npos: np.ndarray) -> np.ndarray:
    """The last point of the recall grid that each count of true detections reaches."""
    recall = np.divide(found, npos, out=np.zeros_like(found), where=npos > 0)
    place = np.floor(recall * 100)
    place = place + ((place + 1) * 0.01 <= recall) - (place * 0.01 > recall)
    return np.minimum(place, POINTS - 1).astype(np.int64)


def raise_best(best: np.ndarray, npos: np.ndarray, found: np.ndarray, precision: np.ndarray, replicates: np.ndarray | None = None) -> None:
    """Raises best (points x replicates) to the precisions (rows x columns) at the points that the rows reach; a column is a replicate, the one named or the next.

    Counts only grow along the rows, so a few neighbouring points hold all: rows of a point lie together, and each point takes one maximum.
    """
    low, high = reached(found[0], npos), reached(found[-1], npos)
    replicates = np.arange(len(npos)) if replicates is None else replicates
    one = low == high
    if one.any():
        top = precision.max(axis=0) if one.all() else precision[:, one].max(axis=0)
        np.maximum.at(best, (low[one], replicates[one]), top)
    if not one.all():
        several = np.flatnonzero(~one)
        place = reached(found[:, several], npos[several]).T
        key = (place + np.arange(len(several))[:, None] * POINTS).reshape(-1)
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        column, point = np.divmod(key[starts], POINTS)
        np.maximum.at(best, (point, replicates[several[column]]), np.maximum.reduceat(precision[:, several].T.reshape(-1), starts))


def known(precision: np.ndarray, place: np.ndarray) -> np.ndarray:
    """For each row (rows x replicates) the largest precision of the rows at its place or beyond; places only grow along the rows."""
    rows = np.arange(len(place))[:, None]
    first = np.maximum.accumulate(np.where(np.diff(place, axis=0, prepend=-1) != 0, rows, 0), axis=0)
    return np.take_along_axis(np.maximum.accumulate(precision[::-1], axis=0)[::-1], first, axis=0)


def share(found: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Precision of whole numbers; 0 where nothing counts."""
    return found / np.maximum(counted, 1)


def block_counts(masks: np.ndarray, drawn: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Weighted counts of a block, a row a mask: masks (rows x masks) and draws (replicates x rows). Sums of a block are exact in four bytes."""
    here = room[:, : drawn.shape[1]]
    np.copyto(here, drawn)
    return (here @ masks).T


def running(added: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums down the rows, from `first` on: a row more than what is added (np.cumsum goes by columns, which is slow here)."""
    out = np.empty((len(added) + 1, added.shape[1]))
    out[0] = first
    for i, row in enumerate(added):
        np.add(out[i], row, out=out[i + 1])
    return out


def judge(best: np.ndarray, npos: np.ndarray, replicates: np.ndarray | None, true: np.ndarray, every: np.ndarray, found: np.ndarray, counted: np.ndarray, floor: np.ndarray) -> tuple:
    """Raises best to the precisions at the ends of blocks, and tells which blocks (rows x columns) may hold a larger one, with the counts before each and what is known.

    `true` and `every` are counts inside blocks, `found` and `counted` those before the first, whose precision best has; `floor` is known at the last block's place
    or beyond.
    """
    true, every = running(true, found), running(every, counted)
    start, starts, end, ends = true[:-1], every[:-1], true[1:], every[1:]
    wrong = starts - start
    precision, bound = share(end, ends), share(end, end + wrong)  # all true ones of the block, over the false ones before it
    low, high = reached(found, npos), reached(end[-1], npos)
    best_end, replicates = precision.max(axis=0), np.arange(len(npos)) if replicates is None else replicates
    one, several = np.flatnonzero(low == high), np.flatnonzero(low != high)
    np.maximum.at(best, (low[one], replicates[one]), best_end[one])
    bar = np.maximum(np.maximum(best_end, share(found, counted)), floor)
    if len(several):
        some = precision[:, several], end[:, several]
        raise_best(best, npos[several], some[1], some[0], replicates[several])
        bar = np.repeat(bar[None], len(end), axis=0)
        bar[:, several] = np.maximum(known(some[0], reached(some[1], npos[several])), floor[several])
    return (bound > bar) & (end > start), start, starts, np.broadcast_to(bar, bound.shape)


def eights(bytes_: np.ndarray) -> np.ndarray:
    """Sums of the eight bytes of numbers, none beyond 255."""
    return (bytes_ * np.uint64(0x0101010101010101)) >> np.uint64(56)


def walk(best: np.ndarray, npos: np.ndarray, replicates: np.ndarray, drawn: np.ndarray, hits: np.ndarray, judged: np.ndarray | None, found: np.ndarray, counted: np.ndarray, floor: np.ndarray) -> None:
    """Raises best to the precisions inside blocks of one replicate each (a row each, of bytes: draws, and 255 for what hits and what is judged, None for all)."""
    npos, n = npos[replicates], np.ascontiguousarray(drawn.view(np.uint64).T)
    hits = hits.view(np.uint64).T
    true, every = eights(n & hits), eights(n if judged is None else n & judged.view(np.uint64).T)
    open_, start, starts, _ = judge(best, npos, replicates, true, every, found, counted, floor)
    at, column = np.nonzero(open_)
    if not len(at):
        return
    n, hit = n[at, column], hits[at, column]
    rows = lambda x: np.ascontiguousarray(x)[:, None].view(np.uint8).T
    true = running(rows(n & hit), start[at, column])[1:]
    every = running(rows(n if judged is None else n & judged.view(np.uint64).T[at, column]), starts[at, column])[1:]
    raise_best(best, npos[column], true, share(true, every), replicates[column])


def raise_chunk(best: np.ndarray, npos: np.ndarray, keys: np.ndarray, tp: np.ndarray, judged: np.ndarray, true: np.ndarray, every: np.ndarray, floor: np.ndarray) -> int:
    """Raises best (thresholds x points x replicates) to the precisions of a chunk's rows, best scores first; returns how many blocks of a replicate and threshold were walked.

    `tp` and `judged` have a row a threshold; `true` and `every` (thresholds x replicates) are the counts before and are moved on; `floor` are precisions known
    at the chunk's last recall or beyond. A precision below one that is known at its place or beyond, at another chunk's end too, may be missing from best.
    """
    k, b = true.shape
    alike, walked = bool((judged == judged[0]).all()), 0
    masks = np.vstack([tp, judged[:1] if alike else judged]).astype(np.float32)
    room = np.empty((b, STEP), np.float32)
    rows = max(1, HELD // (STEP * b)) * STEP
    for at in range(0, len(keys), rows):
        part = masks[:, at : at + rows]
        n = -(-part.shape[1] // STEP)
        drawn, sums = np.zeros((n, b, STEP), np.uint8), np.empty((n, len(masks), b), np.float32)
        inside = np.zeros((len(masks), n * STEP), np.uint8)  # places after the last row stay 0 and repeat its counts
        inside[:, : part.shape[1]] = part * 255
        inside = inside.reshape(len(masks), n, STEP)
        for i in range(n):
            own = slice(i * STEP, min((i + 1) * STEP, part.shape[1]))
            made = draws(keys[at:][own], b - 1)
            drawn[i, :, : made.shape[1]] = made
            sums[i] = block_counts(np.ascontiguousarray(part[:, own].T), made, room)
        for t in range(k):
            more = k if alike else k + t
            open_, start, starts, bar = judge(best[t], npos, None, sums[:, t], sums[:, more], true[t], every[t], floor[t])
            block, replicate = np.nonzero(open_)
            walked += len(block)
            for lo in range(0, len(block), WALKED):
                i, j = block[lo : lo + WALKED], replicate[lo : lo + WALKED]
                walk(best[t], npos, j, drawn[i, j], inside[t][i], None if judged.all() else inside[more][i], start[i, j], starts[i, j], bar[i, j])
            true[t], every[t] = start[-1] + sums[-1, t], starts[-1] + sums[-1, more]
    return walked


def _positives(npos: DataFrame, images: DataFrame, replicates: int, tasks: int) -> DataFrame:
    """slice, cls, pos: the weighted number of boxes in each replicate, summed inside tasks first."""

    def partial(batches):
        sums, room = {}, np.empty((replicates + 1, STEP))
        for batch in batches:
            keys, n = batch["key"].to_numpy().view(np.uint64), batch["n"].to_numpy().astype(float)
            names = batch["slice"].dictionary_encode()
            group = (names.indices.to_numpy().astype(np.int64) << 32) + batch["cls"].to_numpy()
            image = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0)  # rows of an image lie together, and share its draws
            firsts = np.append(np.flatnonzero(np.diff(image, prepend=-1)), len(keys))
            for at in range(0, len(firsts) - 1, STEP):
                of = firsts[at : at + STEP + 1]
                rows = slice(of[0], of[-1])
                kinds, kind = np.unique(group[rows], return_inverse=True)
                boxes = np.zeros((len(of) - 1, len(kinds)))
                np.add.at(boxes, (image[rows] - image[of[0]], kind), n[rows])
                for g, mine in zip(kinds, block_counts(boxes, draws(keys[of[:-1]], replicates), room)):
                    g = names.dictionary[int(g >> 32)].as_py(), int(g & 0xFFFFFFFF)
                    sums[g] = sums.get(g, 0.0) + mine
        if sums:
            values = [v.tolist() for v in sums.values()]
            yield pa.RecordBatch.from_pydict({"slice": [s for s, _ in sums], "cls": pa.array([c for _, c in sums], pa.int32()), "pos": pa.array(values, pa.list_(pa.float64()))})

    rows = npos.join(images.hint("merge"), "image_id").select("slice", F.col("cls").cast("int").alias("cls"), F.col("n").cast("long").alias("n"), "key").repartition(tasks, "key").sortWithinPartitions("key")
    parts = rows.mapInArrow(partial, "slice string, cls int, pos array<double>")
    added = parts.select("slice", "cls", F.posexplode("pos").alias("replicate", "pos")).groupBy("slice", "cls", "replicate").agg(F.sum("pos").alias("pos"))
    listed = added.groupBy("slice", "cls").agg(F.sort_array(F.collect_list(F.struct("replicate", "pos"))).alias("pos"))  # replicates + 1 values
    return listed.select("slice", "cls", F.col("pos.pos").alias("pos"))


def _chunked(matches: list[DataFrame], images: DataFrame, key: Column, k: int, chunk_rows: int) -> tuple[DataFrame, int]:
    """Detections with their chunk (0: the best scores) and, as bits of a number, the thresholds at which they are true or false; and how many there are."""
    known_slices = all("slice" in m.columns for m in matches)
    sides = [
        (m.withColumn("key", key) if known_slices else m.drop("slice").join(images.hint("merge"), "image_id")).select(F.lit(i).alias("model"), "slice", F.col("cls").cast("int").alias("cls"), "score", "image_id", "det_id", "key",
            tp.alias("tp"), fp.alias("fp"))
        for i, (m, (tp, fp)) in enumerate((m, masks(m, "all", k)) for m in matches)
    ]
    rows = functools.reduce(DataFrame.unionByName, sides).filter("cls is not null")
    rows = rows if known_slices else stored(rows)  # several passes read it, and none should match or join again
    cuts = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("score", F.array(*[F.lit(j / MAX_CHUNKS) for j in range(1, MAX_CHUNKS)]), MAX_CHUNKS).alias("all_cuts"))
    chunks = F.least(F.ceil(F.col("n") / chunk_rows), F.lit(MAX_CHUNKS))
    chosen = F.expr("transform(sequence(1, greatest(chunks, 2) - 1), j -> all_cuts[cast(floor(j * {0} / greatest(chunks, 2)) as int) - 1])".format(MAX_CHUNKS))
    cuts = cuts.withColumn("chunks", chunks.cast("int")).select(*GROUP, "n", F.when(F.col("chunks") > 1, F.array_distinct(chosen)).otherwise(F.array().cast("array<double>")).alias("cuts")).collect()
    of = {(r.model, r.slice, r.cls): np.array(r.cuts) for r in cuts}  # a cut for each `chunk_rows` detections at most

    def number(batches):
        for b in batches:
            names = b["slice"].dictionary_encode()
            group = ((b["model"].to_numpy().astype(np.int64) * max(1, len(names.dictionary)) + names.indices.to_numpy()) << 32) + b["cls"].to_numpy()
            _, first, kind, counts = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
            score, chunk = b["score"].to_numpy(zero_copy_only=False), np.empty(len(group), np.int32)
            for at, mine in zip(first.tolist(), np.split(np.argsort(kind, kind="stable"), np.cumsum(counts)[:-1])):
                mine_cuts = of[tuple(b[c][at].as_py() for c in GROUP)]
                chunk[mine] = len(mine_cuts) - np.searchsorted(mine_cuts, score[mine], side="right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(chunk)], names=[*b.schema.names, "chunk"])

    # a search by numpy, as an expression would go through all cuts for each row, and there are more of both as tables grow
    return rows.mapInArrow(number, T.StructType([*rows.schema, T.StructField("chunk", T.IntegerType())])), sum(r.n for r in cuts)


def replicate_maps(matches: list[DataFrame], npos: DataFrame, images: DataFrame, thresholds: list[float], replicates: int, seed: int = 0, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """model (place in `matches`), slice, replicate (0: as they are), map. Classes without boxes in a replicate take no part in its mean.

    Match tables that all have the column slice (a row for each slice of `images` that a detection's image is in) are not joined to their images here. They are
    read several times, so they should be stored.
    """
    k, b = len(thresholds), replicates + 1
    images = images.select("image_id", "slice", image_key(seed).alias("key"))
    rows, n = _chunked(matches, images, image_key(seed), k, chunk_rows)
    # few bytes mean much work here, so the number of tasks does not follow the bytes
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism, partitions.tasks(rows, n))
    rows = rows.repartition(tasks, *GROUP, "chunk")
    positives = cut(_positives(npos, images, replicates, tasks))  # a row a slice and class

    def totals(key, table):
        tp = _bits(table, "tp", k)
        judged = tp | _bits(table, "fp", k)
        alike = bool((judged == judged[:, :1]).all())
        masks, keys = np.hstack([tp, judged[:, :1] if alike else judged]).astype(np.float32), _keys(table)
        sums, room = np.zeros((masks.shape[1], b)), np.empty((b, STEP), np.float32)
        for at in range(0, len(masks), STEP):
            sums += block_counts(masks[at : at + STEP], draws(keys[at : at + STEP], replicates), room)
        names = dict(zip([*GROUP, "chunk"], _plain(key)))
        return pa.table({n: pa.array([v] * k, pa.string() if n == "slice" else pa.int32()) for n, v in names.items()} | {
            "thr": pa.array(range(k), pa.int32()), "tp": [sums[i].tobytes() for i in range(k)], "fp": [(sums[k if alike else k + i] - sums[i]).tobytes() for i in range(k)]})

    def begin(key, table, boxes):
        """Counts before each chunk, and the largest precision known at its last recall or beyond: chunks' ends are known."""
        if not (table.num_rows and boxes.num_rows):
            return begun.empty_table()
        table = table.sort_by("chunk")
        npos = np.asarray(boxes["pos"][0].as_py())
        added = [np.array([np.frombuffer(v) for v in table[name].to_pylist()]) for name in ("tp", "fp")]
        ends = [np.cumsum(v, axis=0) for v in added]
        floor = known(share(ends[0], ends[0] + ends[1]), reached(ends[0], npos))
        packed = lambda m: pa.array([row.tobytes() for row in m], pa.binary())
        pos = [npos.tobytes()] * len(floor) if table["thr"][0].as_py() == 0 else [None] * len(floor)  # the same for all thresholds
        return pa.Table.from_arrays([*(table[c] for c in (*GROUP, "chunk", "thr")), *(packed(e - v) for e, v in zip(ends, added)), packed(floor), pa.array(pos, pa.binary())], schema=begun)

    begun = pa.schema([(c, pa.string() if c == "slice" else pa.int32()) for c in (*GROUP, "chunk", "thr")] + [(c, pa.binary()) for c in ("tp", "fp", "floor", "pos")])
    every = lambda values, name: F.explode(F.array(*map(F.lit, values))).alias(name)
    boxes = positives.select("slice", "cls", "pos", every(range(len(matches)), "model")).select("*", every(range(k), "thr"))
    starts = rows.groupBy(*GROUP, "chunk").applyInArrow(totals, f"{KEYS}, chunk int, thr int, tp binary, fp binary").groupBy(*GROUP, "thr")
    starts = starts.cogroup(boxes.groupBy(*GROUP, "thr")).applyInArrow(begin, f"{KEYS}, chunk int, thr int, tp binary, fp binary, floor binary, pos binary")

    def points(key, table, start):
        if not (table.num_rows and start.num_rows):  # a chunk has no starts where its class has no boxes in the slice
            return pa.table({n: pa.array([], pa.string() if n == "slice" else pa.binary() if n == "best" else pa.int32()) for n in (*GROUP, "thr", "first", "low", "best")})
        table = table.sort_by([("score", "descending"), ("image_id", "ascending"), ("det_id", "ascending")])
        tp, start = _bits(table, "tp", k), start.sort_by("thr")
        true, false, floor = (np.array([np.frombuffer(v) for v in start[c].to_pylist()]) for c in ("tp", "fp", "floor"))
        npos, best = np.frombuffer(start["pos"][0].as_py()), np.zeros((k, POINTS, b))
        raise_chunk(best, npos, _keys(table), tp.T, (tp | _bits(table, "fp", k)).T, true, true + false, floor)
        names = dict(zip(GROUP, _plain(key)))
        reached = [np.flatnonzero(x.any(axis=1)) for x in best]  # a chunk reaches a few neighbouring recall points
        low = [int(x[0]) if len(x) else 0 for x in reached]
        high = [int(x[-1]) + 1 if len(x) else 1 for x in reached]
        blocks = [(t, lo) for t in range(k) for lo in range(0, b, WIDTH)]
        return pa.table({n: pa.array([v] * len(blocks), pa.string() if n == "slice" else pa.int32()) for n, v in names.items()} | {
            "thr": pa.array([t for t, _ in blocks], pa.int32()), "first": pa.array([lo for _, lo in blocks], pa.int32()),
            "low": pa.array([low[t] for t, _ in blocks], pa.int32()),
            "best": pa.array([np.ascontiguousarray(best[t][low[t] : high[t], lo : lo + WIDTH]).tobytes() for t, lo in blocks], pa.binary())})

    def averages(key, table):
        names = dict(zip([*GROUP, "thr", "first"], _plain(key)))
        best = np.zeros((POINTS, min(WIDTH, b - names["first"])))
        for low, v in zip(table["low"].to_pylist(), table["best"]):
            here = np.frombuffer(v.as_buffer()).reshape(-1, best.shape[1])
            mine = best[low : low + len(here)]
            np.maximum(mine, here, out=mine)
        # precision at a recall: the largest there or beyond
        ap = np.maximum.accumulate(best[::-1], axis=0).sum(axis=0) / POINTS
        return pa.table({n: pa.array([names[n]] * len(ap), pa.string() if n == "slice" else pa.int32()) for n in GROUP} | {
            "replicate": pa.array(np.arange(len(ap)) + names["first"], pa.int32()), "ap": ap})

    left, right = rows.groupBy(*GROUP, "chunk"), starts.groupBy(*GROUP, "chunk")
    best = left.cogroup(right).applyInArrow(points, f"{KEYS}, thr int, first int, low int, best binary")
    ap = best.groupBy(*GROUP, "thr", "first").applyInArrow(averages, f"{KEYS}, replicate int, ap double")
    classes = positives.select("slice", "cls", F.posexplode("pos").alias("replicate", "pos")).filter("pos > 0").select("slice", "cls", "replicate", F.explode(F.array(*map(F.lit, range(len(matches))))).alias("model"))
    # values are added in their own order (classes x thresholds of them), so that equal models differ by 0 and not by a rounding
    means = classes.join(ap, [*GROUP, "replicate"], "left").groupBy("model", "slice", "replicate").agg(F.sort_array(F.collect_list("ap")).alias("ap"), F.size(F.collect_set("cls")).alias("n"))
    return means.select("model", "slice", "replicate", (F.aggregate("ap", F.lit(0.0), lambda total, x: total + x) / (F.col("n") * k)).alias("map"))


def bootstrap_delta(
    base: DataFrame, cand: DataFrame, npos: DataFrame, images: DataFrame, thresholds: list[float], replicates: int = 1000, seed: int = 0, level: float = 0.95, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """slice, delta, ci_low, ci_high, p_le_zero. `base` and `cand` are match tables, `images` has image_id and slice."""
    maps = replicate_maps([base, cand], npos, images, thresholds, replicates, seed, chunk_rows)
    deltas = maps.groupBy("slice", "replicate").agg(F.sum(F.when(F.col("model") == 1, F.col("map")).otherwise(-F.col("map"))).alias("delta"))
    drawn = F.when(F.col("replicate") > 0, F.col("delta"))
    tail = (1 - level) / 2
    return deltas.groupBy("slice").agg(  # `replicates` rows a slice
        F.max(F.when(F.col("replicate") == 0, F.col("delta"))).alias("delta"),
        F.percentile(drawn, F.lit(tail)).alias("ci_low"),
        F.percentile(drawn, F.lit(1 - tail)).alias("ci_high"),
        F.avg((drawn <= 0).cast("double")).alias("p_le_zero"),
    )


def compare(
    arms: dict[str, DataFrame], baseline: str, npos: DataFrame, images: DataFrame, thresholds: list[float], replicates: int = 1000, seed: int = 0, level: float = 0.95, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """arm, slice, map, delta, ci_low, ci_high, p_le_zero of every arm (a match table each) against one of them.

    All arms and slices are replicated in one pass with the same weights, so their differences are paired; an equal arm differs by 0.
    """
    names = [baseline, *(a for a in arms if a != baseline)]
    maps = replicate_maps([arms[a] for a in names], npos, images, thresholds, replicates, seed, chunk_rows)
    base = maps.filter("model = 0").select("slice", "replicate", F.col("map").alias("before"))  # a row a slice and replicate
    named = maps.join(base, ["slice", "replicate"]).withColumns({"arm": F.element_at(F.array(*map(F.lit, names)), F.col("model") + 1), "delta": F.col("map") - F.col("before")})
    drawn, whole = F.when(F.col("replicate") > 0, F.col("delta")), F.col("replicate") == 0
    tail = (1 - level) / 2
    return named.groupBy("arm", "slice").agg(
        F.max(F.when(whole, F.col("map"))).alias("map"), F.max(F.when(whole, F.col("delta"))).alias("delta"),
        F.percentile(drawn, F.lit(tail)).alias("ci_low"), F.percentile(drawn, F.lit(1 - tail)).alias("ci_high"), F.avg((drawn <= 0).cast("double")).alias("p_le_zero"),
    )
