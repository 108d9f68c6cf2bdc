"""A prefix trie of conversations, merged family first.

A family is the conversations of one base id (conv_id - conv_id % 100). Every conversation c is rebuilt: the first h turns of its
family's base conversation, then its own turns after its first h, where h = crc32(decimal c) % 6. Trie nodes are the distinct
sequences of first d rebuilt turns.

1. Chunks. A turn leaves its text at once: a digest of role and text and the number of code points go on. Turns are ordered by
   (conv_id, turn) over range partitions, so a conversation of any length is dealt to many tasks; runs of at most `CHUNK` turns are packed to a row.
2. Rebuilding. A family's chunks meet without their turns (a count, two sums, the first five digests each); each chunk learns its depth, its path's hash and what it leaves out.
3. Families. Chunks are cogrouped with that by base id, and each family builds its own trie: a row for each of its nodes, with members summed, the smallest member
   and the ids of members that end there. A chunk of a long conversation is a family part of its own.
4. Merging. Only family nodes are shuffled, by path hash; sums combine before the shuffle. Nothing walks the trie by depth:
   * a node belongs to its smallest member, so a conversation owns the tail of its path, and `before` counts the code points of its path before that tail
     (of the whole path, if it owns nothing): what it shares with smaller ones;
   * saved_tokens of a node is the sum of (before - code points above the node) over its members but the owner;
   * n_leaves is the number of members that own a childless node.
   So one more pass over the families, with these two numbers of each conversation, gives both.
5. The hashes of ends: ids arrive sorted by family and are streamed into the digest, so a node that any number of conversations end at takes no memory.

Paths are told apart by 128 bits: sums of turn digests times powers, modulo 2^64.

Defined cases: null role and text are empty; rows of null conv_id are left out; rows of equal turn are ordered by their digests and each counts;
a null turn comes first; an empty table gives no rows; negative ids belong to the base nearer to zero, like conv_id - conv_id % 100 in SQL; other columns are left out.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import _STEP, Scratch, mix, powers, table

NAME = "op11_conversation_trie"
#: Conversations of a family have ids of one hundred; heads have fewer turns than this.
FAMILY, HEADS = 100, 6
#: Turns in a chunk, at most.
CHUNK = 4_096
_MASK, _GOLD = (1 << 64) - 1, np.uint64(0x9E3779B97F4A7C15)
_TURN = np.dtype([("a", "<u8"), ("b", "<u8"), ("chars", "<i8")])

_CHUNKS = "base long, k long, conv_id long, part long, n long, head binary, s0 long, s1 long, chars long, turns binary"
_PLAN = "base long, k long, conv_id long, part long, first boolean, skip long, depth long, p0 long, p1 long, chars long, length long, total long, head binary"
_NODES = "base long, a long, b long, pa long, pb long, depth long, chars long, path long, conv_id long, n long, before long, all_before long, leaves long, ends string"


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in ddl.split(", "))])


def _signed(x: int) -> int:
    x &= _MASK
    return x - (1 << 64) if x >> 63 else x


def _sum(turns: np.ndarray, lane: int) -> int:
    """Digests times powers, modulo 2^64."""
    return int((turns["ab"[lane]] * powers(len(turns), lane)[: len(turns)]).sum(dtype=np.uint64)) if len(turns) else 0


def chunks(conversations: DataFrame, limit: int = CHUNK) -> DataFrame:
    """Runs of at most `limit` turns of one conversation, in order: part numbers ascend with the turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars")
    )
    order = ["conv_id", "turn", "digest"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        first, made = TaskContext.get().partitionId() << 32, 0
        conv, held, size, split = None, [], 0, False

        def rows(last):
            """Full chunks of what is held; with `last`, all of it."""
            nonlocal made, held, size, split
            turns = np.concatenate(held) if held else np.zeros(0, _TURN)
            whole = len(turns) if last else len(turns) - len(turns) % limit
            split = split or len(turns) > limit or not last
            for at in range(0, whole, limit):
                t = turns[at : min(at + limit, whole)]
                part, made = first + made, made + 1
                base = conv - int(np.fmod(conv, FAMILY))
                yield (base, part + 1 if split else 0, conv, part, len(t), t[: HEADS - 1].tobytes(), _signed(_sum(t, 0)), _signed(_sum(t, 1)), int(t["chars"].sum()), t.tobytes())
            held, size = [turns[whole:]], len(turns) - whole

        for batch in batches:
            ids = batch.column(0).to_numpy()
            t = np.zeros(len(ids), _TURN)
            raw = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u8").reshape(-1, 2)
            t["a"], t["b"], t["chars"] = raw[:, 0], raw[:, 1], batch.column(3).to_numpy()
            ends = np.append(np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)) if len(ids) else []
            at, out = 0, []
            for end in (int(e) for e in ends):
                if ids[at] != conv:
                    if conv is not None:
                        out += rows(True)
                    conv, held, size, split = int(ids[at]), [], 0, False
                held.append(t[at:end])
                size += end - at
                if size > 2 * limit:
                    out += rows(False)
                at = end
            if out:
                yield _batch(out, _CHUNKS)
        if conv is not None and size:
            yield _batch(list(rows(True)), _CHUNKS)

    return ordered.mapInArrow(run, _CHUNKS)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _arrow(ddl)
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _first(rows: list[dict], n: int) -> np.ndarray:
    """The first n turns of a conversation, from the heads of its chunks."""
    out, have = [np.zeros(0, _TURN)], 0
    for r in rows:
        if have >= n:
            break
        t = np.frombuffer(r["head"], _TURN)[: n - have]
        out.append(t)
        have += len(t)
    return np.concatenate(out)


def _rebuild(got: pa.Table) -> pa.Table:
    """What each chunk of a family needs to know of its rebuilt conversation."""
    families: dict[int, list[dict]] = {}
    for r in sorted(got.to_pylist(), key=lambda r: (r["conv_id"], r["part"])):
        families.setdefault(r["conv_id"], []).append(r)
    root = _first(families.get(got.column("base")[0].as_py(), []), HEADS - 1)
    inverse = [pow(int(_STEP[lane]), -1, 1 << 64) for lane in (0, 1)]
    out = []
    for conv, rows in families.items():
        h, n = zlib.crc32(str(conv).encode()) % HEADS, sum(r["n"] for r in rows)
        head, own = root[:h], _first(rows, h)
        length = len(head) + max(0, n - h)
        head_chars, own_chars = int(head["chars"].sum()), int(own["chars"].sum())
        total = head_chars + sum(r["chars"] for r in rows) - own_chars
        start, chars, sums = 0, 0, [0, 0]
        for r in rows:
            skip, depth, path, above = min(max(0, h - start), r["n"]), len(head), [_sum(head, lane) for lane in (0, 1)], head_chars
            if start >= h:
                depth, above = depth + start - h, above + chars - own_chars
                shift = [pow(inverse[lane], h - len(head), 1 << 64) for lane in (0, 1)]
                path = [path[lane] + shift[lane] * (sums[lane] - _sum(own, lane)) for lane in (0, 1)]
            if start == 0:
                depth, above, path = 0, 0, [0, 0]  # the head comes with the first chunk
            out.append((r["base"], r["k"], conv, r["part"], start == 0, skip, depth, _signed(path[0]), _signed(path[1]), above, length, total, head.tobytes() if start == 0 else b""))
            for lane in (0, 1):
                sums[lane] = (sums[lane] + pow(int(_STEP[lane]), start, 1 << 64) * r[f"s{lane}"]) & _MASK
            start, chars = start + r["n"], chars + r["chars"]
    return pa.Table.from_batches([_batch(out, _PLAN)])


def _names(path: np.ndarray, depth: np.ndarray) -> np.ndarray:
    return mix(path + (depth.astype(np.uint64) + np.uint64(1)) * _GOLD).view(np.int64)


def family_trie(left: pa.Table, right: pa.Table) -> pa.Table:
    """The nodes of a family: left has its chunks, right what _rebuild found (and, in the second pass, before and leaf of each conversation)."""
    if not left.num_rows or not right.num_rows:
        return _arrow(_NODES).empty_table()
    turns = dict(zip(left.column("part").to_pylist(), left.column("turns").to_pylist(), strict=True))
    rows = right.to_pylist()
    parts = [np.concatenate([np.frombuffer(r["head"], _TURN), np.frombuffer(turns[r["part"]], _TURN)[r["skip"] :]]) for r in rows]
    size = np.array([len(p) for p in parts])
    every = np.concatenate(parts)
    of = np.repeat(np.arange(len(rows)), size)
    at = np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size)
    start = np.array([r["depth"] for r in rows])
    depth = start[of] + at + 1
    names, above = [], []
    for lane in (0, 1):
        scale = np.array([pow(int(_STEP[lane]), int(d), 1 << 64) for d in start], np.uint64)
        value = every["ab"[lane]] * powers(int(size.max()) + 1, lane)[at] * scale[of]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        base = np.array([r[f"p{lane}"] & _MASK for r in rows], np.uint64) - total[np.cumsum(size) - size]
        names.append(_names(total[1:] + base[of], depth))
        above.append(_names(total[:-1] + base[of], depth - 1))
    chars = every["chars"]
    total = np.concatenate([[0], np.cumsum(chars)])
    path = total[1:] + (np.array([r["chars"] for r in rows]) - total[np.cumsum(size) - size])[of]
    # the root, for the first chunk of each conversation
    first = np.flatnonzero([r["first"] for r in rows])
    none = np.zeros(len(first), np.int64)
    top = [_names(np.zeros(len(first), np.uint64), none)] * 2
    a, b, pa_, pb = (np.concatenate(x) for x in zip((*names, *above), (*top, *top), strict=True))
    of, depth, chars, path = (np.concatenate(x) for x in ((of, first), (depth, none), (chars, none), (path, none)))
    conv = np.array([r["conv_id"] for r in rows])[of]
    ends = depth == np.array([r["length"] for r in rows])[of]
    before, leaf = (np.array([r.get(c) or 0 for r in rows], np.int64)[of] for c in ("before", "leaf"))
    order = np.lexsort((conv, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    at = np.flatnonzero(new)
    some, node = order[at], np.cumsum(new) - 1
    said = np.full(len(at), None, object)
    ended = np.flatnonzero(ends[order])
    cuts = np.flatnonzero(np.diff(node[ended])) + 1
    for run in np.split(ended, cuts) if len(ended) else []:
        said[node[run[0]]] = ",".join(map(str, conv[order[run]].tolist()))
    summed = lambda x: np.add.reduceat(x[order], at)
    columns = [np.full(len(at), rows[0]["base"]), a[some], b[some], pa_[some], pb[some], depth[some], chars[some], path[some], conv[some], summed(np.ones(len(order), np.int64)), before[some], summed(before), summed(leaf), said]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _arrow(_NODES), strict=True)], schema=_arrow(_NODES))


def _merged(nodes: DataFrame) -> DataFrame:
    """Family nodes of one path as one node; its owner is the smallest member."""
    same = [F.min(c).alias(c) for c in ("pa", "pb", "depth", "chars", "path")]
    return nodes.groupBy("a", "b").agg(*same, F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.min_by("before", "conv_id").alias("before"), F.sum("all_before").alias("all_before"), F.sum("leaves").alias("leaves"))


def _digests(nodes: DataFrame) -> DataFrame:
    """The SHA-256 of the sorted ids that end at each node."""
    rows = nodes.filter("ends is not null").select("a", "b", "base", "ends").repartition("a", "b").sortWithinPartitions("a", "b", "base")

    def run(batches):
        now, base, ids, digest, begun = None, None, [], None, False

        def write():
            nonlocal ids, begun
            if ids:
                digest.update((("," if begun else "") + ",".join(map(str, sorted(ids)))).encode())
                ids, begun = [], True

        for batch in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:2] != now:
                    if now is not None:
                        write()
                        out.append((*now, digest.hexdigest()))
                    now, base, digest, begun = r[:2], None, hashlib.sha256(), False
                if r[2] != base:  # parts of one family are merged, families follow each other
                    write()
                    base = r[2]
                ids += map(int, r[3].split(","))
            yield _batch(out, "a long, b long, ends_sha256 string")
        if now is not None:
            write()
            yield _batch([(*now, digest.hexdigest())], "a long, b long, ends_sha256 string")

    return rows.mapInArrow(run, "a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, limit: int = CHUNK) -> DataFrame:
    """One row for each node; conv_id and depth name it."""
    scratch = Scratch(conversations.sparkSession, "trie")
    held = scratch.save(chunks(conversations, limit), "chunks")
    plan = scratch.save(held.drop("turns").groupBy("base").applyInArrow(_rebuild, _PLAN), "plan")
    parts = held.select("base", "k", "part", "turns").groupBy("base", "k")
    nodes = scratch.save(parts.cogroup(plan.groupBy("base", "k")).applyInArrow(family_trie, _NODES), "nodes")
    merged = scratch.save(_merged(nodes), "merged")
    children = scratch.save(merged.filter("depth > 0").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children")), "children")
    under = children.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children")
    owners = merged.join(under, ["a", "b"], "left").groupBy("conv_id").agg(F.min(F.col("path") - F.col("chars")).alias("before"), F.max(F.col("n_children").isNull().cast("int")).alias("leaf"))
    told = plan.join(owners, "conv_id", "left").withColumns({"before": F.coalesce("before", "total"), "leaf": F.coalesce("leaf", F.lit(0))})
    again = scratch.save(_merged(parts.cogroup(told.groupBy("base", "k")).applyInArrow(family_trie, _NODES)), "again")
    scratch.drop("chunks", "plan", "merged")
    # parents: the root's children are many, so its one row is sent to them
    low = again.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("depth").alias("above"))
    top, low = (x.drop("above") for x in (low.filter("above = 0"), low.filter("above > 0")))
    named = again.filter("depth = 1").join(F.broadcast(top), ["pa", "pb"]).select(*again.columns, "parent_conv_id")
    named = named.unionByName(again.filter("depth > 1").join(low, ["pa", "pb"]).select(*again.columns, "parent_conv_id"))
    named = named.unionByName(again.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = named.join(under, ["a", "b"], "left").join(_digests(nodes), ["a", "b"], "left")
    saved = F.col("all_before") - F.col("before") - (F.col("n") - 1) * (F.col("path") - F.col("chars"))
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))
