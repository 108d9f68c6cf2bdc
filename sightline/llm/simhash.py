"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit for each bit of the 64-bit hashes of a document's 4-word shingles (repeats count): 1 if more than half of the
hashes have it. Two fingerprints link if at most `RADIUS` bits differ.

1. Fingerprints. Each input batch gives one row for each of its fingerprints with the ids of its documents, so copies are one row.
2. Tiles. Different fingerprints are ordered by their population counts, taken over `parts` equal parts of the 64 bits, and cut into tiles of one such signature and at
   most `TILE` fingerprints. One bit changes one part's count by one, so tiles whose counts differ by more than the radius in all hold no link and never meet.
3. Comparison. Tiles that may meet are paired by their numbers and compared whole, by exclusive-or and bit counts. A pair of tiles gives a spanning
   forest of its links, not the links, so a large family of near copies costs a row a fingerprint and tile.
4. Components. Links are joined; the node of a fingerprint is its smallest document, so a component's label is its smallest document.

The comparison is exact, and so quadratic in the number of different fingerprints; the counts leave some 8% of all pairs of random fingerprints with four parts, 0.4% with eight.

Defined cases: null texts and texts without words have fingerprint zero and link like any other; a null doc_id is no component's smallest one, unless all are null;
repeated rows and doc_ids are documents of their own with the same result; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, Words, in_one_doc, pieces, table, text_buffers
from sightline.llm.components import components

NAME = "op12_simhash_dedup"
WORDS, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a tile at most, and rows of one left tile that are compared at a time.
TILE, STRIP = 2_048, 512
#: Different fingerprints from which eight parts are counted instead of four: tiles are full then.
MANY = 1 << 24
#: Shingles hashed at a time.
RUN = 1 << 18
#: A node: whether the document id is null, the id, the fingerprint; its bytes sort like that.
NODE = 17


def _bits(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """How many hashes of each document have each bit; documents ascend."""
    out = np.zeros((n, 64), np.int64)
    if len(hashes):
        # sums of at most 255 rows fit in bytes, eight of which are added at once
        new = np.flatnonzero(np.diff(doc, prepend=-1))
        rank = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
        at = np.flatnonzero(rank % 255 == 0)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        np.add.at(out, doc[at], np.add.reduceat(bits, at, axis=0).view(np.uint8).astype(np.int64))
    return out


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> np.ndarray:
    """The fingerprint of each of a run of texts."""
    words = Words(data, offsets)
    n, count = len(offsets) - 1, words.count()
    # the words again, in lower case with one space between
    size = words.end - words.start
    start = np.cumsum(size + 1) - size - 1
    joined = np.full(int(size.sum()) + len(size), 32, np.uint8)
    inside = data[words.inside]
    joined[np.arange(len(inside)) + np.repeat(np.arange(len(size)), size)] = np.where((inside >= 65) & (inside <= 90), inside + 32, inside)
    raw, end = joined.tobytes(), start + size
    at, doc = in_one_doc(words.of_doc, k)
    short = np.flatnonzero((count > 0) & (count < k))
    first, last, doc = np.concatenate([at, words.of_doc[short]]), np.concatenate([at + k - 1, words.of_doc[short + 1] - 1]), np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    first, last, doc = start[first[order]], end[last[order]], doc[order]
    ones, hash_of = np.zeros((n, 64), np.int64), xxhash.xxh64_intdigest
    for a in range(0, len(doc), RUN):
        spans = zip(first[a : a + RUN].tolist(), last[a : a + RUN].tolist(), strict=True)
        hashes = np.array([hash_of(raw[i:j], SEED) for i, j in spans], np.uint64)
        ones += _bits(hashes, doc[a : a + RUN], n)
    total = np.bincount(doc, minlength=n)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def printed(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """fp and the doc_ids that have it, one row for each batch and fingerprint."""
    def run(batches):
        for batch in batches:
            ids, (data, offsets) = batch.column(0), text_buffers(batch.column(1))
            found = [np.zeros(0, np.uint64)]
            for a, b in pieces(offsets):
                lo = offsets[a]
                found.append(fingerprints(data[lo : offsets[b]], offsets[a : b + 1] - lo, k))
            fp = np.concatenate(found).view(np.int64)
            order = np.argsort(fp, kind="stable")
            fp = fp[order]
            at = np.flatnonzero(np.concatenate([np.ones(min(1, len(fp)), bool), fp[1:] != fp[:-1]]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(fp)).astype(np.int32)), ids.take(pa.array(order)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[at]), lists], names=["fp", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "fp long, ids array<long>")


def _node_bytes(ids: pa.Array, fp: np.ndarray) -> np.ndarray:
    out = np.zeros((len(fp), NODE), np.uint8)
    out[:, 0] = ids.is_null().to_numpy(zero_copy_only=False)
    doc = ids.fill_null(0).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
    out[:, 1:9] = doc.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 9:] = fp.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8)
    return out


def _signature(fp: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of the parts as digits to base 64, each eight too large, so that the radius borrows from no digit."""
    width, out = 64 // parts, np.zeros(len(fp), np.int64)
    mask = np.uint64((1 << width) - 1)
    for k in range(parts):
        out = out * 64 + np.bitwise_count((fp >> np.uint64(k * width)) & mask).astype(np.int64) + 8
    return out


def _steps(parts: int, radius: int) -> list[int]:
    """Differences of signatures within the radius: zero, and of two opposite ones the positive."""
    found = [(0, 0)]
    for _ in range(parts):
        found = [(value * 64 + d, left + abs(d)) for value, left in found for d in range(-radius, radius + 1) if left + abs(d) <= radius]
    return sorted(value for value, _ in found if value >= 0)


def tiles(classes: DataFrame, parts: int, size: int = TILE) -> DataFrame:
    """tile, signature, nodes (packed); classes have fp and doc_id."""
    def sign(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            nodes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(NODE), len(fp), [None, pa.py_buffer(_node_bytes(batch.column(1), fp.view(np.int64)).tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(_signature(fp, parts)), nodes.cast(pa.binary())], names=["signature", "node"])

    signed = classes.select("fp", "doc_id").mapInArrow(sign, "signature long, node binary")
    ordered = signed.repartitionByRange("signature", "node").sortWithinPartitions("signature")

    def run(batches):
        now, held = None, []
        for batch in batches:
            out, at = [], 0
            sig, nodes = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            ends = np.append(np.flatnonzero(sig[1:] != sig[:-1]) + 1, len(sig)) if len(sig) else []
            for end in (int(e) for e in ends):
                if sig[at] != now:
                    if held:
                        out.append((now, b"".join(held)))
                    now, held = int(sig[at]), []
                held += nodes[at:end]
                while len(held) >= size:
                    out.append((now, b"".join(held[:size])))
                    held = held[size:]
                at = end
            if out:
                yield _rows(out)
        if held:
            yield _rows([(now, b"".join(held))])

    return ordered.mapInArrow(run, "signature long, nodes binary").select(F.monotonically_increasing_id().alias("tile"), "signature", "nodes")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["signature", "nodes"])


def _fps(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(-1, NODE)[:, 9:]).view(">u8").reshape(-1).astype(np.uint64)


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """The smallest row of each row's component; a's rows come first, and links are between a and b. Links are found, and forgotten, a block at a time."""
    label = np.arange(len(a) + len(b))
    for at in range(0, len(a), STRIP):
        for to in range(0, len(b), TILE):
            i, j = np.nonzero(np.bitwise_count(a[at : at + STRIP, None] ^ b[None, to : to + TILE]) <= radius)
            i, j = i + at, j + to + len(a)
            while len(i):
                while (label[label] != label).any():
                    label = label[label]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                # all rows point to roots now, and larger roots to smaller ones next
                np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
    return label


def links(held: DataFrame, parts: int, radius: int = RADIUS) -> DataFrame:
    """A spanning forest (a, b: nodes) of the links of each pair of tiles."""
    slim = held.select("tile", "signature")
    step = F.explode(F.split(F.lit(",".join(map(str, _steps(parts, radius)))), ",").cast("array<long>"))
    left = slim.select(F.col("tile").alias("i"), "signature", step.alias("step")).select("i", "step", (F.col("signature") + F.col("step")).alias("signature"))
    met = left.join(slim.withColumnRenamed("tile", "j"), "signature").filter("step > 0 or i <= j").select("i", "j")
    sent = met.join(held.select(F.col("tile").alias("j"), F.col("nodes").alias("right")), "j")
    both = sent.join(held.select(F.col("tile").alias("i"), F.col("nodes").alias("left")), "i").select("i", "left", "right").sortWithinPartitions("i")

    def compare(left: bytes, right: list[bytes]):
        """One tile with all those of its partners that came in one batch; itself among them or not makes no difference."""
        nodes = left + b"".join(right)
        fp, n = _fps(nodes), len(left) // NODE
        label = forest(fp[:n], fp[n:], radius)
        other = np.flatnonzero(label != np.arange(len(fp)))
        names = np.frombuffer(nodes, np.uint8).reshape(-1, NODE)
        for x, y in zip(names[label[other]], names[other], strict=True):
            if (x != y).any():
                yield x.tobytes(), y.tobytes()

    def run(batches):
        for batch in batches:
            i = batch.column(0).to_numpy()
            if not len(i):
                continue
            out, at = [], 0
            for end in (*(np.flatnonzero(i[1:] != i[:-1]) + 1).tolist(), len(i)):
                out += compare(batch.column(1)[at].as_py(), batch.column(2).slice(at, end - at).to_pylist())
                at = end
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], names=["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def join(docs: DataFrame, k: int = WORDS, radius: int = RADIUS, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every document. `parts` (1, 2, 4, 8) follows the number of fingerprints, unless it is given."""
    scratch = Scratch(docs.sparkSession, "simhash")
    held = scratch.save(printed(docs, k), "prints")
    classes = scratch.save(held.groupBy("fp").agg(F.min(F.array_min("ids")).alias("doc_id")), "classes")
    parts = parts or (4 if classes.count() < MANY else 8)
    met = scratch.save(tiles(classes, parts, tile), "tiles")
    found = scratch.save(links(met, parts, radius), "forests")
    scratch.drop("tiles")
    label = components(found, scratch, "simhash")
    number = lambda c, at: F.conv(F.hex(F.substring(c, at, 8)), 16, 10).cast("decimal(20,0)")
    signed = lambda x: F.when(x >= F.lit(Decimal(2**63)), x - F.lit(Decimal(2**64))).otherwise(x).cast("long")
    # an id is stored with its sign bit changed
    doc = (number("label", 2) - F.lit(Decimal(2**63))).cast("long")
    known = label.select(signed(number("node", 10)).alias("fp"), F.when(F.hex(F.substring("label", 1, 1)) == "00", doc).alias("linked"))
    named = classes.join(known, "fp", "left").select("fp", F.coalesce("linked", "doc_id").alias("component_id"))
    # rows are lists of documents here: a fingerprint of many is one row for each batch
    return held.join(named, "fp").select("fp", "component_id", F.explode("ids").alias("doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
