"""N-gram Jaccard join by universe partitions.

A document is the set of its distinct 5-word shingles (hashed to 64 bits). Two sets link if their Jaccard similarity reaches the
threshold t. Identical sets form one class; the join is between classes.

1. Own shingles. Linked sets differ in at most (|A| + |B|) (1 - t) / (1 + t) shingles, and a shingle that no other class holds differs from all. Pieces of the
   table ask each other which shingles occur elsewhere (see exchange.py). A class with more own shingles than its largest possible partner
   allows has no link, and neither has a pair whose own shingles add up to more than the pair may differ in.
2. Universe partition of what is left. Sets are dealt to bands by size, each band twice as wide as the one before. A set works in its own
   band and, if a larger partner can exist there, in the next. Shingles are hashed to the band's segments; a set's subset in a segment is a signature.
   For each band the cheaper of two exact schemes is taken (rows to send plus expected chance meetings):
     exact     m segments, some more than the U + 1 that pigeonholes ask for (U: shingles that two sets of the band differ in at most). A differing
               shingle spoils one segment, so linked sets share m - U signatures at least. In one order of all signatures (those of common shingles last)
               they share one of the first U + 1 of each: these are sent, without those that hold an own shingle.
     deletion  ceil((U + 1) / 2) segments, sent whole and with each one shingle deleted: some segment differs in at most one.
3. Meetings. The best connected class of a signature leads it. Each class is compared with the leader it meets most; links join
   components. Where a signature's classes still lie in different components, all of them are compared across components by sketches: a sketch holds the
   parities of the set's shingles by hash, and two sets differ in as many shingles at least as their sketches do in bits. Signatures with
   many classes are dealt in blocks. Pairs that sketches and own shingles allow are verified.
4. Verification compares whole shingle sets.

No pair within a component is compared after the first round, so a large family of copies costs a comparison a member, and no link between components is lost.

Defined cases: texts with fewer words than a shingle have the whole sequence as one; null texts and texts without words have the empty
set, no link, and themselves as component; identical rows, and rows of one doc_id, are documents of their own with
the same result where their sets are equal; a null doc_id belongs to its set's component and counts last; an empty
table gives no rows; other columns are left out of `join` and kept by `keep_one`, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import exchange
from sightline.llm.common import Scratch, Words, mix, pieces, table, text_buffers, text_bytes, windows
from sightline.llm.components import components

NAME = "op8_ngram_jaccard_join"
WORDS = 5
#: Similarity as a fraction: intersection * DEN >= union * NUM.
NUM, DEN = 3, 4
#: Segments of an exact band, as a multiple of those that pigeonholes ask for.
SPREAD = 1.5
#: Weight of a chance meeting against a row sent.
MEETING = 100
#: Bits of the largest sketch.
SKETCH = 4096
#: Bytes that a row counts in a piece besides its text, and bits of a row's number there.
ROW_BYTES, ROW_BITS = 16, 21
#: Classes of a signature that are compared in one block.
BLOCK = 2048
#: Rows of signature and class in a group, about.
GROUP_ROWS = 16_384
_SEGMENT, _BAND = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_TAG = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a run of documents, and the count up to each document."""
    words = Words(data, offsets)
    h, n = words.hashes(lower=True), words.count()
    size = np.where(n >= k, n - k + 1, n > 0)
    doc = np.repeat(np.arange(len(n)), size)
    out = np.zeros(len(doc), np.uint64)
    ends = np.cumsum(size)
    long = n[doc] >= k
    if long.any():
        at = np.arange(len(doc)) - (ends - size)[doc] + words.of_doc[:-1][doc]
        out[long] = windows(h, k)[at[long]]
    for d in np.flatnonzero((n > 0) & (n < k)):
        part = h[words.of_doc[d] : words.of_doc[d + 1]]
        out[ends[d] - 1] = windows(part, len(part))[0] ^ _TAG
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    out, doc = out[first], doc[first]
    return out, np.searchsorted(doc, np.arange(len(n) + 1))


def prints(sets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    out = []
    for salt in (_TAG, _BAND):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ salt))])
        out.append(mix(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(np.uint64) * _SEGMENT).view(np.int64))
    return out[0], out[1]


def may_differ(a, b):
    """Shingles that linked sets of these sizes differ in at most."""
    return ((DEN - NUM) * (a + b)) // (DEN + NUM)


class Bands:
    """Band k holds the sizes from 2^k to 2^(k+1) - 1."""

    def __init__(self, n: int = 40):
        high = (2 << np.arange(n)) - 1
        self.differ = may_differ(high, high)
        middle = 0.75 * (high + 1)
        exact = np.ceil(SPREAD * (self.differ + 1)).astype(np.int64)
        deletion = (self.differ + 2) // 2
        # the fewer shingles a subset has, the likelier a chance meeting
        cost_exact = (self.differ + 1) * (1 + MEETING * np.exp(-middle / exact))
        cost_deletion = (deletion + middle) * (1 + MEETING * np.exp(1 - middle / deletion))
        # of several segments some hold one shingle or none, and what deletion leaves of them meets everywhere
        cost_deletion += np.where(deletion > 1, MEETING**2 * deletion * np.exp(-middle / deletion) * (1 + middle / deletion), 0)
        self.deletes = (cost_deletion < cost_exact) & (self.differ > 0)
        self.segments = np.where(self.deletes, deletion, exact)

    @staticmethod
    def of(size: np.ndarray) -> np.ndarray:
        return np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)


BANDS = Bands()


def signatures(sets: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures sent for a run of sets, and the set of each. `kind` has for each shingle 0 if it is the set's own, else how common it is."""
    size = np.diff(ends)
    own = Bands.of(size)
    largest = size * DEN // NUM  # of a partner
    up = largest >= 2 << own
    which = np.concatenate([np.flatnonzero(size > 0), np.flatnonzero(up)])
    band = np.concatenate([own[size > 0], own[up] + 1])
    single = BANDS.differ[band] == 0  # only equal sets link, and those are one class
    which, band = which[~single], band[~single]
    if not len(which):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m, count = BANDS.segments[band], size[which]
    base = np.cumsum(m) - m
    entry = np.repeat(np.arange(len(which)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(ends[which], count)
    token = sets[at]
    cell = base[entry] + (mix(token + _BAND) % m[entry].astype(np.uint64)).astype(np.int64)
    total = np.zeros(int(m.sum()), np.uint64)
    np.add.at(total, cell, mix(token))
    of_cell = np.repeat(np.arange(len(which)), m)
    salt = band.astype(np.uint64)[of_cell] * _BAND + (np.arange(len(total)) - base[of_cell]).astype(np.uint64) * _SEGMENT
    whole = mix(total + salt)
    common = np.zeros(len(total), np.uint8)
    np.maximum.at(common, cell, kind[at])
    common[np.bincount(cell, minlength=len(total)) == 0] = 4  # all sets of the band share it
    lonely = np.bincount(cell, weights=kind[at] == 0, minlength=len(total)) > 0
    exact = ~BANDS.deletes[band]
    # a set differs from a partner in so many shingles at most, and of the first as many signatures and one more they share one
    first = may_differ(count, np.minimum(largest[which], (2 << band) - 1)) + 1
    order = np.lexsort((whole, np.where(lonely, 0, common + 1), of_cell))
    rank = np.arange(len(total)) - base[of_cell]
    sent = order[(~exact[of_cell] | (rank < first[of_cell])) & ~(lonely[order] & exact[of_cell])]
    out, of = [whole[sent]], [which[of_cell[sent]]]
    less = ~exact[entry]
    if less.any():
        c = cell[less]
        out.append(mix(total[c] - mix(token[less]) + salt[c]))
        of.append(which[entry[less]])
    return np.concatenate(out), np.concatenate(of)


def sketch(sets: np.ndarray) -> bytes:
    """The sketch of one set: its band's number of bits, and as many of the next band's."""
    own = int(Bands.of(np.array([len(sets)]))[0])
    out = []
    for band in (own, own + 1):
        bits = min(SKETCH, max(64, 4 << band))
        parity = np.bincount((mix(sets ^ _SEGMENT) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
        out.append(np.packbits(parity.astype(bool)).tobytes())
    return b"".join(out)


def _pieces(docs: DataFrame, scratch: Scratch, k: int, total: int) -> DataFrame:
    """The table of pieces: piece, at (place there), doc_id, n (set size), h and g (fingerprints), text and row (all other columns)."""
    rest = [c for c in docs.columns if c != "text"]
    shaped = docs.select(F.col("doc_id").cast("long"), "text", F.struct(*rest).alias("row"))
    names = ["piece", "at", "doc_id", "n", "h", "g", "text", "row"]

    def run(batches):
        piece, at, size = TaskContext.get().partitionId() << 12, 0, 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in pieces(offsets):
                if size >= exchange.PIECE_BYTES:
                    piece, at, size = piece + 1, 0, 0
                lo, part = offsets[a], batch.slice(a, b - a)
                sets, ends = shingle_sets(data[lo : offsets[b]], offsets[a : b + 1] - lo, k)
                h, g = prints(sets, ends)
                columns = [pa.array(np.full(b - a, piece)), pa.array(np.arange(at, at + b - a, dtype=np.int32)), part.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(h), pa.array(g), part.column(1), part.column(2)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at, size = at + b - a, size + int(offsets[b] - lo) + ROW_BYTES * (b - a)

    types = [T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.StringType(), shaped.schema["row"].dataType]
    schema = T.StructType([T.StructField(*f) for f in zip(names, types, strict=True)])
    return scratch.bucketed(shaped.mapInArrow(run, schema), "pieces", "piece", max(1, total // exchange.PIECE_BYTES))


class _Classes:
    """The classes that one piece speaks for: their sets, and the answers about their shingles."""

    def __init__(self, left: pa.Table, right: pa.Table, k: int, buckets: int):
        self.piece = left.column("piece")[0].as_py()
        at = left.column("at").to_numpy()
        said = right.to_pydict()
        chosen = np.array(sorted(x for b, x in zip(said["bucket"], said["at"], strict=True) if b < 0), np.int64)
        self.at = chosen
        where = np.argsort(at)[np.searchsorted(np.sort(at), chosen)]
        self.texts = left.column("text").combine_chunks().take(pa.array(where))
        data, offsets = text_buffers(self.texts)
        found, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in pieces(offsets):
            lo = offsets[a]
            sets, ends = shingle_sets(data[lo : offsets[b]], offsets[a : b + 1] - lo, k)
            found.append(sets)
            sizes.append(np.diff(ends))
        self.sets = np.concatenate(found)
        self.ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.known, self.where, self.times = np.unique(self.sets, return_inverse=True, return_counts=True)
        self.said, self.buckets = said, buckets

    def node(self) -> np.ndarray:
        return (self.piece << ROW_BITS) + self.at

    def kinds(self) -> np.ndarray:
        """0 for a shingle that no other class holds, else 1 to 3 as more pieces hold it."""
        answers = [(b, x) for b, x in zip(self.said["bucket"], self.said["bits"], strict=True) if b >= 0]
        kind = exchange.read(self.known, self.buckets, [b for b, _ in answers], [x for _, x in answers], planes=2)
        return np.maximum(kind, self.times > 1)[self.where]


def _kept(held: DataFrame, chosen: DataFrame, scratch: Scratch, k: int, buckets: int) -> DataFrame:
    """Classes that may have a link: node, n, own (shingles), sketch, signatures, text."""
    def ask(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "piece": pa.array([], pa.int64()), "low": pa.array([], pa.binary())})
        found = _Classes(left, right, k, buckets)
        return exchange.cut(found.piece, found.known, buckets, low=exchange.low_bytes(found.known, 3))

    def keep(left, right):
        rows = []
        if left.num_rows and right.num_rows:
            found = _Classes(left, right, k, buckets)
            kind, n, node = found.kinds(), np.diff(found.ends), found.node()
            own = np.diff(np.concatenate([[0], np.cumsum(kind == 0)])[found.ends])
            stay = own <= may_differ(n, n * DEN // NUM)
            for a, b in pieces(found.ends * 8):
                some = np.flatnonzero(stay[a:b])
                if not len(some):
                    continue
                pick = np.repeat(stay[a:b], n[a:b])
                sets, kinds = found.sets[found.ends[a] : found.ends[b]][pick], kind[found.ends[a] : found.ends[b]][pick]
                ends = np.concatenate([[0], np.cumsum(n[a:b][some])])
                sig, of = signatures(sets, ends, kinds)
                order = np.argsort(of, kind="stable")
                sig, cuts = sig[order].view(np.int64), np.searchsorted(of[order], np.arange(len(some) + 1))
                for q, x in enumerate((some + a).tolist()):
                    if cuts[q] < cuts[q + 1]:
                        rows.append((node[x], n[x], own[x], sketch(sets[ends[q] : ends[q + 1]]), np.unique(sig[cuts[q] : cuts[q + 1]]), found.texts[x].as_py()))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds_of = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.string()]
        return pa.table({name: pa.array(list(c), t) for name, c, t in zip(("node", "n", "own", "sketch", "signatures", "text"), columns, kinds_of, strict=True)})

    rows = held.select("piece", "at", "text").groupBy("piece")
    none = F.lit(None).cast("binary").alias("bits")
    named = chosen.select("piece", F.lit(-1).alias("bucket"), "at", none)
    answers = scratch.save(exchange.kinds(rows.cogroup(named.groupBy("piece")).applyInArrow(ask, exchange.sent_schema("low"))), "shingles")
    told = named.unionByName(answers.select("piece", "bucket", F.lit(None).cast("int").alias("at"), "bits"))
    return rows.cogroup(told.groupBy("piece")).applyInArrow(keep, "node long, n long, own long, sketch binary, signatures array<long>, text string")


def _allowed(a: str = "a", b: str = "b"):
    """The own shingles of both sets leave room for a link, and so do their sizes."""
    n, own = F.col(f"n_{a}") + F.col(f"n_{b}"), F.col(f"own_{a}") + F.col(f"own_{b}")
    sizes = (DEN * F.col(f"n_{a}") >= NUM * F.col(f"n_{b}")) & (DEN * F.col(f"n_{b}") >= NUM * F.col(f"n_{a}"))
    return sizes & ((DEN + NUM) * own <= (DEN - NUM) * n)


def _links(pairs: DataFrame, kept: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    near = pairs.select("a", "b").join(kept.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = near.join(kept.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        for batch in batches:
            sides = [text_buffers(batch.column(c)) for c in (2, 3)]
            keep = np.zeros(batch.num_rows, bool)
            for a, b in pieces(sides[0][1] + sides[1][1]):
                tokens, pair = [], []
                for data, offsets in sides:
                    lo = offsets[a]
                    sets, ends = shingle_sets(data[lo : offsets[b]], offsets[a : b + 1] - lo, k)
                    tokens.append(sets)
                    pair.append(np.repeat(np.arange(b - a), np.diff(ends)))
                token, of = np.concatenate(tokens), np.concatenate(pair)
                order = np.lexsort((token, of))
                token, of = token[order], of[order]
                same = np.bincount(of[1:][(token[1:] == token[:-1]) & (of[1:] == of[:-1])], minlength=b - a)
                keep[a:b] = DEN * same >= NUM * (np.bincount(of, minlength=b - a) - same)
            part = batch.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _sketches(raw: list[bytes], band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of all rows in their own and in the next band, as 64-bit words, with zeros after the shorter ones."""
    size = np.minimum(SKETCH, np.maximum(64, 4 << np.arange(int(band.max()) + 2))) // 8
    own, up = (np.zeros((len(raw), int(size[-1])), np.uint8) for _ in range(2))
    for k, (x, b) in enumerate(zip(raw, band.tolist(), strict=True)):
        own[k, : size[b]] = np.frombuffer(x, np.uint8, size[b])
        up[k, : size[b + 1]] = np.frombuffer(x, np.uint8, size[b + 1], size[b])
    return own.view("<u8"), up.view("<u8")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of a signature's classes of different components that own shingles, sizes and sketches allow.

    A group holds whole blocks of many signatures. Its rows are sorted by signature, and each is compared with the first, second, ... row after it.
    """
    def run(got):
        got = got.take(np.argsort(got.column("signature").to_numpy(), kind="stable"))
        sig, node, label, n, own, side = (got.column(c).to_numpy() for c in ("signature", "node", "label", "n", "own", "side"))
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        left = np.repeat(first + size, size) - 1 - np.arange(len(sig))  # rows of the signature after each one
        band = Bands.of(n)
        low, high = _sketches(got.column("sketch").to_pylist(), band)
        out = [np.zeros((2, 0), np.int64)]
        x, step = np.arange(len(sig)), 0
        while len(x := x[left[x] > step]):
            step += 1
            y = x + step
            fits = (label[x] != label[y]) & ((side[x] | side[y]) == 3) & (DEN * n[x] >= NUM * n[y]) & (DEN * n[y] >= NUM * n[x]) & (own[x] + own[y] <= may_differ(n[x], n[y]))
            p, q = x[fits], y[fits]
            p, q = np.where(n[p] <= n[q], p, q), np.where(n[p] <= n[q], q, p)
            for a in range(0, len(p), BLOCK):
                u, v = p[a : a + BLOCK], q[a : a + BLOCK]
                mine = np.where((band[u] == band[v])[:, None], low[u], high[u])
                apart = np.bitwise_count(mine ^ low[v]).sum(axis=1, dtype=np.int64)
                u, v = (c[apart <= may_differ(n[u], n[v])] for c in (u, v))
                out.append(np.stack([np.minimum(node[u], node[v]), np.maximum(node[u], node[v])]))
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": a, "b": b})

    return rows.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def _labels(kept: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """node and label (the smallest node of its component) of all classes that have a link."""
    one = kept.select("node", F.explode("signatures").alias("signature"), F.size("signatures").alias("score"))
    leads = one.groupBy("signature").agg(F.max(F.struct("score", (-F.col("node")).alias("order"), "node")).alias("lead"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    leads = scratch.save(leads.select("signature", F.col("lead.node").alias("a"), "members"), "leads")
    members = scratch.save(one.select("signature", F.col("node").alias("b")).join(leads, "signature"), "members")
    # first round: each class with the leader that it meets most
    facts = scratch.save(kept.select("node", "n", "own"), "facts")
    side = lambda c: facts.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("own").alias(f"own_{c}"))
    met = members.filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    met = met.join(side("a"), "a").join(side("b"), "b").filter(_allowed())
    best = met.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")).select("a", "b")
    links = scratch.save(_links(best, kept, k), "links1")
    label = components(links, scratch, "first")
    # then whoever met and is still apart
    named = members.select("signature", "members", F.col("b").alias("node")).join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    apart = named.groupBy("signature").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("signature")
    rest = scratch.save(named.join(apart, "signature", "left_semi"), "rest")
    buckets = rest.count() // GROUP_ROWS + 1
    rest = rest.join(kept.select("node", "n", "own", "sketch"), "node").withColumn("bucket", F.pmod(F.xxhash64("signature"), F.lit(buckets)))
    # blocks i <= j of a signature; side 1: left, 2: right, 3: both
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rest = rest.withColumn("k", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    others = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")
    rest = rest.select("bucket", "signature", "node", "label", "n", "own", "sketch", "k", others)
    rest = rest.select("bucket", "signature", F.least("k", "other").alias("i"), F.greatest("k", "other").alias("j"), F.when(F.col("k") == F.col("other"), 3).when(F.col("k") < F.col("other"), 1).otherwise(2).alias("side"), "node", "label", "n", "own", "sketch")
    later = scratch.save(_across(rest).distinct(), "apart")
    return components(links.unionByName(_links(later, kept, k)), scratch, "all")


def _found(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame, Scratch]:
    """The table of pieces, and (h, g, n, label, component_id) of each class of sets."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    total = text_bytes(docs)
    held = _pieces(docs, scratch, k, total)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "piece", "at")
    classes = held.filter("n > 0").groupBy("h", "g", "n").agg(F.min(F.struct("piece", "at")).alias("at"), F.min(place).alias("first"))
    classes = classes.select("h", "g", "n", F.col("at.piece").alias("piece"), F.col("at.at").alias("at"), F.col("first.doc_id").alias("doc_id"), "first")
    classes = scratch.save(classes.withColumn("node", F.shiftleft("piece", ROW_BITS) + F.col("at")), "classes")
    kept = scratch.save(_kept(held, classes.select("piece", "at"), scratch, k, exchange.buckets_for(total)), "kept")
    labels = _labels(kept, scratch, k)
    named = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.min("first").alias("chosen"))
    return held, scratch.save(named.select("h", "g", "n", "label").join(smallest, "label"), "components"), scratch


def join(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, label and component_id of every document.

    The label names the component (null without shingles); component_id, its smallest doc_id, does not, as doc_ids may be null or repeat.
    """
    held, found, _ = _found(docs.select("doc_id", "text"), k)
    out = held.select("doc_id", "n", "h", "g").join(found, ["h", "g", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "label", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """One row of each component (that of the smallest doc_id), with all its columns; rows without words all stay."""
    held, found, scratch = _found(docs, k)
    chosen = found.select("chosen.piece", "chosen.at").distinct().unionByName(held.filter("n = 0").select("piece", "at"))
    # for each piece, which of its rows stay: the pieces need not move
    every = held.select("piece", "at").join(chosen.withColumn("stays", F.lit(True)), ["piece", "at"], "left")
    flags = every.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("stays", F.lit(False)).alias("stays"))))["stays"].alias("stays"))
    rows = held.join(scratch.save(flags, "stays"), "piece").filter(F.col("stays")[F.col("at")])
    return rows.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
