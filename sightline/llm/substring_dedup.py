"""Substring dedup with difference-cover anchors.

A window of `WINDOW` words is removed if its word sequence also starts earlier (in a smaller doc_id, or earlier in the same document).
Any two equal windows agree at all their places, and for any two starts there is a shift below the period for which both
land on the cover modulo that period. So short anchors of WINDOW - PERIOD + 1 words, hashed only at the places of each
document that lie on the cover, meet for every pair of equal windows.

Texts move once: they are sorted by document to a table of pieces (some MB each, in ascending order), bucketed by piece. What follows is
between pieces (see exchange.py):

1. Texts that repeat an earlier document whole are told by two hashes of their row; all their windows are repeats.
2. Anchors of the other texts: which of them does some other place hold too?
3. At those places the anchors extend: all windows that hold such an anchor are hashed (96 bits, beside the bucket's). A piece sends each distinct
   window once, and the answer says whether an earlier piece holds it. Within a piece all but the first place are repeats.
4. Each piece drops the words that repeats cover.

No pairs are made, and a passage that a third of the documents share is one element for each piece that holds it.

Defined cases: a null or empty text has no words, keeps none and has the hash of the empty text; a text shorter than a window keeps all; documents
of one doc_id are ordered by their text's hash, and rows equal in doc_id and text are one document (they lie in one piece), each row getting its result; a
null doc_id comes last; an empty table gives no rows; `dedup` keeps all other columns, whatever their names, but for those it adds (n_words, n_removed).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm import exchange
from sightline.llm.common import SPACE, Scratch, Words, in_one_doc, pieces, table, text_buffers, text_bytes, windows

NAME = "op9_substring_dedup"
WINDOW = 20
#: A perfect difference set: every shift modulo the period is a difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: The bucket number of a message that names a document, not an answer.
COPY = -1
_LAST = np.iinfo(np.int64).max
_ON_COVER = np.isin(np.arange(PERIOD), COVER)


class Piece:
    """The documents of one piece in ascending order, and what was said about them."""

    def __init__(self, rows: pa.Table, messages: pa.Table):
        self.number = rows.column("piece")[0].as_py()
        ids, h, g = (rows.column(c).to_numpy() for c in ("id", "h", "g"))
        self.order = np.lexsort((g, h, ids))
        ids, h, g = ids[self.order], h[self.order], g[self.order]
        #: Row in order that each row repeats, in doc_id and text.
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        self.first = np.flatnonzero(new)[np.cumsum(new) - 1]
        said = messages.select(["bucket", "id", "h", "bits"]).to_pydict()
        named = {(i, x) for b, i, x in zip(said["bucket"], said["id"], said["h"], strict=True) if b == COPY}
        self.copies = np.array([k in named for k in zip(ids.tolist(), h.tolist(), strict=True)], bool) if named else np.zeros(len(ids), bool)
        self.live = np.flatnonzero(new & ~self.copies)
        texts = rows.column("text").combine_chunks().take(pa.array(self.order[self.live]))
        self.data, self.offsets = text_buffers(texts)
        at = {k: [i for i, b in enumerate(said["bucket"]) if b != COPY and (b >> 30) == k] for k in (0, 1)}
        #: Answers about anchors and about windows.
        self.anchors, self.windows = (([said["bucket"][i] & ((1 << 30) - 1) for i in at[k]], [said["bits"][i] for i in at[k]]) for k in (0, 1))

    def runs(self):
        """First live document, words and places of the anchors of each run of documents."""
        for a, b in pieces(self.offsets):
            lo = self.offsets[a]
            words = Words(self.data[lo : self.offsets[b]], self.offsets[a : b + 1] - lo)
            at, doc = in_one_doc(words.of_doc, ANCHOR)
            use = _ON_COVER[(at - words.of_doc[:-1][doc]) % PERIOD] & (words.count()[doc] >= WINDOW)
            yield a, words, at[use], doc[use]

    def anchor_hashes(self) -> np.ndarray:
        found = [windows(words.hashes(), ANCHOR)[at] for _, words, at, _ in self.runs()]
        return np.concatenate(found) if found else np.zeros(0, np.uint64)

    def extended(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Live document, place and both hashes of all windows that hold an anchor found elsewhere, in ascending order of places."""
        h = self.anchor_hashes()
        known, where, times = np.unique(h, return_inverse=True, return_counts=True)
        again = ((exchange.read(known, buckets, *self.anchors, planes=2) > 0) | (times > 1))[where]
        out, done = [], 0
        for a, words, at, doc in self.runs():
            hit = again[done : done + len(at)]
            done += len(at)
            at, doc = at[hit], doc[hit]
            start, n = words.of_doc[:-1][doc], words.count()[doc]
            # windows that start up to PERIOD - 1 words before the anchor, within the document
            low, high = np.maximum(at - (PERIOD - 1), start), np.minimum(at, start + n - WINDOW)
            good = low <= high
            edge = np.bincount(low[good], minlength=len(words.start) + 2) - np.bincount(high[good] + 1, minlength=len(words.start) + 2)
            at = np.flatnonzero(np.cumsum(edge) > 0)
            if len(at):
                of = np.searchsorted(words.of_doc, at, "right") - 1
                out.append((a + of, at - words.of_doc[of], windows(words.hashes(), WINDOW)[at], windows(words.hashes(seed=1), WINDOW, 1)[at]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def removed(self, buckets: int) -> list[np.ndarray | None]:
        """For each live document, whether each of its words goes; None if none does."""
        doc, place, h, g = self.extended(buckets)
        order, first, of = distinct(h, g)
        earlier = exchange.read(h[order[first]], buckets, *self.windows, planes=1) > 0
        gone = earlier[of]
        gone[np.setdiff1d(np.arange(len(order)), first, assume_unique=True)] = True
        gone = np.sort(order[gone])
        out: list[np.ndarray | None] = [None] * len(self.live)
        doc, place = doc[gone], place[gone]
        at = np.flatnonzero(np.diff(doc, prepend=-1)) if len(doc) else np.zeros(0, int)
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(doc)]):
            edge = np.zeros(int(place[j - 1]) + WINDOW + 1, np.int32)
            np.add.at(edge, place[i:j], 1)
            np.add.at(edge, place[i:j] + WINDOW, -1)
            out[doc[i]] = np.cumsum(edge)[:-1] > 0
        return out


def distinct(h: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements by hash, equal ones in their order; the first of each kind there, and the kind of each."""
    order = np.lexsort((g, h))
    a, b = h[order], g[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new), np.cumsum(new) - 1


def _to_earlier(sent: DataFrame) -> DataFrame:
    """Which of the windows sent does an earlier piece hold?"""
    def run(got):
        got = got.take(np.argsort(got.column("piece").to_numpy(), kind="stable"))
        h = np.frombuffer(b"".join(got.column("hash").to_pylist()), "<u8")
        g = np.frombuffer(b"".join(got.column("check").to_pylist()), "<u4")
        sizes = np.array([len(x) for x in got.column("hash").to_pylist()], np.int64) // 8
        order, first, _ = distinct(h, g)
        later = np.ones(len(h), bool)
        later[order[first]] = False
        return exchange.replies(got, sizes, later)

    return sent.groupBy("bucket").applyInArrow(run, exchange.REPLY)


def _numbered(replies: DataFrame, kind: int) -> DataFrame:
    """Answers as messages; the kind goes along in the bucket's number."""
    none = F.lit(None).cast("long")
    return replies.select("piece", F.col("bucket").bitwiseOR(F.lit(kind << 30)).alias("bucket"), none.alias("id"), none.alias("h"), "bits")


def reduced(docs: DataFrame, as_is: bool = False) -> DataFrame:
    """Rows of (row: all columns but text, kept: the words left joined by single spaces, n_words, n_removed).

    With `as_is`, a text of which nothing is removed stays as it is, white space and all.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    total = text_bytes(docs)
    buckets = exchange.buckets_for(total)
    number = max(1, total // exchange.PIECE_BYTES)
    keyed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), "text")
    # a window takes 39 bytes at least
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACE + "+"), "")
    short = keyed.filter(size < 2 * WINDOW - 1).select("row", (F.col("text") if as_is else F.array_join(words, " ")).alias("kept"), F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"))
    long = keyed.filter(size >= 2 * WINDOW - 1).withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")})
    ranged = long.repartitionByRange(number, "id", "h", "g").withColumn("piece", F.spark_partition_id().cast("long"))
    held = scratch.bucketed(ranged.select("piece", "id", "h", "g", "row", "text"), "pieces", "piece", number)

    # rows that repeat the text of an earlier document
    keys = held.select("piece", "id", "h", "g")
    first = keys.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").drop("last")
    copies = keys.join(first, ["h", "g"]).filter("id > first").select("piece", F.lit(COPY).alias("bucket"), "id", "h", F.lit(None).cast("binary").alias("bits")).distinct()
    copies = scratch.save(copies, "copies")

    def anchors(left, right):
        piece = Piece(left, right)
        h = np.unique(piece.anchor_hashes())
        return exchange.cut(piece.number, h, buckets, low=exchange.low_bytes(h, 3))

    def extended(left, right):
        piece = Piece(left, right)
        _, _, h, g = piece.extended(buckets)
        order, first, _ = distinct(h, g)
        h, g = h[order[first]], g[order[first]]
        return exchange.cut(piece.number, h, buckets, hash=h.astype("<u8"), check=g.astype("<u4"))

    def ask(messages: DataFrame, run, schema) -> DataFrame:
        def guarded(left, right):
            return run(left, right) if left.num_rows else empty
        empty = pa.table({f.name: pa.array([], _ARROW[f.dataType.simpleString()]) for f in T._parse_datatype_string(schema)})
        return held.select("piece", "id", "h", "g", "text").groupBy("piece").cogroup(messages.groupBy("piece")).applyInArrow(guarded, schema)

    near = scratch.save(exchange.kinds(ask(copies, anchors, exchange.sent_schema("low"))), "anchors")
    messages = copies.unionByName(_numbered(near, 0))
    repeats = scratch.save(_to_earlier(ask(messages, extended, exchange.sent_schema("hash", "check"))), "repeats")
    messages = messages.unionByName(_numbered(repeats, 1))
    schema = T.StructType([T.StructField("row", held.schema["row"].dataType), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def drop(left, right):
        if not left.num_rows:
            return left.select(["row"]).append_column("kept", pa.array([], pa.string())).append_column("n_words", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64()))
        piece = Piece(left, right)
        gone = dict(zip(piece.live.tolist(), piece.removed(buckets), strict=True))
        kept, counts, removed = [], [], []
        texts = left.column("text").take(pa.array(piece.order)).to_pylist()
        for k, text in enumerate(texts):
            if piece.first[k] < k:  # the row before it, doc_id and text
                for column in (kept, counts, removed):
                    column.append(column[-1])
                continue
            words = text.encode().split()
            counts.append(len(words))
            if piece.copies[k]:
                words = words if len(words) < WINDOW else []
            elif gone[k] is not None:
                flags = gone[k].tolist()
                words = [w for w, out in zip(words, flags) if not out] + words[len(flags) :]
            removed.append(counts[-1] - len(words))
            kept.append(text if as_is and not removed[-1] else b" ".join(words).decode())
        back = np.argsort(piece.order, kind="stable")
        out = pa.table({"kept": pa.array(kept, pa.string()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}).take(pa.array(back))
        return pa.table([left.column("row"), *out.columns], names=["row", *out.column_names])

    done = held.groupBy("piece").cogroup(messages.groupBy("piece")).applyInArrow(drop, schema)
    return done.unionByName(short)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def dedup(docs: DataFrame) -> DataFrame:
    """All columns, with text reduced to the kept words joined by single spaces, and n_words and n_removed."""
    columns = [F.col("kept").alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_words", "n_removed")]
    return reduced(docs).select(*columns, "n_words", "n_removed")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
