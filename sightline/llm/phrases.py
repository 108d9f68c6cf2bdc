"""Collocations by contiguous pattern growth over projected occurrence pointers.

A phrase is a run of up to `LONGEST` words inside a piece of text between `[.,;:!?\\x0A-\\x0D]`; everything is counted by language.

1. Frequent words. Texts lie in a table of pieces (some MB each). Each sends its distinct words with their counts to buckets of word hashes, which answer which words
   are frequent, and whose spelling is to be kept (see exchange.py). A hot word is one entry a piece.
2. Projection. Pairs of neighbouring frequent words are asked for as well, by 24 bits within their bucket: chance hits keep a pair that could have gone, and drop none.
   The pointer of each frequent word's occurrence is its window: the word and up to four more, up to the first infrequent word or pair or the end. Equal
   windows of a piece are counted there. Windows go to tasks by ranges of their order, so a task holds the projected occurrences of whole prefixes, and a
   prefix with very many is dealt to several tasks. The ranges come from the windows of a bounded sample of pieces and change no result.
3. Growth. A task sorts its windows and extends prefixes to the right depth first, a run of rows at a time, as long as they are frequent. Only the prefixes of its
   first and last window can have occurrences elsewhere; their partial counts are given out whatever they are, and added up.
4. Scores. A candidate's parts are frequent phrases themselves, so joins with the phrases give each cut's l and r. All arithmetic is in whole numbers
   (decimals of 38 digits, so 1000 * a * n and l * r hold up to 10^15 words).

Words are told apart by 64-bit hashes of language and spelling.

Defined cases: null texts are empty; a null language is `und`; phrases of equal score and a are ordered by their UTF-8 bytes; repeated rows all count; an
empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm import exchange
from sightline.llm.common import Scratch, Words, mix, pieces, table, text_buffers, text_bytes

NAME = "op13_phrase_mining"
LONGEST, MIN_COUNT, TOP = 5, 100, 2000
#: A candidate goes if a longer one that holds it has at least so many hundredths of its count.
CONTAINED = 100
#: Bytes of text whose windows make up a range, about; ranges at most (the driver holds `SAMPLE` windows of 40 bytes for each); pieces that are sampled.
RANGE_BYTES, MAX_RANGES, SAMPLE, SAMPLED_PIECES = 8 << 20, 1 << 16, 16, 8
#: Languages that are sent to every task; more are joined by shuffling.
FEW = 10_000
#: Groups that a language is dealt to before its best candidates meet.
SALTS = 64
UNDEFINED = "und"
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_GAP = _BREAK.copy()
_GAP[[9, 32]] = True

_PAIR = np.uint64(0x9FB21C651E98DF25)

_SENT = pa.schema([("bucket", pa.int32()), ("piece", pa.int64()), ("hash", pa.binary()), ("n", pa.binary()), ("lang", pa.string())])
_SENT_PAIRS = pa.schema([("bucket", pa.int32()), ("piece", pa.int64()), ("low", pa.binary()), ("n", pa.binary())])
_CUT = pa.schema([("range", pa.int32()), ("windows", pa.binary()), ("h", pa.list_(pa.int64())), ("lang", pa.list_(pa.string())), ("word", pa.list_(pa.string()))])
_GROWN = pa.schema([("words", pa.list_(pa.int64())), ("a", pa.int64()), ("lang", pa.string()), ("word", pa.string())])
_CUT_DDL = "range int, windows binary, h array<long>, lang array<string>, word array<string>"
_GROWN_DDL = "words array<long>, a long, lang string, word string"


def either(f, schema: pa.Schema):
    """A function of both sides of a cogroup, of which an empty one gives no rows."""
    return lambda left, right: f(left, right) if left.num_rows and right.num_rows else schema.empty_table()


def _held(docs: DataFrame, scratch: Scratch, total: int) -> DataFrame:
    """The table of pieces: piece, lang, text."""
    shaped = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNDEFINED)).alias("lang"), "text").filter("text is not null")

    def run(batches):
        piece, size = TaskContext.get().partitionId() << 20, 0
        for batch in batches:
            _, offsets = text_buffers(batch.column(1))
            for a, b in pieces(offsets):
                if size >= exchange.PIECE_BYTES:
                    piece, size = piece + 1, 0
                size += int(offsets[b] - offsets[a]) + 16 * (b - a)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, piece)), part.column(0), part.column(1)], names=["piece", "lang", "text"])

    return scratch.bucketed(shaped.mapInArrow(run, "piece long, lang string, text string"), "pieces", "piece", max(1, total // exchange.PIECE_BYTES))


class _Piece:
    """The words of a piece: hashes of language and spelling, in order, and where texts break."""

    def __init__(self, got: pa.Table):
        self.number = got.column("piece")[0].as_py()
        self.langs = got.column("lang").to_pylist()
        data, offsets = text_buffers(got.column("text"))
        self.words = Words(data, offsets, _GAP)
        count = self.words.count()
        self.doc = np.repeat(np.arange(len(count)), count)
        salt = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(self.langs)}
        self.salts = np.array([salt[x] for x in self.langs], np.uint64)
        self.h = np.maximum(mix(self.words.hashes(lower=True) ^ self.salts[self.doc]), np.uint64(1))  # zero means no word
        self.segment = np.cumsum(_BREAK[data])[self.words.start] + self.doc if len(self.h) else np.zeros(0, np.int64)
        self.known, self.first, self.at, self.times = np.unique(self.h, return_index=True, return_inverse=True, return_counts=True)

    def spelling(self, which: np.ndarray) -> tuple[list[str], list[str]]:
        """Language and word of known words."""
        at = self.first[which]
        raw = self.words.data
        return [self.langs[d] for d in self.doc[at].tolist()], [raw[i:j].tobytes().lower().decode("utf-8", "replace") for i, j in zip(self.words.start[at].tolist(), self.words.end[at].tolist(), strict=True)]

    def pairs(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs of frequent words begin that no break parts, and their hashes."""
        often = frequent[self.at]
        at = np.flatnonzero(often[:-1] & often[1:] & (self.segment[1:] == self.segment[:-1]))
        return at, mix(self.h[at] * _PAIR + self.h[at + 1])

    def windows(self, frequent: np.ndarray, goes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Different windows, sorted: rows of hashes with zeros after the end, and how often each occurs; `goes` tells for each word whether a window goes on after it."""
        local = np.where(frequent, np.cumsum(frequent), 0)  # numbers of frequent words, in order of their hashes
        word = local[self.at]
        bits = int(local.max(initial=0)).bit_length() or 1
        start = np.flatnonzero(word)
        inside, columns, keys = np.ones(len(start), bool), [], []
        for k in range(longest):
            at = np.minimum(start + k, len(word) - 1)
            if k:
                inside &= goes[at - 1] & (start + k < len(word))
            columns.append(np.where(inside, word[at], 0))
        # several numbers make up one key
        for at in range(0, longest, 63 // bits):
            key = np.zeros(len(start), np.int64)
            for c in columns[at : at + 63 // bits]:
                key = (key << bits) | c
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        at = np.flatnonzero(new)
        hashes = np.concatenate([np.zeros(1, np.uint64), self.known[frequent]])
        rows = order[at]
        return np.stack([hashes[c[rows]] for c in columns], axis=1), np.diff(np.append(at, len(order)))


def _place(windows: np.ndarray, split: np.ndarray) -> int:
    """Where a window belongs among sorted ones."""
    lo, hi = 0, len(windows)
    for k in range(windows.shape[1]):
        column = windows[lo:hi, k]
        lo, hi = lo + int(np.searchsorted(column, split[k], "left")), lo + int(np.searchsorted(column, split[k], "right"))
        if lo == hi:
            break
    return lo


def _pack(windows: np.ndarray, times: np.ndarray) -> bytes:
    known, at = np.unique(windows, return_inverse=True)
    at = at.reshape(windows.shape).T.astype("<u2" if len(known) < 1 << 16 else "<u4")
    head = np.array([*windows.shape, len(known)], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in (head, known.astype("<u8"), times.astype("<i8"), np.ascontiguousarray(at))))


def _unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    rows, width, known = np.frombuffer(raw, "<i8", 3).tolist()
    words, times = np.frombuffer(raw, "<u8", known, 24), np.frombuffer(raw, "<i8", rows, 24 + 8 * known)
    at = np.frombuffer(raw, "<u2" if known < 1 << 16 else "<u4", rows * width, 24 + 8 * (known + rows)).reshape(width, rows)
    return words[at].T, times


def grow(windows: np.ndarray, times: np.ndarray, least: int) -> list[tuple[np.ndarray, int]]:
    """Frequent prefixes of sorted windows and their counts, depth first; those of the first and the last window whatever their counts are."""
    out, last = [], len(windows)
    total = np.concatenate([[0], np.cumsum(times)])
    todo = [(0, last, 0)] if last else []
    while todo:
        lo, hi, k = todo.pop()
        column = windows[lo:hi, k]
        ends = np.append(np.flatnonzero(column[1:] != column[:-1]) + 1, hi - lo) + lo
        starts = np.append(lo, ends[:-1])
        count = total[ends] - total[starts]
        # zeros come first: windows that end here
        go = np.flatnonzero((windows[starts, k] > 0) & ((count >= least) | (starts == 0) | (ends == last)))
        for i, j, n in zip(starts[go].tolist(), ends[go].tolist(), count[go].tolist(), strict=True):
            out.append((windows[i, : k + 1], n))
            if k + 1 < windows.shape[1]:
                todo.append((i, j, k + 1))
    return out


def phrases(docs: DataFrame, scratch: Scratch, least: int = MIN_COUNT, longest: int = LONGEST, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Frequent phrases (words: hashes, a; lang and word for single words), and n by language."""
    total = text_bytes(docs)
    held = _held(docs, scratch, total)
    buckets = exchange.buckets_for(total)

    def ask(got):
        found = _Piece(got)
        sent = exchange.cut(found.number, found.known, buckets, hash=found.known, n=found.times.astype("<u4"))
        sent = sent.append_column("lang", pa.nulls(sent.num_rows, pa.string()))
        count, counts = found.words.count(), {}
        for lang, n in zip(found.langs, count.tolist(), strict=True):
            counts[lang] = counts.get(lang, 0) + n
        own = pa.table([[-1] * len(counts), [found.number] * len(counts), [b""] * len(counts), [n.to_bytes(8, "big") for n in counts.values()], list(counts)], schema=_SENT)
        return pa.concat_tables([sent.cast(_SENT), own])

    def answer(got):
        hashes, raw = got.column("hash").to_pylist(), got.column("n").to_pylist()
        sizes = np.array([len(x) for x in hashes], np.int64) // 8
        h, n = np.frombuffer(b"".join(hashes), "<u8"), np.frombuffer(b"".join(raw), "<u4")
        known, first, at = np.unique(h, return_index=True, return_inverse=True)
        often = np.bincount(at, weights=n, minlength=len(known)) >= least  # whole numbers far below 2^53
        speaks = np.zeros(len(h), bool)
        speaks[first] = True
        return exchange.replies(got, sizes, often[at], speaks)

    rows = held.groupBy("piece")
    sent = scratch.save(rows.applyInArrow(ask, "bucket int, piece long, hash binary, n binary, lang string"), "words")
    told = scratch.save(sent.filter("bucket >= 0").groupBy("bucket").applyInArrow(answer, exchange.REPLY), "answers")
    number = F.conv(F.hex("n"), 16, 10).cast("long")
    totals = scratch.save(sent.filter("bucket < 0").groupBy("lang").agg(F.sum(number).alias("n")).filter("n > 0"), "totals")
    scratch.drop("words")

    def heard(right, known, pairs, planes):
        """The answers about words, or about pairs, whose buckets have negative numbers."""
        said = [(-1 - b if pairs else b, x) for b, x in zip(right.column("bucket").to_pylist(), right.column("bits").to_pylist(), strict=True) if (b < 0) == pairs]
        return exchange.read(known, buckets, [b for b, _ in said], [x for _, x in said], planes)

    held_count = np.dtype("u1" if least < 256 else "<u4")

    def ask_pairs(left, right):
        found = _Piece(left)
        _, h = found.pairs((heard(right, found.known, False, 2) & 1).astype(bool))
        known, times = np.unique(h, return_counts=True)
        return exchange.cut(found.number, known, buckets, low=exchange.low_bytes(known, 3), n=np.minimum(times, least).astype(held_count))

    def answer_pairs(got):
        raw, n = got.column("low").to_pylist(), np.frombuffer(b"".join(got.column("n").to_pylist()), held_count)
        wide = np.zeros((len(n), 4), np.uint8)
        wide[:, :3] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 3)
        _, at = np.unique(wide.view("<u4").reshape(-1), return_inverse=True)
        return exchange.replies(got, np.array([len(x) for x in raw], np.int64) // 3, (np.bincount(at, weights=n) >= least)[at])

    asked = rows.cogroup(told.groupBy("piece")).applyInArrow(either(ask_pairs, _SENT_PAIRS), exchange.sent_schema("low", "n"))
    pairs = asked.groupBy("bucket").applyInArrow(answer_pairs, exchange.REPLY).withColumn("bucket", -1 - F.col("bucket"))
    told = told.unionByName(scratch.save(pairs, "pairs"))

    def kinds(left, right):
        """A piece, what is known of its words (1: frequent, 2: spelt here), its windows."""
        found = _Piece(left)
        kind = heard(right, found.known, False, 2)
        at, h = found.pairs((kind & 1).astype(bool))
        known, where = np.unique(h, return_inverse=True)
        goes = np.zeros(len(found.h), bool)
        goes[at] = heard(right, known, True, 1)[where]
        return found, kind, *found.windows((kind & 1).astype(bool), goes, longest)

    ranges = int(min(MAX_RANGES, max(exchange.BUCKETS, total // range_bytes)))
    some = told.select("piece").distinct().orderBy(F.xxhash64("piece")).limit(SAMPLED_PIECES)
    each = -(-SAMPLE * ranges // SAMPLED_PIECES)

    def sample(left, right):
        *_, windows, _ = kinds(left, right)
        at = np.unique(np.linspace(0, len(windows) - 1, each).astype(np.int64)) if len(windows) else []
        return pa.table({"window": pa.array([windows[x].astype("<u8").tobytes() for x in at], pa.binary())})

    few = held.join(F.broadcast(some), "piece", "left_semi").groupBy("piece").cogroup(told.join(F.broadcast(some), "piece", "left_semi").groupBy("piece"))
    seen = [np.frombuffer(r.window, "<u8") for r in few.applyInArrow(either(sample, pa.schema([("window", pa.binary())])), "window binary").collect()]
    seen = np.array(sorted(map(tuple, seen)), np.uint64).reshape(-1, longest)
    splits = seen[np.unique(np.arange(1, ranges) * len(seen) // ranges)] if len(seen) else seen

    def project(left, right):
        found, kind, windows, times = kinds(left, right)
        ends = [*(_place(windows, s) for s in splits), len(windows)]
        told = np.flatnonzero(kind == 3)
        langs, words = found.spelling(told)
        # a word is told where its first window goes
        where = np.searchsorted(ends, np.searchsorted(windows[:, 0], found.known[told]), "right") if len(told) else told
        out, at = [], 0
        for number, end in enumerate(ends):
            mine = np.flatnonzero(where == number)
            if at < end:
                out.append((number, _pack(windows[at:end], times[at:end]), found.known[told[mine]].view(np.int64), [langs[x] for x in mine], [words[x] for x in mine]))
            at = end
        return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * 5, _CUT, strict=True)], schema=_CUT)

    def extend(got):
        parts = [_unpack(x.as_py()) for x in got.column("windows")]
        windows, times = np.concatenate([w for w, _ in parts]), np.concatenate([t for _, t in parts])
        order = np.lexsort(windows.T[::-1])
        names = {h: (lang, word) for r in got.select(["h", "lang", "word"]).to_pylist() for h, lang, word in zip(r["h"], r["lang"], r["word"], strict=True)}
        found = [(w.view(np.int64).tolist(), n) for w, n in grow(windows[order], times[order], least)]
        spelt = [names.pop(w[0], (None, None)) if len(w) == 1 else (None, None) for w, _ in found]
        return pa.table([[w for w, _ in found], [n for _, n in found], [x for x, _ in spelt], [x for _, x in spelt]], schema=_GROWN)

    cut = rows.cogroup(told.groupBy("piece")).applyInArrow(either(project, _CUT), _CUT_DDL)
    grown = scratch.save(cut.groupBy("range").applyInArrow(extend, _GROWN_DDL), "grown")
    whole = grown.groupBy("words").agg(F.sum("a").alias("a"), F.max("lang").alias("lang"), F.max("word").alias("word")).filter(F.col("a") >= least)
    return scratch.save(whole, "phrases"), totals


def _part(start: Column, size: Column) -> Column:
    return F.slice("words", start, size)


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT, longest: int = LONGEST, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The first `top` phrases of two words or more of each language: lang, rank, phrase, a, l, r, n, score."""
    scratch = Scratch(docs.sparkSession, "phrases")
    found, totals = phrases(docs.select("lang", "text"), scratch, least, longest, range_bytes)
    size = F.size("words")
    single = found.filter(size == 1).select(F.col("words")[0].alias("h"), "lang", "word")
    candidates = found.filter(size > 1).select("words", "a")
    # those inside longer ones of the same count
    spans = [(i, k) for k in range(2, longest) for i in range(1, longest - k + 2)]
    inside = F.array(*[F.when((size >= i + k - 1) & (size > k), _part(F.lit(i), F.lit(k))) for i, k in spans])
    longer = candidates.filter(size > 2).select("a", F.explode(F.array_compact(inside)).alias("words")).groupBy("words").agg(F.max("a").alias("longer"))
    left = candidates.join(longer, "words", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < CONTAINED * F.col("a"))).select("words", "a")
    # language and n, then all cuts
    langs = single.select("h", "lang").join(F.broadcast(totals) if totals.count() <= FEW else totals, "lang")
    named = left.withColumn("h", F.col("words")[0]).join(langs, "h").drop("h")
    cuts = named.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).withColumns({"x": _part(F.lit(1), F.col("k")), "y": _part(F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(found.select(F.col("words").alias("x"), F.col("a").alias("l")), "x").join(found.select(F.col("words").alias("y"), F.col("a").alias("r")), "y")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"above": F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n"), "below": whole("l") * whole("r")})
    best = F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("best")
    scored = cuts.groupBy("words", "a", "lang", "n").agg(best).select("words", "a", "lang", "n", "best.score", "best.l", "best.r")
    scored = scratch.save(scored, "scored")
    # the best of each language, with all that tie, get their spelling; then ties are ordered by it
    order = [F.desc("score"), F.desc("a")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("words"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    some = some.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "salt")
    some = scratch.save(some, "best")
    spelt = some.select("words", F.posexplode("words").alias("at", "h")).join(single.select("h", "word"), "h")
    spelt = spelt.groupBy("words").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    out = some.join(spelt, "words")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH p AS (
    SELECT coalesce(lang, '{UNDEFINED}') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM s, range(1, {LONGEST + 1}) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {MIN_COUNT}),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inside AS (
    SELECT c.lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(c.a) AS longer
    FROM c, range(2, {LONGEST}) t(m), range(1, {LONGEST}) u(i) WHERE m < c.k AND i + m - 1 <= c.k GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {CONTAINED} * c.a),
cuts AS (
    SELECT kept.lang, kept.phrase, kept.a, j, x.a AS l, y.a AS r, n.n,
        CAST((CAST(1000 AS HUGEINT) * kept.a * n.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
    FROM kept JOIN n ON n.lang = kept.lang, range(1, {LONGEST}) t(j)
        JOIN f x ON true JOIN f y ON true
    WHERE j < kept.k AND x.lang = kept.lang AND y.lang = kept.lang AND x.phrase = array_to_string(kept.w[1:j], ' ') AND y.phrase = array_to_string(kept.w[j + 1:kept.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM best QUALIFY rank <= {TOP}
"""
