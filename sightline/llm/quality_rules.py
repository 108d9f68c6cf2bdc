"""Quality rules: base counts, then the divergence of a text's histograms from its language's references.

Two histograms of each document are compared with the pooled histograms of its language (all documents of that `lang`
that pass the base rules and reach the minimum length): classes of characters, and common
words (see `COMMON_WORDS`; all other words share one bin). The distance is Jensen-Shannon's with base-2 logarithms, 0 to 1. A
document is rejected if a distance exceeds its threshold; one shorter than the guard is not
judged by that histogram, nor is any document of a language without reference.

Only DataFrame functions are used. A first pass over the texts writes counts (a few numbers a
document) to scratch; the references are sums over those.

Defined cases: a null text has no words and fails the base rules, as does an empty one; a null or unknown
`lang` is a language of its own, with the common words of all four lists; repeated rows are judged each alike; an
empty table gives no rows; other columns are left out of `judge` and kept by `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, table

NAME = "op3_quality_rules"
#: Common words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"],
}
SYMBOLS = "#*$%&|<>"
#: Classes of characters, in the order they are taken out of a text; what is left is the last class (other characters).
CLASSES = {"lower": "[a-z]", "upper": "[A-Z]", "space": "[\\x09-\\x0D ]", "digit": "[0-9]", "stop": "[.,;:'\"()-]", "symbol": "[\\x00-\\x7F]"}
#: Guards: code points for the classes, words for the common words.
MIN_CHARS, MIN_WORDS = 200, 60
#: Largest distances that are kept.
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.315, 0.318
#: Base rules.
BASE_MIN_WORDS, BASE_MAX_REPEATED = 10, 20
WINDOW = 5
_SPACES = " \t\n\x0b\x0c\r"


def _count(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, characters, ""))


def counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key, lang, the base counts and both histograms; one pass, no shuffle."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(key, "lang", text.alias("text"))
    bare = F.translate("text", _SPACES, "")
    out = out.select(
        "*",
        F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.char_length(F.translate(x, _SPACES, "")) > 0).alias("lines"),
        F.char_length(bare).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _classes(F.col("text")).alias("classes"),
    )
    n = F.size("words")
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    tidy = F.transform("words", lambda x: F.lower(F.regexp_replace(x, "[.,]+$", "")))
    out = out.select(
        key,
        "lang",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "classes",
        grams.alias("grams"),
        _common_of_language().alias("list"),
        tidy.alias("tidy"),
    )
    # sorted (hash, place) pairs only where some window repeats
    pairs = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    out = out.withColumns({"pairs": pairs, "held": F.filter("tidy", lambda x: F.array_contains("list", x))})
    near = F.zip_with(F.slice("pairs", F.lit(1), F.size("pairs") - 1), F.slice("pairs", F.lit(2), F.size("pairs") - 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("at", F.sort_array(F.array_distinct(F.flatten(near))))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(WINDOW), i - s["last"])).cast("long").alias("n"), i.alias("last")),
    )["n"]
    words = F.transform("list", lambda w: F.size(F.filter("held", lambda x: x == w)).cast("long"))
    return out.select(
        key, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "classes", F.concat(words, F.array(F.col("n_words") - F.size("held"))).alias("commons"),
    )


def _common_of_language() -> Column:
    every = sorted({w for words in COMMON_WORDS.values() for w in words})
    column = F.array(*map(F.lit, every))
    for lang, words in COMMON_WORDS.items():
        column = F.when(F.col("lang") == lang, F.array(*map(F.lit, words))).otherwise(column)
    return column


def _classes(text: Column) -> Column:
    """Code points in each class, by what is left when the classes are taken out one after another."""
    left, sizes = text, [F.char_length(text)]
    for pattern in CLASSES.values():
        left = F.regexp_replace(left, f"{pattern}+", "")
        sizes.append(F.char_length(left))
    return F.array(*[(a - b).cast("long") for a, b in zip(sizes, sizes[1:], strict=False)], sizes[-1].cast("long"))


def base_failed() -> Column:
    return (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_MAX_REPEATED * F.col("n_words"))


def _distance(own: str, reference: str) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null if either is empty or missing."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    shares = F.zip_with(own, reference, lambda a, b: F.struct((a / total(own)).alias("p"), (b / total(reference)).alias("q")))
    terms = F.transform(shares, lambda s: part(s["p"], (s["p"] + s["q"]) / 2) + part(s["q"], (s["p"] + s["q"]) / 2))
    found = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))
    return F.when((total(own) > 0) & (total(reference) > 0), found)


def references(counted: DataFrame) -> DataFrame:
    """Pooled histograms of each language: a row a language."""
    fit = counted.filter(~base_failed() & (F.col("n_words") >= MIN_WORDS))
    every = len({w for words in COMMON_WORDS.values() for w in words})
    sums = lambda c, n: F.array(*[F.coalesce(F.sum(F.get(F.col(c), F.lit(k))), F.lit(0)) for k in range(n)])
    found = fit.groupBy("lang").agg(sums("classes", len(CLASSES) + 1).alias("ref_classes"), sums("commons", every + 1).alias("ref_commons"), F.max(F.size("commons")).alias("n"))
    return found.select("lang", "ref_classes", F.slice("ref_commons", F.lit(1), F.col("n")).alias("ref_commons"))


def judge(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key and base counts of every document, both distances, base_failed and kept."""
    scratch = Scratch(docs.sparkSession, "rules")
    counted = scratch.save(counts(docs, key), "counts")
    known = references(counted).withColumnRenamed("lang", "ref_lang")
    joined = counted.join(known, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda s, x: s + x)
    judged = joined.withColumns(
        {
            "base_failed": base_failed(),
            "class_distance": F.when(chars >= MIN_CHARS, _distance("classes", "ref_classes")),
            "word_distance": F.when(F.col("n_words") >= MIN_WORDS, _distance("commons", "ref_commons")),
        }
    )
    near = (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= MAX_WORD_DISTANCE)
    return judged.select(key, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & near).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns. Rows are told apart by 128 bits of hashes of what the rules read."""
    key = "_key"
    while key in docs.columns:
        key += "_"
    hashes = F.struct(F.xxhash64("doc_id", "text", "lang").alias("a"), F.xxhash64(F.lit(1), "doc_id", "text", "lang").alias("b"))
    keyed = docs.withColumn(key, hashes)
    rejected = judge(keyed, key).filter(~F.col("kept")).select(key).distinct()
    return keyed.join(rejected, key, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _sql_classes() -> str:
    left, sizes = "text", ["length(text)"]
    for pattern in CLASSES.values():
        quoted = pattern.replace("'", "''")
        left = f"regexp_replace({left}, '{quoted}+', '', 'g')"
        sizes.append(f"length({left})")
    return "[" + ", ".join([f"{a} - {b}" for a, b in zip(sizes, sizes[1:], strict=False)] + [sizes[-1]]) + "]"


def _sql_distance(own: str, reference: str) -> str:
    p, q = f"({own}[i] / list_sum({own}))", f"({reference}[i] / list_sum({reference}))"
    part = lambda x: f"(CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0.0e0 END)"
    return f"CASE WHEN list_sum({own}) > 0 AND list_sum({reference}) > 0 THEN sqrt(greatest(0.0e0, list_sum(list_transform(range(1, len({own}) + 1), lambda i: {part(p)} + {part(q)})) / 2)) END"


_EVERY = sorted({w for words in COMMON_WORDS.values() for w in words})
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce("text", '') AS text FROM documents),
w AS (
    SELECT r, doc_id, lang, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        CASE lang {" ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in COMMON_WORDS.items())} ELSE {_sql_list(_EVERY)} END AS list
    FROM d),
g AS (
    SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS times
    FROM (SELECT r, unnest(range(1, len(words) - {WINDOW - 2})) AS i, unnest(list_transform(range(1, len(words) - {WINDOW - 2}), lambda k: words[k:k + {WINDOW - 1}])) AS gram FROM w WHERE len(words) >= {WINDOW})),
c AS (
    SELECT r, sum(n) AS n_repeat FROM (SELECT r, least({WINDOW}, i - lag(i, 1, i - {WINDOW}) OVER (PARTITION BY r ORDER BY i)) AS n FROM g WHERE times > 1) GROUP BY r),
h AS (
    SELECT w.r, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, {_sql_classes()} AS classes, list,
        list_transform(words, lambda x: lower(regexp_replace(x, '[.,]+$', ''))) AS tidy
    FROM w LEFT JOIN c ON w.r = c.r),
k AS (
    SELECT *, coalesce(n_words < {BASE_MIN_WORDS} OR 100 * n_repeat_words > {BASE_MAX_REPEATED} * n_words, true) AS base_failed,
        list_concat(list_transform(list, lambda x: len(list_filter(tidy, lambda y: y = x))), [n_words - len(list_filter(tidy, lambda y: list_contains(list, y)))]) AS commons
    FROM h),
f AS (SELECT * FROM k WHERE NOT base_failed AND n_words >= {MIN_WORDS}),
rc AS (SELECT lang, list(v ORDER BY i) AS ref_classes FROM (SELECT lang, i, sum(classes[i]) AS v FROM f, range(1, {len(CLASSES) + 2}) t(i) GROUP BY lang, i) GROUP BY lang),
rw AS (SELECT lang, list(v ORDER BY i) AS ref_commons FROM (SELECT lang, i, sum(commons[i]) AS v FROM f, range(1, {len(_EVERY) + 2}) t(i) WHERE i <= len(commons) GROUP BY lang, i) GROUP BY lang),
j AS (
    SELECT k.*, CASE WHEN list_sum(classes) >= {MIN_CHARS} THEN {_sql_distance("classes", "ref_classes")} END AS class_distance,
        CASE WHEN n_words >= {MIN_WORDS} THEN {_sql_distance("commons", "ref_commons")} END AS word_distance
    FROM k LEFT JOIN rc ON k.lang IS NOT DISTINCT FROM rc.lang LEFT JOIN rw ON k.lang IS NOT DISTINCT FROM rw.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AS kept
FROM j
"""
