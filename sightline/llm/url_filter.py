"""URL filter: allow and block rules by host and path, and gradient-boosted trees for the rest.

A rule names a host and the start of a path; it fits that host and all its subdomains, and the longest
fitting rule decides. Other URLs are judged by boosted trees (Spark ML) over lexical features: lengths, depth, digit
and hyphen shares, character entropy, parameter counts, and the smoothed share of blocked training URLs by the
host's last label. The trees are trained from labelled URLs; `labelled_urls` makes the default ones from small lists of names,
suffixes and path forms, in which both kinds have hyphens, digits and parameters.

Only DataFrame functions and Spark ML are used. Rules join by host suffix: a host is exploded to its suffixes (a
handful), so a long rule list costs an equi-join, not a scan of the rules for each URL.

Defined cases: a URL that is null or has no `://` has empty host and path, fits no rule, and is judged by its
features like others (a null URL as an empty one); ties between rules of one length cannot occur, as one text is one rule (of
repeated ones, block wins); repeated rows are judged each alike; empty tables give no rows; other columns are kept by
`judge` unless a column it adds has their name (host, path, rule, verdict), and names beginning with `_lex_` are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import table

NAME = "op5_url_filter"
#: (host and path start, verdict).
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Names, suffixes and path forms of the default training URLs. Honest and dishonest names overlap in hyphens, digits and suffixes.
GOOD_NAMES = ["library", "weather", "garden", "history", "museum", "science", "news", "travel", "recipes", "school", "music", "letters", "city", "health", "books", "sports"]
GOOD_NAMES += ["pre-raphaelite-museum", "university-library-archive", "early-music-society", "natural-history-notes", "route66", "channel4"]
BAD_NAMES = ["cheap-watches", "win-big", "hot-singles", "free-coins", "best-loans", "click-here", "slots-bonus", "pills-online", "fast-cash", "adult-cams", "get-rich", "track-ads", "seo-links", "bet-now", "spam-list", "x-videos"]
BAD_NAMES += ["casino777", "xk4q9z2v7t", "win2day88", "pills4u24", "q7z3x1k9v", "bet365slots99", "viagra", "freecoins"]
SUFFIXES_GOOD = ["example.com", "example.net", "example.org", "com", "net", "org", "edu"]
SUFFIXES_BAD = ["example.com", "example.net", "example.org", "com", "net", "info", "top"]
PATHS_GOOD = ["/en/{n}", "/de/{n}.html", "/fr/{n}/", "/es/{n}?page=2", "/{n}/about", "/", "/en/{n}?page=2&ref=x", "/de/{n}#top", "/en/{n}?utm_source=feed"]
PATHS_BAD = ["/en/{n}?ref=x&id={n}{n}", "/de/{n}.html", "/go.php?aff={n}&utm_source=feed&sub=9{n}", "/es/{n}", "/", "/en/{n}?a={n}&b={n}&c={n}&d=1", "/p/{n}/{n}/{n}/win{n}", "/fr/{n}#top", "/c?k={n}{n}{n}&uid={n}{n}&z=1"]
#: Columns that the trees read. The name is `_lex_` and what they count.
FEATURES = [f"_lex_{f}" for f in ("url_length", "host_length", "depth", "digit_ratio", "host_digit_ratio", "hyphen_ratio", "entropy", "n_parameters", "n_labels", "suffix_share")]
#: Labelled URLs that the trees are fitted on at most (the first by a hash); suffix shares are over all labelled URLs.
MAX_TRAINING = 100_000
TREES, DEPTH = 12, 3
#: Weight of the overall share in a suffix's share.
PRIOR = 4


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; A-Z lower-cased."""
    found = F.regexp_extract(url, "^(?s)(?:(?!://).)*://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "^(?s)(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, label (1: block) and name, a row for each name, suffix and path form."""
    def of(names, suffixes, paths, label):
        listed = lambda values: F.explode(F.array(*map(F.lit, values)))
        rows = spark.range(1).select(listed(names).alias("name")).select("name", listed(suffixes).alias("suffix"))
        rows = rows.select("*", F.posexplode(F.array(*map(F.lit, paths))).alias("k", "form"))
        drawn = lambda salt, n: F.pmod(F.xxhash64("name", "suffix", "k", F.lit(salt)), F.lit(n))
        lead = F.element_at(F.array(*map(F.lit, ("", "www.", "blog.", "m."))), (drawn(1, 4) + 1).cast("int"))
        link = F.concat(F.lit("https://"), lead, "name", F.lit("."), "suffix", F.replace("form", F.lit("{n}"), drawn(0, 1000).cast("string")))
        return rows.select(link.alias("url"), F.lit(label).cast("double").alias("label"), "name")

    return of(GOOD_NAMES, SUFFIXES_GOOD, PATHS_GOOD, 0).unionByName(of(BAD_NAMES, SUFFIXES_BAD, PATHS_BAD, 1))


def _suffix(host_: Column) -> Column:
    """The last label of a host."""
    return F.substring_index(host_, ".", -1)


def _entropy(text: Column) -> Column:
    """Bits a character of a text's own characters, rounded to 9 places."""
    letters = F.filter(F.split(text, ""), lambda x: x != "")
    n = F.size(letters)
    shares = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return F.round(F.aggregate(shares, F.lit(0.0), lambda s, p: s - p * F.log2(p)), 9)


def lexical(urls: DataFrame, shares: DataFrame, overall: float, url: str = "url") -> DataFrame:
    """Adds FEATURES. `shares` has suffix and suffix_share; unseen suffixes take the overall share."""
    if taken := [c for c in urls.columns if c.startswith("_lex_")]:
        raise ValueError(f"names of columns that are in use here: {taken}")
    text = F.coalesce(F.col(url), F.lit(""))
    h = host(text)
    share = lambda t, pattern: (F.char_length(t) - F.char_length(F.regexp_replace(t, pattern, ""))) / F.greatest(F.char_length(t), F.lit(1))
    out = urls.withColumns(
        {
            "_lex_url_length": F.char_length(text).cast("double"),
            "_lex_host_length": F.char_length(h).cast("double"),
            "_lex_depth": F.size(F.filter(F.split(path(text), "/"), lambda x: x != "")).cast("double"),
            "_lex_digit_ratio": share(text, "[0-9]"),
            "_lex_host_digit_ratio": share(h, "[0-9]"),
            "_lex_hyphen_ratio": share(h, "-"),
            "_lex_entropy": _entropy(h),
            "_lex_n_parameters": F.size(F.filter(F.split(F.regexp_extract(text, "\\?([^#]*)", 1), "&"), lambda x: x != "")).cast("double"),
            "_lex_n_labels": F.size(F.filter(F.split(h, "\\."), lambda x: x != "")).cast("double"),
            "_lex_suffix": _suffix(h),
        }
    )
    out = out.join(shares.select(F.col("suffix").alias("_lex_suffix"), F.col("suffix_share").alias("_lex_suffix_share")), "_lex_suffix", "left").drop("_lex_suffix")
    return out.withColumn("_lex_suffix_share", F.coalesce("_lex_suffix_share", F.lit(overall)))


class UrlModel:
    """Boosted trees and the suffix statistics they were trained with."""

    def __init__(self, labelled: DataFrame, trees: int = TREES, depth: int = DEPTH):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        labelled = labelled.filter("url is not null and label in (0, 1)")
        self.overall = labelled.agg(F.avg("label")).first()[0]
        if self.overall is None:
            raise ValueError("no labelled URL")
        known = labelled.groupBy(_suffix(host(F.col("url"))).alias("suffix"))
        self.shares = known.agg(((F.sum("label") + PRIOR * F.lit(self.overall)) / (F.count("label") + PRIOR)).alias("suffix_share"))
        sample = labelled.select("url", "label").orderBy(F.xxhash64("url"), "url", "label").limit(MAX_TRAINING)
        self.assembler = VectorAssembler(inputCols=FEATURES, outputCol="_lex_features")
        train = self.assembler.transform(lexical(sample, self.shares, self.overall)).select("label", "_lex_features").coalesce(1)
        learner = GBTClassifier(featuresCol="_lex_features", labelCol="label", maxIter=trees, maxDepth=depth, seed=7, predictionCol="_lex_blocked")
        self.trees = learner.setRawPredictionCol("_lex_raw").setProbabilityCol("_lex_probability").fit(train)

    def blocked(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """Adds `blocked`."""
        rows = self.assembler.transform(lexical(urls, self.shares, self.overall, url))
        rows = self.trees.transform(rows).withColumn("blocked", F.col("_lex_blocked") > 0.5)
        return rows.drop("_lex_features", "_lex_raw", "_lex_probability", "_lex_blocked", *FEATURES)


def rules_table(spark: SparkSession, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """rule, verdict, and the rule's host and path."""
    listed = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("rule_verdict")) for r, v in rules])
    rows = spark.range(1).select(F.inline(listed))
    cut = F.instr("rule", "/")
    rows = rows.withColumns({"rule_host": F.when(cut > 0, F.expr("substring(rule, 1, instr(rule, '/') - 1)")).otherwise(F.col("rule")), "rule_path": F.when(cut > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit(""))})
    return rows.groupBy("rule", "rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))


def judge(pages: DataFrame, rules: DataFrame, model: UrlModel, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict (allow or block)."""
    pages = pages.drop("host", "path", "rule", "verdict")
    rows = model.blocked(pages, url).withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    labels = F.split("host", "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = rows.select("host", F.col("path")).distinct()
    tried = keyed.withColumn("rule_host", F.explode(tails)).join(rules, "rule_host").filter(F.startswith("path", "rule_path"))
    best = tried.groupBy("host", "path").agg(F.max_by(F.struct("rule", "rule_verdict"), F.struct(F.char_length("rule"), "rule")).alias("best"))
    out = rows.join(best, ["host", "path"], "left")
    return out.select(*pages.columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rules_table(spark), UrlModel(labelled_urls(spark))).select("page_id", "host", "path", "rule", "verdict")
