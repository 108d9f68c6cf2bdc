"""Collocations against a plain count, and against SQL."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from sightline.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, top, least):
    count, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    out = []
    for lang in n:
        found = {p: a for (x, p), a in count.items() if x == lang and a >= least}
        rank = []
        for p, a in found.items():
            held = any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items())
            if len(p) > 1 and not held:
                score, _, left, right = min((1000 * a * n[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(rank)[:top])]
    return sorted(out)


def texts(seed):
    r = random.Random(seed)
    words = ["The", "of", "é a", "New", "York", "ÄRA", "x-1", "naïve", "日本", "zz"]
    rows = [("en", None), (None, "The of the of"), ("en", ""), ("fr", " .,\t"), ("en", "zz " * 700), ("en", "zz " * 700)]
    for k in range(120):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ".", "\n", "\x0b"]) for _ in range(r.randint(0, 60)))
        if k % 3 == 0:
            text += " New York of the x-1 zz. " * r.randint(1, 3)
        rows.append((r.choice(["en", "en", "en", "fr", None]), text))
    return rows


@pytest.mark.parametrize("seed,top,least,size", [(1, 2000, 5, 8 << 20), (2, 7, 3, 64), (3, 2000, 2, 300)])
def test_phrases_agree_with_a_plain_count(spark, seed, top, least, size, monkeypatch):
    monkeypatch.setattr(phrases.exchange, "PIECE_BYTES", 700)
    rows = texts(seed)
    df = spark.createDataFrame([(*row, 3, 4) for row in rows], "lang string, text string, words int, a long").repartition(3)
    got = phrases.collocations(df, top, least, range_bytes=size)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == plain(rows, top, least)


def test_prefixes_across_ranges_add_up():
    r = np.random.default_rng(5)
    windows = r.integers(0, 3, (400, 4)).astype(np.uint64)
    windows[:, 0] += 1
    windows = np.where(np.cumprod(windows > 0, axis=1) > 0, windows, 0).astype(np.uint64)
    windows = windows[np.lexsort(windows.T[::-1])]
    times = r.integers(1, 4, 400)
    whole = {tuple(w.tolist()): n for w, n in phrases.grow(windows, times, 20) if n >= 20}
    parts, cuts = Counter(), [0, *sorted(r.integers(0, 400, 9).tolist()), 400]
    for i, j in zip(cuts, cuts[1:], strict=False):
        for w, n in phrases.grow(windows[i:j], times[i:j], 20):
            parts[tuple(w.tolist())] += n
    assert {w: n for w, n in parts.items() if n >= 20} == whole and len(whole) > 9


def test_an_empty_table_gives_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []
    assert phrases.collocations(spark.createDataFrame([("en", None), ("en", "a b")], "lang string, text string")).collect() == []


def test_sql_agrees_on_a_small_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_COUNT", 100)
    rows = texts(9) * 8
    df = spark.createDataFrame(rows, "lang string, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    expected = con.sql(f"select {', '.join(COLUMNS)} from ({phrases.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, phrases.collocations(df).collect())) == sorted(expected) and len(expected) > 20
