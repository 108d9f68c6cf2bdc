"""Rules, classifier, near-duplicates, substrings and the pipeline against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import near_duplicates, quality_model, quality_rules, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passage = [word() for _ in range(60)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One TWO"), (5, "x " * 500)]
    while len(rows) < n:
        kind, words = r.random(), [word() for _ in range(r.randint(3, 120))]
        if kind < 0.4 and len(rows) > 8:
            words = WORD.findall(rows[r.randrange(6, len(rows))][1]) or words
            for _ in range(r.randint(0, max(1, len(words) // 12))):
                words[r.randrange(len(words))] = word()
        elif kind < 0.6:
            words[len(words) // 2 : len(words) // 2] = passage[r.randint(0, 20) :]
        rows.append((len(rows) * 3, " ".join(words)))
    return rows + [(9, "copy of a row"), (9, "copy of a row")]


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


@pytest.mark.parametrize("seed", [3])
def test_components_agree_with_all_pairs(spark, docs, seed):
    rows = corpus(seed)
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 4 * len(x & y) >= 3 * len(x | y):
                up[find(a)] = find(b)
    smallest = {}
    for k, (i, _) in enumerate(sets):
        smallest[find(k)] = min(i, smallest.get(find(k), i))
    expected = sorted((i, len(s), smallest[find(k)]) for k, (i, s) in enumerate(sets))
    got = near_duplicates.join(docs(rows))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == expected
    kept = near_duplicates.keep_one(docs(rows))
    assert kept.count() == len({c for _, n, c in expected if n}) + sum(not n for _, n, _ in expected)


def test_one_stays_of_each_component_whatever_the_ids(spark, docs):
    text = lambda name, n=30: " ".join(f"{name}{k}" for k in range(n))
    rows = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (None, text("e")), (8, text("e")), (7, text("f")), (7, text("f")), (9, text("c")), (None, text("g", 40)), (None, text("g", 39))]
    got = [(r.doc_id, r.text) for r in near_duplicates.keep_one(docs(rows)).collect()]
    assert sorted(t.split()[0] for _, t in got) == ["a0", "b0", "c0", "d0", "e0", "f0", "g0"]
    assert {i for i, t in got if t[0] in "cdf"} == {7} and (8, text("e")) in got


@pytest.mark.parametrize("deletes", [False, True])
def test_linked_sets_meet_and_sketches_allow_them(monkeypatch, deletes):
    """Sets at the edge of the threshold share a sent signature by either scheme, and their sketches do not tell them apart."""
    bands = near_duplicates.Bands()
    if deletes:
        bands.deletes = bands.differ > 0
        bands.segments = (bands.differ + 2) // 2
    monkeypatch.setattr(near_duplicates, "BANDS", bands)
    r = np.random.default_rng(1)
    for n in [4, 5, 6, 7, 9, 12, 15, 16, 20, 33, 57, 63, 100, 300, 1000, 4096]:
        for cut in sorted({0, 1, n // 8, n // 4 - 1, n // 4} & set(range(n // 4 + 1))):
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            b = np.sort(np.concatenate([a[: n - cut], r.integers(0, 2**63, n // 4 - cut).astype(np.uint64)]))
            if 4 * (n - cut) < 3 * (n + n // 4 - cut) or len(a) == len(b) == n - cut:
                continue
            both, ends = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            kind = np.where(np.isin(both, np.intersect1d(a, b)), both % 3 + 1, 0).astype(np.uint8)
            sig, of = near_duplicates.signatures(both, ends, kind)
            assert len(np.intersect1d(sig[of == 0], sig[of == 1])) > 0
            band = near_duplicates.Bands.of(np.diff(ends))
            low, high = near_duplicates._sketches([near_duplicates.sketch(a), near_duplicates.sketch(b)], band)
            small, large = (0, 1) if len(a) <= len(b) else (1, 0)
            mine = low[small] if band[0] == band[1] else high[small]
            assert np.bitwise_count(mine ^ low[large]).sum() <= len(np.setxor1d(a, b)) <= near_duplicates.may_differ(len(a), len(b))


def test_apart_classes_of_a_hot_signature_are_compared_in_blocks(spark, docs, monkeypatch):
    """Many texts that share a passage and are not similar, some of them with a near copy, with blocks of a few classes."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    r = random.Random(11)
    words = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    passage, rows = words(60), []
    pool = [words(12) for _ in range(6)]
    for k in range(24):
        own = [w for p in r.sample(pool, 3) for w in p]
        rows.append((k, " ".join(passage + own)))
        if k % 5 == 0:
            rows.append((100 + k, " ".join([*passage, *own, "tail"])))
    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for _ in rows:  # smallest labels spread over links
        for a in sets:
            for b in sets:
                if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    got = near_duplicates.join(docs(rows)).collect()
    assert {x.doc_id: x.component_id for x in got} == label and len(set(label.values())) > 3


def test_keeping_one_keeps_clashing_columns(spark, docs):
    text = " ".join(f"w{k}" for k in range(30))
    rows = docs([(1, text), (2, text), (3, None), (4, "")], piece="p", at=5, row=6, h=7, stays=8, label=9)
    got = near_duplicates.keep_one(rows)
    assert got.columns == rows.columns and sorted(r.doc_id for r in got.collect()) == [1, 3, 4]
    assert {(r.piece, r.at, r.row, r.h, r.stays, r.label, r.bucket) for r in got.collect()} == {("p", 5, 6, 7, 8, 9, 7)}
    cut = substring_dedup.dedup(rows)
    assert cut.columns == [c for c in rows.columns if c != "n_words"] + ["n_words", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed, r.piece, r.h) for r in cut.collect()} == {1: (text, 0, "p", 7), 2: ("", 30, "p", 7), 3: ("", 0, "p", 7), 4: ("", 0, "p", 7)}


@pytest.mark.parametrize("seed", [3])
def test_substrings_agree_with_a_plain_scan(spark, docs, seed):
    rows, seen, expected = corpus(seed), set(), []
    last = None
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        if (i, t) != last:
            for k in range(len(words) - 19):
                window = tuple(words[k : k + 20])
                if window in seen:
                    gone[k : k + 20] = [True] * 20
                seen.add(window)
        last = (i, t)
        expected.append((i, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    got = substring_dedup.dedup(docs(rows))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()) == sorted(expected)
    assert substring_dedup.dedup(docs([])).count() == 0 == near_duplicates.join(docs([])).count()


@pytest.mark.parametrize("holders", [3, 6, 20])
def test_a_passage_goes_however_many_pieces_hold_it(spark, docs, monkeypatch, holders):
    monkeypatch.setattr(substring_dedup.exchange, "PIECE_BYTES", 600)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(120)) + " " + passage) for i in range(holders)]
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup(docs(rows)).collect()}
    assert got == {i: 60 if i else 0 for i in range(holders)}


def test_rules_on_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (3, "a b"), (4, "# # x\n# # x\n\n" + "w " * 4), (5, " ".join(f"word{k}" for k in range(30)))]
    got = {r.doc_id: r for r in quality_rules.judge(docs(rows)).collect()}
    assert [got[i].base_failed for i in range(1, 6)] == [True, True, True, False, False]
    assert (got[4].n_symbols, got[4].n_dup_lines, got[4].n_words, got[4].n_repeat_words) == (4, 1, 10, 0)
    assert got[5].kept and got[1].n_words == 0
    assert quality_rules.judge(docs([])).count() == 0
    assert sorted(r.doc_id for r in quality_rules.keep(docs(rows)).collect()) == [4, 5]


def test_classifier_learns_and_keeps_columns(spark, docs):
    r = random.Random(1)
    good = [(k, " ".join(r.choice(["the", "of", "and", "tree", "house"]) for _ in range(40))) for k in range(60)]
    bad = [(100 + k, " ".join(r.choice(["BUY!!", "NOW!!", "$$$", "the"]) for _ in range(40))) for k in range(60)]
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(100 + k, 0) for k in range(40)] + [(999, 1), (5, None)], "doc_id long, label int")
    d = docs(good + bad + [(900, None), (901, "")])
    scored = {x.doc_id: x.score for x in quality_model.score(d, quality_model.train(d, labels)).collect()}
    assert all(scored[k] > 0.5 for k in range(60)) and all(scored[100 + k] < 0.5 for k in range(60))
    assert scored[900] == scored[901] and 0 <= scored[900] <= 1
    blank = quality_model.train(d, labels.limit(0))
    assert set(x.score for x in quality_model.score(d, blank).collect()) == {0.5}
