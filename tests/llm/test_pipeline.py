"""The corpus pipeline against brute force, stage by stage in plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from sightline.llm import packing, quality_rules, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASSES = ["[a-z]", "[A-Z]", "[\\x09-\\x0D ]", "[0-9]", "[.,;:'\"()-]", "[\\x00-\\x7F]", "[^\\x00-\\x7F]"]


def fixture():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 6)))
    good, spam = ["the", "of", "and"] + [word() for _ in range(300)], [word() + "xyz" for _ in range(300)]
    text = lambda n=45, of=good: "".join(r.choice(of) + r.choice([" ", " ", "\n", "  "]) for _ in range(n)).strip()
    plain, bad = [(k, text(80 if k < 10 else 45)) for k in range(50)], [(100 + k, text(40, spam)) for k in range(50)]
    passage = text(30)
    rows = plain + bad + [(None, text()), (None, text()), (7, text()), (60, passage), (61, text(15) + "\n" + passage + "\t" + text(15)), (62, "\n " + " ".join(passage.split()[:22])), (None, text(20) + "\n\n" + passage)]
    rows += [(70, plain[20][1]), (None, plain[21][1]), (71, plain[22][1].replace("\n", " ") + " tail"), (plain[23][0], plain[23][1])]  # copies
    rows += [(80, "too short"), (81, None), (82, "\n"), (83, "one two three four five six\n" * 9), (84, " ".join(f"9{k}A#" for k in range(80)))]
    return rows, bad, {k: int(k < 100) for k, _ in plain + bad}


def rules(rows):
    def counts(t):
        words, chars = WORD.findall(t or ""), Counter(next(k for k, c in enumerate(CLASSES) if re.match(c, x)) for x in t or "")
        tidy, listed = [re.sub("[.,]+$", "", w).lower() for w in words], quality_rules.COMMON_WORDS["en"]
        grams = defaultdict(list)
        for k in range(len(words) - 4):
            grams[tuple(words[k : k + 5])].append(k)
        repeated = {k + i for at in grams.values() if len(at) > 1 for k in at for i in range(5)}
        failed = len(words) < 10 or 5 * len(repeated) > len(words)
        return failed, len(words), [chars[k] for k in range(7)], [tidy.count(w) for w in listed] + [sum(w not in listed for w in tidy)]

    def distance(a, b):
        p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
        part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
        return math.sqrt(max(0.0, sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2))

    found = [counts(t) for _, t in rows]
    fit = [f for f in found if not f[0] and f[1] >= 60]
    classes, commons = ([sum(c) for c in zip(*(f[k] for f in fit))] for k in (2, 3))
    near = lambda f: (sum(f[2]) < 200 or distance(f[2], classes) <= 0.315) and (f[1] < 60 or distance(f[3], commons) <= 0.318)
    return [row for row, f in zip(rows, found) if not f[0] and near(f)]


def one_each(rows):
    sets = []
    for _, t in rows:
        w = WORD.findall(t.lower())
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    return [min((rows[k] for k in range(len(rows)) if group[k] == g), key=lambda x: (x[0] is None, x[0])) for g in sorted(set(group))]


def without_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)):
        words = WORD.findall(t)
        gone = [False] * len(words)
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(window)
        kept = [w for w, g in zip(words, gone) if not g]
        if kept:
            out.append((i, " ".join(kept) if any(gone) else t))
    return out


def test_run_agrees_with_brute_force(spark, docs, tmp_path):
    rows, bad, quality = fixture()
    order = lambda found: sorted(found, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, q, 0) for k, q in quality.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    stages = [rules(rows)]
    stages.append([x for x in stages[0] if x not in bad])  # the classifier, on words that tell
    stages.append(one_each(stages[1]))
    stages.append(without_repeats(stages[2]))
    sizes = [len(s) for s in [rows, *stages]]
    assert all(a > b for a, b in zip(sizes, sizes[1:])) and any("\n" in t for _, t in stages[3]) and None in {i for i, _ in stages[3]}
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (name, stage), expected in zip(corpus_pipeline.STAGES, stages):
        at = stage(spark, at, str(tmp_path)).checkpoint()
        assert order((x.doc_id, x.text) for x in at.collect()) == order(expected), name
        assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert at.filter(F.col("n_chars") != F.char_length("text")).count() == 0
    encode = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json")).encode
    expected = [(i, bytes(c + bytes([packing.END_ID, 0, 0, 0]))) for (i, _), c in zip(stages[3], encode([t for _, t in stages[3]]))]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert order((x.doc_id, bytes(x.ids)) for x in got) == order(expected)
    ends = Counter()
    for x in sorted(got, key=lambda x: (x.sequence_id, x.sequence_offset)):
        assert x.sequence_offset >= ends[x.sequence_id] and 4 * x.length == len(x.ids)
        ends[x.sequence_id] = x.sequence_offset + x.length
    assert max(ends.values()) <= packing.CAPACITY
