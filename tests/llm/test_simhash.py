"""SimHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from sightline.llm import simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text, k=4):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] * bool(w)
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def all_pairs(rows, radius=4):
    fps = [print_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                up[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    smallest = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, f"{fps[k]:016x}", smallest[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["Alpha", "beta", "Gämma", "delta", "eps", "zeta", "éta", "theta", "iota", "KAPPA"]) + str(r.randint(0, 30))
    rows = [(0, None), (1, ""), (2, "\t \n"), (3, "one two"), (4, "One\x0bTWO"), (5, "x " * 700), (-6, "a b c d"), (None, "lonely words stand here alone"), (None, "one two")]
    bases = [[word() for _ in range(r.randint(60, 900))] for _ in range(6)]
    for k in range(70):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            words[r.randrange(len(words))] = word()
        rows.append((k * 7 - 20, r.choice([" ", "\n", "  \t"]).join(words)))
    return [*rows, (9, "twice the same id"), (9, "another text of the same id"), rows[20], rows[20]]


@pytest.mark.parametrize("seed,parts,tile", [(1, None, 2048), (2, 8, 3), (3, 1, 2), (4, 2, 5)])
def test_components_agree_with_all_pairs(spark, docs, seed, parts, tile):
    rows = corpus(seed)
    expected = all_pairs(rows)
    assert len({c for *_, c in expected}) < len(rows) - 20  # there are links
    got = simhash.join(docs(rows, fp="x", ids=1, label=2).repartition(3), parts=parts, tile=tile).collect()
    assert sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in got), key=str) == expected


def test_long_texts_and_empty_tables(spark, docs):
    text = " ".join(f"w{k % 977}" for k in range(300_000))  # over one run of shingles
    data = np.frombuffer(text.encode(), np.uint8)
    assert int(simhash.fingerprints(data, np.array([0, len(data)]))[0]) == print_of(text)
    assert simhash.join(docs([])).count() == 0


def test_a_chain_of_links_is_one_component():
    fp = np.array([0b1111, 0, 1 << 40, (1 << 60) - 1, 0b11111111], np.uint64)
    assert simhash.forest(fp, fp, 4).tolist() == [0, 0, 0, 3, 0] * 2
    r = np.random.default_rng(1)
    many = r.integers(0, 1 << 12, 700).astype(np.uint64)  # few bits: long chains
    label = simhash.forest(many[:300], many[300:], 1)
    near = np.bitwise_count(many[:300, None] ^ many[None, 300:]) <= 1
    assert all(label[x] == label[300 + y] for x, y in zip(*np.nonzero(near), strict=True))
    assert all((near[x].any() or label[x] == x) for x in range(300))
