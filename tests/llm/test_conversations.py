"""The conversation trie against a plain walk."""

import hashlib
import random
import zlib

import pytest

from sightline.llm import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, base int, k string, part int"


def plain(rows):
    """Rows of the trie, from (conv_id, turn, role, text) rows of distinct turns."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes.setdefault(tuple(built[c][:d]), []).append(c)
    below = {p: [q for q in nodes if q[: len(p)] == p] for p in nodes}
    out = []
    for p, members in nodes.items():
        children = [q for q in below[p] if len(q) == len(p) + 1]
        leaves = [q for q in below[p] if not any(len(x) == len(q) + 1 for x in below[q])]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below[p] if q)
        ends = ",".join(str(c) for c in members if len(built[c]) == len(p))
        out.append((members[0], len(p), nodes[p[:-1]][0] if p else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    r = random.Random(seed)
    said = [f"tèxt {k}" * r.randint(1, 3) for k in range(4)] + ["", None]
    rows = []
    for c in [0, 1, 2, 3, 99, 100, 101, 105, 250, 251, 300, -5, -100, -101, -250, 10**12 + 7]:
        turns = list(range(r.randint(1, 12)))
        for k in turns:
            role = [None, "user", "assistant"][k % 3]
            # long shared starts, so that families and strangers meet
            rows.append((c, None if k == 0 and c % 3 == 0 else k * 2, role, said[k % 6] if r.random() < 0.8 else r.choice(said)))
    return rows + [(None, 0, "user", "lost")]


@pytest.mark.parametrize("seed,limit", [(1, 4096), (2, 2), (3, 1), (4, 3)])
def test_the_trie_agrees_with_a_plain_walk(spark, seed, limit):
    rows = conversations(seed)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(*row, 1, "x", 2) for row in rows], SCHEMA).repartition(3)
    got = conversation_trie.trie(df, limit)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_an_empty_table_gives_no_nodes_and_repeated_rows_each_count(spark):
    assert conversation_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(100, 0, "user", "a")] * 3 + [(7, None, None, None)]
    got = conversation_trie.trie(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA)).collect()
    assert sorted(r.depth for r in got if r.conv_id == 100) == list(range(1, max(0, 3 - zlib.crc32(b"100") % 6) + min(3, zlib.crc32(b"100") % 6) + 1))


def test_a_long_conversation_and_a_hot_ending(spark):
    rows = [(500, k, "user", "abc"[k % 3]) for k in range(300)] + [(c, 0, "user", "same") for c in range(600, 640)]
    got = conversation_trie.trie(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA), 16).collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
