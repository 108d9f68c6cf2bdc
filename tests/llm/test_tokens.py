"""Encoding, packing, token files and the prefix codec against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from sightline.llm import bpe_codec, packing, token_files, tokens  # noqa: E402
from sightline.llm.tokens import ByteEncoder, encoder, runs, vocabulary  # noqa: E402

ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n \n b", "x<|endoftext|> y", "don't 'S", "İ ΣΑΣ ẞ é é", "日本 \u3000 \x1c \x85x", "word " * 3000, "a" * 5000]


def tokenizer(name):
    return Tokenizer.from_file(vocabulary(name))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tab'sé1!<|>\x1c\u00a0", max_size=40))
def test_cached_words_encode_as_the_library_does(text):
    path = vocabulary("byte_bpe_50k.json")
    assert np.frombuffer(encoder(path).encode([text])[0], "<u4").tolist() == tokenizer("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids


def test_runs_hold_every_text_and_bounded_bytes():
    texts = pa.array(["a" * n for n in (3, 0, 30, 4, 4, 4)] + [None, "b"])
    got = list(runs(texts, 3, 10))
    assert [a for a, _ in got] == [0, 2, 3, 5] and sum(n for _, n in got) == len(texts) and list(runs(texts.slice(0, 0))) == []


def test_words_of_the_older_half_of_the_cache_are_learned_once(monkeypatch):
    own, texts, learned = ByteEncoder(vocabulary("byte_bpe_50k.json")), ["x one two  \t three", "x one four", "x \u3000five one"], []
    learn = own._learn_joined
    monkeypatch.setattr(tokens, "CACHE", 2)
    monkeypatch.setattr(own, "_learn_joined", lambda words: learned.extend(words) or learn(words))
    library = tokenizer("byte_bpe_50k.json")
    for text in texts:
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert learned.count("one") == 1


def test_prefix_codec_is_the_library_s():
    own, library = bpe_codec.PrefixEncoder(vocabulary("word_bpe_49k.json")), tokenizer("word_bpe_49k.json")
    for text in ODD:
        ids = library.encode(text or "", add_special_tokens=False).ids
        got = own.encode(text)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert own.decode(got).decode() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_ranks_round_trip(values):
    values = np.array(values, np.uint32)
    control, data = token_files.encode_ranks(values)
    assert (token_files.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(values)) == values).all()


def test_packing_places_every_piece_once(spark, docs):
    rows = list(enumerate(ODD)) + [(3, "a"), (None, "b c")]
    got = packing.pack_documents(docs(rows), with_ids=True).collect()
    library = tokenizer("byte_bpe_50k.json")
    total = sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in got) == total and all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.sequence_offset, r.length))
    for placed in bins.values():
        placed.sort()
        assert [o for o, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))] and sum(n for _, n in placed) <= packing.CAPACITY
    assert len(bins) <= -(-total // packing.CAPACITY) + 2
    assert packing.pack_documents(docs([])).count() == 0


def test_token_files_read_back(spark, docs):
    library, least = tokenizer("byte_bpe_50k.json"), -(1 << 63)
    encode = lambda t: library.encode(t or "", add_special_tokens=False).ids + [2]
    rows = [*enumerate(ODD), (None, "no id"), (None, None), (least, "the least id"), (3, "again"), (3, "again"), (99, "long " * 60_000)]
    got = token_files.write_token_files(docs(rows)).documents().collect()
    read = sorted((r.start, r.n_tokens, r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got)
    assert sorted((d is not None, d or 0, ids) for _, _, d, ids in read) == sorted((i is not None, i or 0, tuple(encode(t))) for i, t in rows)
    assert [(d is not None, d or 0) for _, _, d, _ in read] == sorted((i is not None, i or 0) for i, _ in rows)
    assert [s for s, _, _, _ in read] == [sum(n for _, n, _, _ in read[:k]) for k in range(len(read))] and all(r.ids_crc32 == zlib.crc32(r.ids) for r in got)
    assert token_files.write_token_files(docs([])).documents().count() == 0


def test_packing_goes_on_over_rounds_of_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 40)
    r = np.random.default_rng(3)
    sizes = r.integers(1, 900, 400).tolist()
    items = spark.createDataFrame([(k, n, "keep") for k, n in enumerate(sizes)], "k int, size long, sequence string").repartition(8)
    got = packing.pack(items, "size", 1000).collect()
    assert sorted(x.k for x in got) == list(range(400)) and all(x.size == sizes[x.k] and x.sequence == "keep" for x in got)
    bins = {}
    for x in sorted(got, key=lambda x: x.sequence_offset):
        assert x.sequence_offset == bins.get(x.sequence_id, 0)
        bins[x.sequence_id] = x.sequence_offset + x.size
    assert max(bins.values()) <= 1000 and len(bins) <= 1.1 * sum(sizes) / 1000


def test_whole_bins_leave_without_arrow(spark, docs):
    rows = [(i, " ".join(f"w{k}" for k in range(1 + i % 7))) for i in range(40)]
    packed = packing.pack_documents(docs(rows), capacity=16, with_ids=True)
    assert "MapInArrow" not in packed._jdf.queryExecution().executedPlan().toString()
    ends, seen = {}, 0
    for r in sorted(packed.collect(), key=lambda r: (r.sequence_id, r.sequence_offset)):
        assert r.sequence_offset == ends.get(r.sequence_id, 0) and len(r.ids) == 4 * r.length
        ends[r.sequence_id] = r.sequence_offset + r.length
        assert ends[r.sequence_id] <= r.sequence_length <= 16
        seen += 1
    assert seen >= 40
