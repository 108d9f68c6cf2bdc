"""BPE encoding by dynamic programming over prefixes, and decoding.

A word's encoding is determined prefix by prefix: the encoding of a prefix ends in one token, and a token that ends
there belongs to the encoding exactly if it is compatible with the last token of the prefix before it, that is, if the merges leave
the two apart. An automaton over the vocabulary yields all tokens that end at a place; pair tests are kept by pair.
The last token of every prefix is stored, and the ids are read off by following the lengths back.

White space is dropped before words are made, so a text's chunks between spaces are encoded once a process and kept.
Normalization and word boundaries are the vocabulary file's own, applied by the tokenizers library; the model step is this module's.

Defined cases: a null or empty text has no ids and decodes to the empty string; special tokens that stand in a text become
their ids; repeated rows are encoded each; an empty table gives no rows; `encode` returns doc_id and
its results only.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import table
from sightline.llm.tokens import vocabulary

NAME = "op6_bpe_codec"
#: Kept chunks, words and pair tests a process; beyond it a cache starts anew.
CACHE = 600_000


class PrefixEncoder:
    """Encoder and decoder for a vocabulary file with merges and an end-of-word suffix (which may be empty)."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        library, model = Tokenizer.from_file(path), config["model"]
        self.normalizer, self.pre_tokenizer = library.normalizer, library.pre_tokenizer
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        vocab = model["vocab"]
        self.text_of = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, k in (*vocab.items(), *self.special.items()):
            self.text_of[k] = token
        self.bytes_of = [t.encode() for t in self.text_of]
        #: A symbol is one character; the last symbol of a word carries the suffix and has a character of its own.
        self.parts: dict[int, tuple[int, int]] = {}
        self.symbols: dict[int, str] = {}
        for token, k in vocab.items():
            own = self._symbols(token[: -len(self.suffix)], True) if self.suffix and token.endswith(self.suffix) and token != self.suffix else self._symbols(token, False)
            self.symbols[k] = own
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for order, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[a], vocab[b]] = (order, vocab[a + b])
        self.base = {s: k for k, s in self.symbols.items() if len(s) == 1}
        self.automaton = ahocorasick.Automaton()
        for k, s in self.symbols.items():
            if len(s) == 1 or self._merged(s) == [k]:  # a token that no merges make is never emitted
                self.automaton.add_word(s, (len(s), k))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def _symbols(self, word: str, ends: bool) -> str:
        return word[:-1] + chr(ord(word[-1]) + 0x10000) if ends and self.suffix and word else word

    def _merged(self, symbols: str) -> list[int]:
        """The ids left when merges are applied, lowest rank first and leftmost first; for single tokens and pairs."""
        ids = [self.base[s] for s in symbols]
        while len(ids) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            order = best[0]
            i, out = 0, []
            while i < len(ids):
                found = self.rank.get((ids[i], ids[i + 1])) if i + 1 < len(ids) else None
                if found and found[0] == order:
                    out.append(found[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def compatible(self, a: int, b: int) -> bool:
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            found = self.pairs[a, b] = self._merged(self.symbols[a] + self.symbols[b]) == [a, b]
        return found

    def encode_symbols(self, symbols: str) -> list[int]:
        """The last token of every prefix, then the ids by the lengths back."""
        n = len(symbols)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(symbols):
            ends[end].append(match)
        for i in range(n):
            for length, token in ends[i]:
                at = i + 1 - length
                if at == 0 or (last[at] >= 0 and self.compatible(last[at], token)):
                    last[i + 1], size[i + 1] = token, length
                    break
            else:
                raise ValueError(f"no token ends a prefix of {symbols!r}")
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def _chunk(self, chunk: str) -> bytes:
        parts = self.split_special.split(chunk) if self.split_special else [chunk]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                for word, _ in self.pre_tokenizer.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    ids = self.words.get(word)
                    if ids is None:
                        if len(self.words) > CACHE:
                            self.words.clear()
                        ids = self.words[word] = np.array(self.encode_symbols(self._symbols(word, True)), "<u4").tobytes()
                    out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        chunks, words = self.chunks, (text or "").split(" ")
        try:
            return b"".join([chunks[w] for w in words])
        except KeyError:
            if len(chunks) > CACHE:
                chunks.clear()
            for w in words:
                if w not in chunks:
                    chunks[w] = self._chunk(w)
            return b"".join([chunks[w] for w in words])

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8. A vocabulary without decoder joins its tokens by spaces."""
        texts = self.bytes_of
        return b" ".join([texts[k] for k in np.frombuffer(ids, "<u4").tolist()])


_CODECS: dict[str, PrefixEncoder] = {}


def codec(path: str) -> PrefixEncoder:
    """One codec a process and vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = PrefixEncoder(path)
    return _CODECS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (little-endian 32 bits) of every text."""
    path = path or vocabulary("word_bpe_49k.json")

    def run(batches):
        c = codec(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.encode(t) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and the decoded text of them."""
    path = path or vocabulary("word_bpe_49k.json")

    def run(batches):
        c = codec(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [c.decode(i or b"").decode() for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = decode(encode(table(spark, sf_dir, "documents")))
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
