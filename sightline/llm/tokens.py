"""Whole texts to token ids with a public byte-level BPE, one cached entry a word."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space that stands between white space (or at the end) belongs to a run that must stay whole.
_RUN = re.compile(r"\s (?:\s|\Z)")
#: Cached words a process, and bytes of them and their ids; beyond half of these the newer half of the cache becomes the older.
CACHE, CACHE_BYTES = 700_000, 32 << 20


def runs(texts: pa.Array, rows: int = 2000, size: int = 8 << 20):
    """(start, length) of runs of texts that are encoded together: many, as common words are then looked up once, but of bounded bytes unless one text is longer."""
    bytes_of = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(bytes_of, dtype=np.int64), 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        n = max(1, min(rows, int(np.searchsorted(ends, before + size, "right")) - at))
        yield at, n
        at += n


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteEncoder:
    """Encodes as the tokenizers library does, each distinct space-led word once.

    The pre-tokenizer of the vocabulary always cuts before a space that a non-space
    follows, so the pieces between such cuts are encoded alone with the same ids. Arrow splits a batch and numbers its
    distinct words, and numpy lays their ids out. Texts with longer runs
    of white space go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        added = self.tokenizer.get_added_tokens_decoder()
        self.size = np.zeros(max([*vocab.values(), *added]) + 1, np.int64)  # bytes of each token
        for token, k in vocab.items():
            self.size[k] = len(token)  # a character a byte
        for k, token in added.items():
            self.size[k] = len(token.content.encode())
        self.held = 0
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _bytes(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        texts = [t or "" for t in texts]
        whole = [i for i, t in enumerate(texts) if _RUN.search(t)]
        long = dict(zip(whole, self._bytes([texts[i] for i in whole]), strict=True)) if whole else {}
        out = [long.get(i, b"") for i in range(len(texts))]
        plain = [i for i in range(len(texts)) if i not in long]
        if not plain:
            return out
        if len(self.later) + len(self.first) > CACHE // 2 or self.held > CACHE_BYTES // 2:
            self.first, self.later, self.before, self.held = {}, {}, self.later, 0
        split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        bounds, words = split.offsets.to_numpy(), split.flatten()
        starts = bounds[:-1]
        openers = words.take(pa.array(starts)).to_pylist()
        self._learn(self.first, list(set(openers) - self.first.keys()), "")
        coded = words.dictionary_encode()
        of, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # a fraction of the time of to_pylist
        inner = np.ones(len(of), bool)
        inner[starts] = False
        used = np.flatnonzero(np.bincount(of[inner], minlength=len(known))).tolist()
        parts = [b""] * len(known)
        for k, ids in zip(used, self._later([known[k] for k in used]), strict=True):
            parts[k] = ids
        # each document's first word stands behind the others
        of[starts] = len(known) + np.arange(len(plain))
        parts += [self.first[w] for w in openers]
        n = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        at, counts = (np.cumsum(n) - n)[of], n[of]
        ends = np.cumsum(counts)
        ids = np.frombuffer(b"".join(parts), "<u4")[np.repeat(at - (ends - counts), counts) + np.arange(int(ends[-1]))].tobytes()
        cuts = (4 * np.concatenate([[0], ends])[bounds]).tolist()
        for k, i in enumerate(plain):
            out[i] = ids[cuts[k] : cuts[k + 1]]
        return out

    def _later(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words behind a space; those in the older half of the cache move to the newer."""
        out = list(map(self.later.get, words))
        gone = [k for k, ids in enumerate(out) if ids is None]
        if not gone:
            return out
        missing = [words[k] for k in gone]
        old = list(map(self.before.get, missing))
        moved = {w: ids for w, ids in zip(missing, old) if ids is not None}
        self.later.update(moved)
        self.held += sum(map(len, moved)) + sum(map(len, moved.values()))
        new = [w for w, ids in zip(missing, old) if ids is None]
        odd = [w for w in new if w[:1].isspace() or not w]
        self._learn(self.later, odd, " ")
        if odd:
            left = set(odd)
            new = [w for w in new if w not in left]
        for at in range(0, len(new), 20_000):
            self._learn_joined(new[at : at + 20_000])
        for k, ids in zip(gone, map(self.later.__getitem__, missing)):
            out[k] = ids
        return out

    def _learn(self, cache: dict[str, bytes], words: list[str], lead: str) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = self._bytes([lead + w for w in part])
            cache.update(zip(part, ids, strict=True))
            self.held += sum(map(len, part)) + sum(map(len, ids))

    def _learn_joined(self, words: list[str], run: int = 200) -> None:
        """Space-led words, many to a text: each is cut off at its bytes."""
        texts = [" " + " ".join(words[a : a + run]) for a in range(0, len(words), run)]
        ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, words)), np.int64, len(words)) + 1)
        cuts = (4 * (np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 1)).tolist()
        raw = ids.tobytes()
        self.held += len(raw) + int(ends[-1])
        self.later.update(zip(words, [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    """One encoder a process and vocabulary: workers are used again for later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]
