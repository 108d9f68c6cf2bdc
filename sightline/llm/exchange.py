"""Packed exchange between pieces of a table: which elements do other pieces hold as well?

Documents lie in a table of pieces (a few MB of text each), bucketed by piece. A piece sends the hashes of its elements (anchors, shingles, windows), each
distinct one once, as a row for each bucket of hashes. A bucket's rows meet in one group function, which answers each row with
bits in the order of its elements. The answer joins the piece again, which makes the same elements from the same texts. So neither places nor
document ids travel with an element, and texts do not move at all.

The number of buckets follows the amount of text, so a group has a bounded number of distinct elements. An element that a third of all documents hold comes
once from each piece: thousands of documents are one entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text whose elements make up one bucket, about, and buckets at least.
BUCKET_BYTES, BUCKETS = 4 << 20, 24
#: Bytes of text in a piece, about.
PIECE_BYTES = 16 << 20
REPLY = "piece long, bucket int, bits binary"
_REPLY = pa.schema([("piece", pa.int64()), ("bucket", pa.int32()), ("bits", pa.binary())])
#: Pieces that hold an element: kinds 1, 2 and 3 from these numbers on.
MANY = (2, 4, 16)


def buckets_for(total: int) -> int:
    return max(BUCKETS, total // BUCKET_BYTES)


def _ends(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket ends among ascending hashes."""
    at = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return np.cumsum(np.bincount(at.astype(np.int64), minlength=buckets))


def sent_schema(*names: str) -> str:
    return "bucket int, piece long, " + ", ".join(f"{n} binary" for n in names)


def cut(piece: int, h: np.ndarray, buckets: int, **arrays: np.ndarray) -> pa.Table:
    """A row for each bucket that holds elements; `h` ascends, `arrays` go along in its order (two-dimensional ones by row)."""
    ends = _ends(h, buckets)
    used = np.flatnonzero(np.diff(ends, prepend=0))
    spans = [(int(ends[b - 1]) if b else 0, int(ends[b])) for b in used.tolist()]
    columns = {"bucket": pa.array(used, pa.int32()), "piece": pa.array(np.full(len(used), piece), pa.int64())}
    for name, values in arrays.items():
        columns[name] = pa.array([values[i:j].tobytes() for i, j in spans], pa.binary())
    return pa.table(columns)


def low_bytes(h: np.ndarray, n: int) -> np.ndarray:
    """The n low bytes of each hash, a row each."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n])


def replies(got: pa.Table, sizes: np.ndarray, *planes: np.ndarray) -> pa.Table:
    """Bits for the elements of each sent row, plane after plane."""
    ends = np.cumsum(sizes)
    bits = [b"".join(np.packbits(plane[j - n : j]).tobytes() for plane in planes) for n, j in zip(sizes.tolist(), ends.tolist(), strict=True)]
    return pa.table([got.column("piece"), got.column("bucket"), pa.array(bits, pa.binary())], schema=_REPLY)


def kinds(sent: DataFrame) -> DataFrame:
    """For elements sent as three low bytes: 0 if one piece holds it, else 1 to 3 (see MANY).

    Elements of a bucket that agree in three bytes count as one, so a few are taken to be held by others when they are not.
    """
    def run(got):
        raw = got.column("low").to_pylist()
        sizes = np.array([len(x) for x in raw], np.int64) // 3
        wide = np.zeros((int(sizes.sum()), 4), np.uint8)
        wide[:, :3] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 3)
        _, at, times = np.unique(wide.view("<u4").reshape(-1), return_inverse=True, return_counts=True)
        kind = np.searchsorted(MANY, times, "right")[at]
        return replies(got, sizes, (kind & 1).astype(bool), kind >= 2)

    return sent.groupBy("bucket").applyInArrow(run, REPLY)


def read(h: np.ndarray, buckets: int, numbers: list[int], bits: list[bytes], planes: int) -> np.ndarray:
    """The answers to elements sent with `cut`, as a number of `planes` bits each; `numbers` are the buckets of the answers."""
    ends = _ends(h, buckets)
    out = np.zeros(len(h), np.uint8)
    for b, raw in zip(numbers, bits, strict=True):
        i, j = int(ends[b - 1]) if b else 0, int(ends[b])
        size = -(-(j - i) // 8)
        for k in range(planes):
            out[i:j] |= np.unpackbits(np.frombuffer(raw, np.uint8, size, k * size), count=j - i) << k
    return out
