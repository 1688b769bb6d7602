"""Byte-level BPE as a monoid tree reduction.

A match of the splitting pattern is encoded by halves; two neighbours are
joined by re-encoding a window of tokens around their boundary. The window
grows until the token left of it and its own first token, and its last token
and the one right of it, are stable neighbours. A sequence of tokens is the
encoding of its bytes exactly if the two tokens of each adjacent pair encode
to themselves, so everything outside the window is then proven to stand.
Decoding concatenates bytes up a tree of the ids.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, row_slices, small_batches, text_or_empty, tidy, worker_cache

#: Bytes up to which a piece is merged directly, the tree's leaf.
LEAF = 24
#: Ids up to which decoding joins directly.
DECODE_LEAF = 4096
#: Characters up to which a text's matches are listed at once.
LISTED = 1 << 20


class ByteBPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.stable = Memo(lambda pair: self.merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == list(pair))

    def merge(self, data: bytes) -> list[int]:
        """Merge by rank, leftmost first among equals, with a heap of candidate pairs over a linked list."""
        ranks = self.ranks
        n = len(data)
        if n <= LEAF:
            parts = [data[i : i + 1] for i in range(n)]
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    r = ranks.get(parts[i] + parts[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return [ranks[p] for p in parts]
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 once merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours' concatenation."""
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            seam = self.merge(b"".join([self.bytes_of[t] for t in left[len(left) - a :] + right[:b]]))
            left_stands = a == len(left) or self.stable[left[-a - 1], seam[0]]
            right_stands = b == len(right) or self.stable[seam[-1], right[b]]
            if left_stands and right_stands:
                return left[: len(left) - a] + seam + right[b:]
            a, b = a if left_stands else 2 * a, b if right_stands else 2 * b

    def encode(self, data: bytes) -> list[int]:
        if (whole := self.ranks.get(data)) is not None:
            return [whole]
        if len(data) <= LEAF:
            return self.merge(data)
        mid = len(data) // 2
        return self.join(self.encode(data[:mid]), self.encode(data[mid:]))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= DECODE_LEAF:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def load(path: str) -> ByteBPE:
    import base64

    with open(path, "rb") as lines:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def encoder(path: str, pattern: str):
    """A function from a text to its ids as bytes (little-endian unsigned 32-bit)."""
    import itertools
    import struct

    import regex

    bpe = load(path)
    # White space as the Unicode property has it; the information separators are none.
    split = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))

    def packed(piece: str) -> bytes:
        ids = bpe.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    memo = Memo(packed, 250_000)

    def encode(text: str) -> bytes:
        if len(text) <= LISTED:
            return b"".join(map(memo.__getitem__, split.findall(text)))
        found = (m[0] for m in split.finditer(text))
        return b"".join(iter(lambda: b"".join(map(memo.__getitem__, itertools.islice(found, 1 << 16))), b""))

    return encode


def encode_texts(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (little-endian unsigned 32-bit ids, as binary): every whole text encoded, null as empty, one row per input row."""

    def run(batches):
        import pyarrow as pa

        encode = worker_cache("bpe", ranks, lambda: encoder(ranks, pattern))
        for batch in batches:
            texts = batch.column(1)
            import pyarrow.compute as pc

            for a, b in row_slices(pc.binary_length(texts).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(map(encode, texts.slice(a, b - a).to_pylist()), pa.binary())], names=["id", "ids"])

    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text")).mapInArrow(tidy(run), "id long, ids binary")


def decode_ids(df: DataFrame, ranks: str) -> DataFrame:
    """``id``, ``ids`` and ``decoded`` (binary): the bytes that the ids stand for. Null ids decode to null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        bpe = worker_cache("bpe-ids", ranks, lambda: load(ranks))
        for batch in batches:
            ids = batch.column(1)
            for a, b in row_slices([n or 0 for n in pc.binary_length(ids).to_pylist()]):
                some = ids.slice(a, b - a)
                decoded = [None if x is None else bpe.decode(np.frombuffer(x, dtype="<u4").tolist()) for x in some.to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), some, pa.array(decoded, pa.binary())], names=["id", "ids", "decoded"])

    return df.select("id", "ids").mapInArrow(tidy(run), "id long, ids binary, decoded binary")
