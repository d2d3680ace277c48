"""Directly addressable codes: a token file with random access to any token.

An id is split into 8-bit chunks, lowest first. Level k holds the k-th chunks
of all ids that have one, one byte each, and a bitmap that says which of them
go on in level k+1. A rank directory counts the set bits before each block of
512, so that token i is found by one byte and one rank per level; nothing
before it is decoded.

File (little-endian): magic ``TDAC1\\0\\0\\0``; uint64 n_docs, n_tokens,
n_levels; int64 doc ids; uint8 null flags of doc ids; uint64 n_docs+1 token
starts; then for each level uint64 n, n bytes of chunks, the bitmap in
(n+7)//8 bytes, the directory in n//512+1 uint64. Sections are padded to 8 bytes.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"TDAC1\0\0\0"
BLOCK = 512
_BITS = np.array([bin(b).count("1") for b in range(256)], dtype=np.uint8)


def _padded(x: np.ndarray) -> bytes:
    data = x.tobytes()
    return data + bytes(-len(data) % 8)


def encode(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    """One shard. ids: the tokens of all documents, one after the other."""
    nulls = np.array([d is None for d in doc_ids], dtype=np.uint8)
    keys = np.array([d or 0 for d in doc_ids], dtype="<i8")
    starts = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).astype("<u8")
    levels = []
    rest = ids.astype(np.uint32, copy=False)
    while True:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        set_bits = _BITS[bitmap].astype(np.uint64)
        step = BLOCK // 8
        sums = np.add.reduceat(set_bits, np.arange(0, len(set_bits), step)) if len(set_bits) else np.zeros(0, np.uint64)
        ranks = np.zeros(len(rest) // BLOCK + 1, dtype="<u8")
        before = np.concatenate([[0], np.cumsum(sums)]).astype("<u8")
        ranks[:] = before[: len(ranks)]
        levels += [np.array([len(rest)], "<u8").tobytes(), _padded(rest.astype(np.uint8)), _padded(bitmap), ranks.tobytes()]
        if not more.any():
            break
        rest = rest[more] >> 8
    head = [MAGIC, np.array([len(keys), len(ids), len(levels) // 4], "<u8").tobytes(), keys.tobytes(), _padded(nulls), starts.tobytes()]
    return b"".join(head + levels)


class Reader:
    """A shard's bytes, read in place."""

    def __init__(self, data):
        self.data, self.at = memoryview(data), len(MAGIC)
        if bytes(self.data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a token shard")
        self.n_docs, self.n_tokens, n_levels = map(int, self._take("<u8", 3))
        keys, nulls = self._take("<i8", self.n_docs), self._take("u1", self.n_docs)
        self.doc_ids = [None if z else k for k, z in zip(keys.tolist(), nulls.tolist(), strict=True)]
        self.starts = self._take("<u8", self.n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(self._take("<u8", 1)[0])
            self.levels.append((n, self._take("u1", n), self._take("u1", (n + 7) // 8), self._take("<u8", n // BLOCK + 1)))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self.data, dtype=kind, count=n, offset=self.at)
        self.at += -(-out.nbytes // 8) * 8
        return out

    def rank(self, level: int, i: int) -> int:
        """Set bits before place i of a level's bitmap."""
        _, _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        lo, hi = block * BLOCK // 8, i // 8
        r = int(ranks[block]) + int(_BITS[bitmap[lo:hi]].sum())
        return r + (bin(int(bitmap[hi]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0)

    def token(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (_, chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if not bitmap[i // 8] >> i % 8 & 1:
                break
            i = self.rank(k, i)
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Tokens lo to hi as uint32; reads only their chunks."""
        out = np.zeros(hi - lo, dtype="<u4")
        at = None
        for k, (_, chunks, bitmap, _) in enumerate(self.levels):
            part = chunks[lo:hi].astype(np.uint32) << (8 * k)
            if at is None:
                out |= part
            else:
                out[at] |= part
            more = np.unpackbits(bitmap[lo // 8 : (hi + 7) // 8], bitorder="little")[lo % 8 : lo % 8 + hi - lo].astype(bool)
            n = int(more.sum())
            if not n:
                break
            at = np.flatnonzero(more) if at is None else at[more]
            lo = self.rank(k, lo)
            hi = lo + n
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k + 1]))
