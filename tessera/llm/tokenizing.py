"""Byte-level BPE of whole texts by the tokenizers library, with its words cached.

A byte-level tokenizer splits a text by a fixed pattern and merges inside each
piece alone, so a text's ids are those of its pieces. Invented and natural
words repeat; each worker asks the library once for a piece and keeps the
answer, up to a bound. Texts with characters whose class could differ between
two Unicode versions, or with added tokens of the vocabulary, go to the
library whole, as do all texts of a tokenizer of another kind.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: Entries of each worker's two caches.
CACHE = 400_000
#: Characters of Latin, Greek and Cyrillic, general punctuation and currency signs without controls whose class in
#: Python's patterns could differ from the library's. Fixed values.
_PLAIN = re.compile("[\\x09-\\x0d\\x20-\\x7e¡-¬®-ͯЀ-ҁҊ-ԯ‐-‧‰-⁞€]*")
#: The split of the byte-level kind, as its rule states it: contractions, letters, numbers, other signs, spaces.
_DIGITS = "0-9²³¹¼-¾"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?(?:[^\W_{_DIGITS}])+| ?[{_DIGITS}]+| ?(?:[^\s\w{_DIGITS}̀-ͯ]|[_̀-ͯ])+|\s+(?!\S)|\s+")
_RUNS = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def byte_chars() -> dict[int, str]:
    """The kind's printable stand-in for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """text -> little-endian uint32 ids as bytes."""

    def __init__(self, path: str):
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.local = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec["model"].get("dropout")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.bytes = byte_chars()
        self.model = self.whole.model
        self.runs: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, s: str) -> bytes:
        got = self.pieces.get(s)
        if got is None:
            shown = s.encode().decode("latin-1").translate(self.bytes)
            got = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))
            if len(self.pieces) < CACHE:
                self.pieces[s] = got
        return got

    def run(self, s: str) -> bytes:
        got = b"".join(map(self.piece, _PIECES.findall(s)))
        if len(self.runs) < CACHE:
            self.runs[s] = got
        return got

    def __call__(self, text: str) -> bytes:
        if not self.local or not _PLAIN.fullmatch(text) or any(a in text for a in self.added):
            import numpy as np

            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        get, out = self.runs.get, []
        for s in _RUNS.findall(text):
            got = get(s)
            out.append(self.run(s) if got is None else got)
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's own, kept while the worker lives."""
    return Encoder(path)
