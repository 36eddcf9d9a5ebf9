"""Token ids of whole texts with a public word-level BPE vocabulary.

The vocabulary file's path is a parameter. The driver reads the file (a few MB,
fixed) and ships its content, so that executors need no such file.

This vocabulary's rules lower-case the text, drop white space and never merge
across it. So each distinct chunk between white space is encoded once by the
tokenizers library's model and then looked up. Texts with characters outside the
plain Latin blocks, or that hold a special token's string, go to the library
whole.
"""

from __future__ import annotations

import json
from pathlib import Path
from struct import pack

import numpy as np
import regex
from tokenizers import Tokenizer

from .common import keep_here

#: Fixed value: the vocabulary's own pre-token pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters beyond ASCII whose normal form, case and class agree between libraries.
_LATIN = regex.compile("[\u00a1-\u0129\u0131-\u024f]*+")
_ASCII = bytes([9, 10, 13, *range(32, 127)])


def read_vocabulary(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}


class WordTokenizer:
    """Encodes texts; ``end_id`` follows every text. It caches chunks, up to ``cache_size`` of them."""

    def __init__(self, vocabulary: str, end_id: int | None = 1, cache_size: int = 250_000) -> None:
        self.whole = Tokenizer.from_str(vocabulary)
        spec = json.loads(vocabulary)
        splits = [p for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_chunk = (
            [s["pattern"].get("Regex") for s in splits] == [PRE_TOKEN] and kinds == ["NFC", "Replace", "Lowercase"]
        )
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.size = max(self.whole.get_vocab().values()) + 1
        self.model = self.whole.model.tokenize
        self.pattern = regex.compile(PRE_TOKEN)
        self.letters = byte_letters()
        self.end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a new chunk: of its pre-tokens, most of which are chunks seen before."""
        if chunk.isalpha():
            shown = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model(shown)]
            return pack(f"<{len(ids)}I", *ids)
        if not chunk[:-1].isalpha() or "'" in chunk:
            parts = self.pattern.findall(chunk)
        else:
            parts = [chunk[:-1], chunk[-1]]
        if parts == [chunk]:
            shown = chunk.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model(shown)]
            return pack(f"<{len(ids)}I", *ids)
        return b"".join([self.cache.get(part) or self._keep(part) for part in parts])

    def _keep(self, chunk: str) -> bytes:
        ids = self.cache[chunk] = self._chunk(chunk)
        return ids

    def _plain(self, text: str) -> bool:
        odd = text.encode().translate(None, _ASCII)
        return (not odd or bool(_LATIN.fullmatch(odd.decode()))) and not any(s in text for s in self.special)

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; a null text is empty."""
        text = text or ""
        if not self.by_chunk or not self._plain(text):
            ids = self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids
            return np.array(ids, dtype="<u4").tobytes() + self.end
        chunks, cache = text.lower().split(), self.cache
        try:
            return b"".join(map(cache.__getitem__, chunks)) + self.end
        except KeyError:
            pass
        if len(cache) > self.cache_size:
            cache.clear()
        for chunk in chunks:
            if chunk not in cache:
                self._keep(chunk)
        return b"".join(map(cache.__getitem__, chunks)) + self.end


def tokenizer(vocabulary: str, end_id: int | None = 1) -> WordTokenizer:
    """The tokenizer of this process, kept with its cache from task to task."""
    return keep_here(("tokens", hash(vocabulary), end_id), lambda: WordTokenizer(vocabulary, end_id))
