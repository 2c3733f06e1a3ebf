"""Byte-level BPE ids of whole texts, equal to the tokenizers library's.

``encoder(path)`` gives one encoder per worker process.  Texts in Latin
script are split into the pre-tokens of the byte-level pattern, and each
pre-token's ids are remembered, so a word that recurs is merged once per
worker.  Texts with characters on whose class two regex engines could
differ (beyond U+024F, or separators that only one of them counts as blank)
go to the tokenizers library whole.  A tokenizer file that is not a plain
byte-level BPE also sends every text there.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import tiktoken
from tokenizers import Tokenizer

LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBERS = "0-9²³¹¼½¾"
PRETOKENS = re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[{LETTERS}]+| ?[{NUMBERS}]+"
                       rf"| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+")
# Anything outside these is left to the tokenizers library.
UNUSUAL = re.compile("[\x1c-\x1f]|[^\x00-ɏ‐-‧]")
CACHE_WORDS = 200_000   # pre-tokens remembered per worker
CACHE_CHARS = 64        # longer ones are merged anew each time


def byte_letters() -> dict[str, int]:
    """Letter of the byte-level alphabet -> byte: printable Latin-1 bytes stand
    for themselves, the others follow from U+0100 in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Words(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, word: str) -> bytes:
        ids = array("I", self.merge(word.encode())).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = {t["content"]: array("I", [t["id"]]).tobytes()
                        for t in spec.get("added_tokens", [])}
        self.at_special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        pre = spec.get("pre_tokenizer") or {}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*model["vocab"].values(),
                                                       *(t["id"] for t in spec["added_tokens"])]))
        for token, k in model["vocab"].items():
            if token not in self.special:
                self.bytes_of[k] = bytes(letters[c] for c in token)
        for t in spec.get("added_tokens", []):
            self.bytes_of[t["id"]] = t["content"].encode()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"]["".join(p)] for p in pairs]
        self.fast = (model["type"] == "BPE" and spec.get("normalizer") is None
                     and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                     and pre.get("use_regex", True) and ids == sorted(ids)
                     and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word")
                                 for t in spec.get("added_tokens", [])))
        self.special_ids = {t["id"] for t in spec.get("added_tokens", [])}

    # what only encoding needs is made when it is first used
    @functools.cached_property
    def library(self) -> Tokenizer:
        out = Tokenizer.from_file(self.path)
        out.no_truncation()
        out.no_padding()
        return out

    @functools.cached_property
    def words(self) -> _Words:
        # ranks are ids, as merges stand in the order of their ids
        ranks = {b: k for k, b in enumerate(self.bytes_of) if b and k not in self.special_ids}
        core = tiktoken.Encoding("byte_level", pat_str=r"\S+|\s+", mergeable_ranks=ranks,
                                 special_tokens={})
        return _Words(core._core_bpe.encode_single_piece)

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, as little-endian unsigned 32-bit integers."""
        if not self.fast or UNUSUAL.search(text):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if self.at_special is not None and self.at_special.search(text):
            return b"".join(self.special[p] if p in self.special else self._plain(p)
                            for p in self.at_special.split(text) if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, PRETOKENS.findall(text)))

    def text(self, ids: bytes) -> str:
        """Inverse of ``ids``; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
