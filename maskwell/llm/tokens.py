"""Exact tokenisation with the tokenizers library, word by word.

A text of familiar characters (ASCII without odd controls, Latin-1 without fractions and raised digits, Latin
letters below U+0180 but U+0130, common punctuation) is cut into the words that the tokenizer's own splitter would cut, and
each distinct word is encoded once and remembered; byte-pair merges never cross words, so ids
are those of the whole text. Texts with other characters, or with a special token's string, go
through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .common import give_back

#: Words remembered in a Python worker: two generations of so many; the older one goes when the younger is full.
MAX_WORDS = 200_000
_FAMILIAR = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ſ–—‘’“”…€]*")
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
#: The splitters of the two supported kinds, for familiar characters; the most frequent choice comes first.
_SPLIT = {
    "bytes": re.compile(rf" ?[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+"),
    "words": re.compile(rf"[{_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\s0-9{_LETTERS}]+"),
}
_WORDS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The byte-level alphabet: printable Latin-1 bytes as themselves, the others in order from U+0100.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
_SPACE = chr(_BYTES[0x20])
_LOADED: dict[str, Words] = {}


def _kind(config: dict) -> str | None:
    """Which splitter a tokenizer file has; None: another one, so texts go through the library whole."""
    pre, norm = config["pre_tokenizer"] or {}, config["normalizer"]
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "bytes"
    parts = pre.get("pretokenizers", [])
    steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
    if steps == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _WORDS_PATTERN} and not parts[1]["use_regex"]:
        return "words"
    return None


class Words(dict):
    """Word to its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge, self.older = self.tokenizer.model.tokenize, {}
        kind = _kind(json.loads(self.tokenizer.to_str()))
        self.lower, self.split = kind == "words", _SPLIT[kind].findall if kind else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: none), without special tokens."""
        out, get = [], self.__getitem__
        for text in texts:
            text = text or ""
            if self.split is None or _FAMILIAR.fullmatch(text) is None or any(s in text for s in self.special):
                out.append(self.whole(text))
            else:
                out.append(b"".join(map(get, self.split(text.lower() if self.lower else text))))
            if len(self) > MAX_WORDS:
                self.older = dict(self)
                self.clear()
        return out

    def __missing__(self, word: str) -> bytes:
        # a word as the model's own splitter would give it: its bytes as the byte-level alphabet writes them
        out = self.older.get(word)
        if out is None:
            raw = word.replace(" ", _SPACE) if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(_BYTES)
            out = array("I", [t.id for t in self.merge(raw)]).tobytes()
        self[word] = out
        return out


def load(path: str) -> Words:
    """The tokenizer of a file, once in each Python process."""
    if path not in _LOADED:
        _LOADED[path] = Words(path)
    return _LOADED[path]


def forget() -> None:
    """Drop what this process remembers; for functions of other operators, whose worker may have packed before."""
    if _LOADED:
        _LOADED.clear()
        give_back()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
