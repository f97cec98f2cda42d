"""Splitting texts into the pre-tokens of a ``tokenizers`` file, with a fast path that the library's rules are read from.

The fast path takes texts whose characters are plain Latin (below U+0250 as they stand and in lower case, without control
characters) and that hold no added token; there, normalising is lower-casing and the file's split pattern runs on
Python's ``re`` with its classes spelled out. Every other text goes through the library's own normaliser and split.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Regex, Tokenizer, pre_tokenizers  # noqa: E402

_PLAIN_BELOW = 0x250


def _plain() -> str:
    """The characters of the fast path: visible ones below U+0250 whose lower case is one such character, blanks and line ends."""
    visible = {c for c in map(chr, [9, 10, 13, *range(0x20, _PLAIN_BELOW)]) if c in "\t\n\r " or unicodedata.category(c)[0] not in "CZ"}
    return "".join(c for c in sorted(visible) if c.lower() in visible)


def _class(kind: str) -> str:
    return "".join(chr(c) for c in range(0xA1, 0x250) if unicodedata.category(chr(c))[0] == kind)


def _spelled(pattern: str) -> str:
    """The pattern for Python's ``re``, right for plain lower-cased texts."""
    letters, digits = "a-zA-Z" + _class("L"), "0-9" + _class("N")
    return pattern.replace(r"\p{L}", letters).replace(r"\p{N}", digits).replace(r"\s", r" \t\n\r")


class Splitter:
    """``split(text)``: its pre-tokens as normalised strings; an added token in the text is (0, content) -> ``MARK + content``."""

    MARK = "\x00"

    def __init__(self, file: str):
        spec = json.loads(file)
        self._normalise = Tokenizer.from_str(file).normalizer.normalize_str
        self._words = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "truncation": None, "padding": None}))  # for normalised words
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t in spec["added_tokens"]:
            if t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]:
                raise ValueError("added tokens are matched as they stand; this file asks for more")
        parts = spec["normalizer"]["normalizers"]
        if [p["type"] for p in parts] != ["NFC", "Replace", "Lowercase"] or (parts[1]["pattern"], parts[1]["content"]) != ({"Regex": r"\s+"}, " "):
            raise ValueError("the file's normaliser isn't NFC, white space to one blank, lower case")
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], level["type"], level["add_prefix_space"], level["use_regex"]) != ("Split", "Removed", True, "ByteLevel", False, False):
            raise ValueError("the file's pre-tokeniser isn't a split by one pattern before bytes")
        pattern = split["pattern"]["Regex"]
        self._split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self._find = re.compile(_spelled(pattern)).findall
        self._odd = re.compile(f"[^{re.escape(_plain())}]").search
        names = sorted(map(re.escape, self.added), key=len, reverse=True)
        self._added = re.compile(f"({'|'.join(names)})") if names else None

    def split(self, text: str) -> list[str]:
        if self._added is not None and "<" in text and self._added.search(text):
            out: list[str] = []
            for k, part in enumerate(self._added.split(text)):  # odd parts are the added tokens
                if k % 2:
                    out.append(self.MARK + part)
                elif part:
                    out.extend(self._pieces(part))
            return out
        return self._pieces(text)

    def _pieces(self, text: str) -> list[str]:
        if text.isascii() and text.isprintable() or not self._odd(text):
            return self._find(text.lower())
        return [piece for piece, _ in self._split.pre_tokenize_str(self._normalise(text))]

    def encode(self, word: str) -> list[int]:
        """The ids of one pre-token."""
        if word[1:] in self.added and word[0] == self.MARK:
            return [self.added[word[1:]]]
        return self._words.encode(word, add_special_tokens=False).ids


def pieces(file: str) -> list[str]:
    """Each id's piece, by id."""
    library = Tokenizer.from_str(file)
    return [library.id_to_token(i) or "" for i in range(max(library.get_vocab(True).values()) + 1)]


def read_file(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
