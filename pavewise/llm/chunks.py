"""Cutting text where a byte-level BPE always has a word boundary, so that chunks can be encoded and cached alone.

The pre-tokenizer's words may begin with one space, and only runs of white space contain a space elsewhere. A cut before
a space is therefore safe unless white space stands before it and white space, or the end, after it. A text with such a
space goes through the whole pattern instead.
"""

from __future__ import annotations

import re

UNSAFE = re.compile(r"(?<=\s) (?=\s|\Z)")
#: White space other than space and line feed; without it two substring searches decide.
OTHER = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0  -     　]")


def safe(text: str) -> bool:
    """True if every space in the text may be cut at."""
    return ("  " not in text and "\n " not in text and not OTHER.search(text)) or not UNSAFE.search(text)


class Cache:
    """piece -> packed ids, in two generations: bounded memory, and what recurs stays.

    The limit counts entries, so long pieces (over 64 characters) are encoded without being kept.
    """

    def __init__(self, encode, limit: int):
        self.encode, self.limit = encode, limit
        self.old: dict[str, bytes] = {}
        self.new = _Young(self)

    def turn(self) -> None:
        """Between texts: when the young generation is full it becomes the old one."""
        if len(self.new) >= self.limit:
            self.old = self.new
            self.old.owner = None
            self.new = _Young(self)


class _Young(dict):
    def __init__(self, owner: Cache):
        super().__init__()
        self.owner = owner

    def __missing__(self, key: str) -> bytes:
        owner = self.owner
        v = owner.old.get(key)
        if v is None:
            v = owner.encode(key)
        if len(key) <= 64:
            self[key] = v
        return v
