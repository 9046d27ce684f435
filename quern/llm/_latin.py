"""Fast splitting of Latin text into the pre-tokens of public tokenizers.

For texts of the characters below, Python's ``re`` with explicit letter and number sets
splits exactly as the tokenizers' own engines do with ``\\p{L}``, ``\\p{N}`` and ``\\s`` (the
tests compare every character). The information separators U+001C to U+001F are left
out, since ``re`` takes them for spaces and the tokenizers do not.
"""

from __future__ import annotations

import re

#: Letters and numbers up to U+024F.
LETTERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"

_outside = re.compile("[^\\x00-\\x1b\\x20-\\u024f\\u2010-\\u2027\\u2030-\\u205e]").search


def is_latin(text: str) -> bool:
    """Whether the fast patterns are exact for the text."""
    return _separators(text) is None if text.isascii() else _outside(text) is None


_separators = re.compile("[\\x1c-\\x1f]").search

#: Pre-tokens of byte-level BPE: a space may lead a run.
byte_level = re.compile(
    rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^\s{LETTERS}{NUMBERS}]+| ?[{NUMBERS}]+|\s+(?!\S)|\s+"
).findall

#: Pre-tokens of BPE with word ends: white space dropped, numbers one by one.
word_level = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"
).findall


class Memory(dict):
    """A bounded dict of computed values; when full it starts anew from the given ones."""

    def __init__(self, known: dict, compute, size: int):
        super().__init__(known)
        self._known, self._compute, self._full = known, compute, len(known) + size

    def __missing__(self, key):
        if len(self) >= self._full:
            self.clear()
            self.update(self._known)
        value = self[key] = self._compute(key)
        return value


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    itself where printable, else the next unused one from 256 on."""
    shown = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    following = iter(range(256, 512))
    for b in range(256):
        if b not in shown:
            shown[b] = chr(next(following))
    return shown
