"""Small text helpers that run inside Python tasks."""

from __future__ import annotations

import re
import unicodedata
from zlib import crc32

import numpy as np
import xxhash

DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[^\W_]+")
#: Punctuation and signs that may close a line without changing what it says.
CLOSING = ".,:;!?…-–—_*|/\\•·»«>\"'”“’‘)([]}{~+=#"
#: Marks without width that pages leave inside words.
INVISIBLE = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))


def line_key(line: str) -> str:
    """What is left of a line without letter case, spacing, digits and closing punctuation."""
    return bare_key("".join(line.lower().split()))


def bare_key(joined: str) -> str:
    """The key of a line that is in lower case and without spacing already."""
    return without_digits(joined).rstrip(CLOSING)


def line_keys(text: str) -> list[str]:
    """:func:`line_key` of each line of a text."""
    return ["".join(line.split()).rstrip(CLOSING) for line in without_digits(text.lower()).split("\n")]


#: Bytes of UTF-8 that no decimal digits but 0 to 9 begin with: those up to U+063F, and from U+2000 to U+2FFF.
_KNOWN_DIGITS = bytes(range(0xD9)) + b"\xe2"


def without_digits(text: str) -> str:
    """A text without decimal digits, told by the byte where only 0 to 9 can occur."""
    raw = text.encode("utf-8", "surrogatepass")
    if raw.translate(None, _KNOWN_DIGITS):
        return DIGITS.sub("", text)
    bare = raw.translate(None, b"0123456789")
    return text if len(bare) == len(raw) else bare.decode()


def hash64(text: str) -> int:
    """Signed 64-bit hash of a string, the same on every worker."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


#: Accents that stand apart after decomposition, and marks without width.
LOOSE = re.compile("[\u0300-\u036f" + "".join(map(chr, INVISIBLE)) + "]+")


def _folded(text: str) -> str:
    return LOOSE.sub("", unicodedata.normalize("NFKD", text.lower()))


def _latin_table() -> tuple[bytes, bytes, frozenset]:
    """For single-byte texts: the folded letter or a blank for each sign, the signs that vanish, and those that fold into several."""
    table, gone, odd = bytearray(b" " * 256), bytearray(), set()
    for i in range(256):
        found = _folded(chr(i))
        if not found:
            gone.append(i)
        elif len(found) == 1 and WORDS.match(found) and ord(found) < 256:
            table[i] = ord(found)
        elif WORDS.search(found):
            odd.add(chr(i))
    return bytes(table), bytes(gone), frozenset(odd)


_LATIN, _GONE, _ODD = _latin_table()
#: Signs beyond single bytes that only part words.
_PARTING = "“”‘’–—…•"


def words(text: str) -> list[str]:
    """Words without letter case, accents, punctuation and spacing."""
    plain = text
    if not plain.isascii():
        for sign in _PARTING:
            if sign in plain:
                plain = plain.replace(sign, " ")
        for sign in _ODD:
            if sign in plain:
                return WORDS.findall(_folded(text))
    try:
        return plain.encode("latin-1").translate(_LATIN, _GONE).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(_folded(text))


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where in a text each of its :func:`words` stands, by characters of the text itself."""
    plain, origin = [], []
    for i, c in enumerate(text):
        low = c.lower()
        for d in low if low.isascii() else LOOSE.sub("", unicodedata.normalize("NFKD", low)):
            plain.append(d), origin.append(i)
    return [(origin[m.start()], origin[m.end() - 1] + 1) for m in WORDS.finditer("".join(plain))]


class _Hashes(dict):
    """32-bit hashes of words, remembered for those met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = h = crc32(word.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()
word_hash = _HASHES.__getitem__
_BASE = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` neighbouring word hashes."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * _BASE + hashes[j : len(hashes) - n + 1 + j]
    return out ^ (out >> np.uint64(29))
