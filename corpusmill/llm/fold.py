"""Skip-and-fold hashing of texts that differ only in form.

A table over all code points gives each character a 64-bit value: 0 for those
that are skipped (white space, punctuation, symbols, invisible characters) and
one random value for all characters that fold to the same one.  A text's hash is
the polynomial sum of these values modulo 2**64 for two bases; no canonical
string is ever built.  Whole Arrow batches are hashed with numpy.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_DIGIT_GAP = np.uint64(0xA5A5F00DDEADBEEF)
_TOP = 0x110000


def _invisible(ch: str) -> bool:
    """Format characters, variation selectors and their kin: never part of a word."""
    return unicodedata.category(ch) in ("Cf", "Cc") and not ch.isspace() or "︀" <= ch <= "️"


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(fold, flags) by code point: the folded code point or 0; 1 = digit, 2 = visible skip."""
    fold = np.zeros(_TOP, np.uint32)
    flags = np.zeros(_TOP, np.uint8)
    fold[0x20000:0x40000] = np.arange(0x20000, 0x40000)  # ideographs; above them only invisible tags and private use
    for cp in range(0x20000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)[0]
        if kind in "LN" or kind == "M" and not _invisible(ch):
            low = ch.casefold()
            if len(low) != 1:
                low = ch.lower() if len(ch.lower()) == 1 else ch
            fold[cp] = ord(low)
            flags[cp] = unicodedata.category(ch) == "Nd"
        elif not _invisible(ch):
            flags[cp] = 2
    return fold, flags


@lru_cache(maxsize=1)
def values() -> np.ndarray:
    """The 64-bit value of each code point after folding (splitmix64 of the folded code)."""
    fold, _ = tables()
    x = fold.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x1234567)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    x |= np.uint64(1)
    x[fold == 0] = 0
    return x


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown as longer texts come."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        _powers[base] = have
    return have


def codes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings in a row, and where each starts (nulls are empty)."""
    strings = strings.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    if not len(strings) or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint32), np.zeros(len(strings) + 1, np.int64)
    raw = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, starts[offsets - offsets[0]]


def hash_strings(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes and the number of kept characters of each string."""
    points, starts = codes(strings)
    n = len(starts) - 1
    if not len(points):
        return np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    _, flags = tables()
    value = values()[points]
    kept = np.flatnonzero(value)
    flag = flags[points]
    value = value[kept]
    owner_start = np.searchsorted(kept, starts)  # index in kept at which each string starts
    size = np.diff(owner_start)
    # "1 25" and "125" are different numbers: mark a digit that follows another one over a visible gap.
    digit = flag[kept] == 1
    seen = np.cumsum(flag == 2)[kept]
    gap = np.zeros(len(kept), bool)
    gap[1:] = digit[1:] & digit[:-1] & (seen[1:] != seen[:-1])
    first = owner_start[:-1][size > 0]
    gap[first] = False
    value[gap] ^= _DIGIT_GAP
    place = np.arange(len(kept)) - np.repeat(owner_start[:-1], size)
    out = []
    with np.errstate(over="ignore"):
        for base in BASES:
            part = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * powers(base, int(size.max()) + 1)[place], dtype=np.uint64)])
            out.append(part[owner_start[1:]] - part[owner_start[:-1]])
    return out[0], out[1], size


def same_words(a: str | None, b: str | None) -> bool:
    """Two pointers that step over skipped characters; true if all others fold alike."""
    fold, flags = tables()
    a, b = a or "", b or ""
    i = j = 0
    was_digit = False
    while True:
        gap_a = gap_b = False
        while i < len(a) and not fold[ord(a[i])]:
            gap_a |= flags[ord(a[i])] == 2
            i += 1
        while j < len(b) and not fold[ord(b[j])]:
            gap_b |= flags[ord(b[j])] == 2
            j += 1
        if i == len(a) or j == len(b):
            return i == len(a) and j == len(b)
        x, y = ord(a[i]), ord(b[j])
        if fold[x] != fold[y]:
            return False
        digit = flags[x] == 1
        if digit and was_digit and gap_a != gap_b:
            return False
        was_digit = digit
        i, j = i + 1, j + 1


def canonical(text: str | None) -> str:
    """The string that ``hash_strings`` hashes; only for tests and for colliding rows."""
    fold, flags = tables()
    out, gap = [], False
    for ch in text or "":
        cp = ord(ch)
        if fold[cp]:
            if gap and out and out[-1].isdigit() and flags[cp] == 1:
                out.append(" ")
            out.append(chr(int(fold[cp])))
            gap = False
        else:
            gap |= flags[cp] == 2
    return "".join(out)
