"""Byte lattices: what a text with lost characters may have been.

A text that was read as R although it was written in W has bytes behind each of its characters; a lost one (U+FFFD) stands for a byte
that R has no character for, or, where R is a multi-byte encoding, for a byte that does not fit there. The text is so a row
of slots, each a known byte or a set of bytes. Paths through it are the characters of W whose bytes fit the slots, found in a
trie of the characters that the corpus has; a beam search under the character model keeps the likeliest, so that a word
comes out as several candidates with their log likelihoods. A candidate that would be read differently from what is
there (written in W and read as R again) costs UNLIKE more.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Callable, Iterable

LOST = "�"
BEAM, CANDIDATES, UNLIKE = 14, 5, 6.0
# Encodings of several bytes a character; any byte from 80 may be lost in them.
MULTIPLE = ("utf-8", "gb18030", "big5", "shift_jis")
_HIGH, _CONTINUED = frozenset(range(0x80, 0x100)), frozenset(range(0x80, 0xC0))

Slot = tuple[int | frozenset[int], bool]


def to_bytes(text: str, encoding: str) -> bytes | None:
    """The bytes behind `text`; `sloppy` is cp1252 with C1 controls kept."""
    if encoding != "sloppy":
        try:
            return text.encode(encoding)
        except UnicodeEncodeError:
            return None
    try:
        return text.encode("cp1252")
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for ch in text:
        if "\x80" <= ch < "\xa0":
            out.append(ord(ch))
        else:
            try:
                out += ch.encode("cp1252")
            except UnicodeEncodeError:
                return None
    return bytes(out)


@functools.lru_cache(None)
def lost_in(read: str) -> frozenset[int]:
    """Bytes that may stand behind a lost character."""
    if read in MULTIPLE:
        return _HIGH
    found = bytes(range(256)).decode("cp1252" if read == "sloppy" else read, "replace")
    return frozenset(i for i, c in enumerate(found) if c == LOST)


def slots(text: str, read: str) -> list[Slot] | None:
    """(byte or set of bytes, whether it may be absent), or None if `text` cannot have been read as `read`."""
    gone = lost_in(read)
    if not gone:
        return None
    out: list[Slot] = []
    for k, part in enumerate(text.split(LOST)):
        if k:
            out.append((gone, False))
            if read == "utf-8":
                out.append((_CONTINUED, True))  # a cut sequence of two bytes is one lost character
        raw = to_bytes(part, read)
        if raw is None:
            return None
        out += [(b, False) for b in raw]
    return out


def trie(alphabet: Iterable[str], written: str) -> dict:
    """Characters by their bytes in `written`; a leaf holds its character under ''."""
    root: dict = {}
    for ch in alphabet:
        try:
            raw = ch.encode(written)
        except UnicodeEncodeError:
            continue
        node = root
        for b in raw:
            node = node.setdefault(b, {})
        node[""] = ch
    return root


def _moves(row: list[Slot], at: int, root: dict) -> list[tuple[int, str]]:
    """(place after it, character) of the characters that fit from `at` on."""
    out, stack = [], [(at, root)]
    while stack:
        place, node = stack.pop()
        if "" in node:
            out.append((place, node[""]))
            continue
        if place == len(row):
            continue
        fits, absent = row[place]
        if absent:
            stack.append((place + 1, node))
        if isinstance(fits, int):
            if fits in node:
                stack.append((place + 1, node[fits]))
        else:
            stack += [(place + 1, child) for b, child in node.items() if b in fits]
    return out


def decode(text: str, row: list[Slot], read: str, written: str, root: dict, likely: Callable[[str], float]) -> list[tuple[str, float]]:
    """The likeliest originals of `text`, whose slots are `row`, with their log likelihoods, best first; `likely` judges three characters."""
    end = len(row)
    reached: list[list[tuple[float, str]]] = [[] for _ in range(end + 1)]
    reached[0].append((0.0, "  "))
    for place in range(end):
        if not reached[place]:
            continue
        kept = heapq.nlargest(BEAM, reached[place])
        if all(absent for _, absent in row[place:]):
            reached[end] += kept
            continue
        moves = _moves(row, place, root)
        for score, made in kept:
            for after, ch in moves:
                reached[after].append((score + likely(made[-2:] + ch), made + ch))
        reached[place] = []
    found: dict[str, float] = {}
    for score, made in reached[end]:
        score += likely(made[-2:] + " ")
        found[made[2:]] = max(score, found.get(made[2:], -1e9))
    out = []
    for made, score in heapq.nlargest(2 * CANDIDATES, found.items(), key=lambda x: x[1]):
        if read in MULTIPLE and made.encode(written).decode(read, "replace") != text:
            score -= UNLIKE
        out.append((made, score))
    return sorted(out, key=lambda x: -x[1])[:CANDIDATES]
