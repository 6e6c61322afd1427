"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

#: Characters that are handled at once; longer texts are cut where a blank follows another character.
GROUP = 1 << 20
ODD = 0x9E3779B97F4A7C15
BLANKS = [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
EDGE = regex.compile("[^%s][%s]" % ((regex.escape("".join(map(chr, BLANKS))),) * 2))


#: Numbers that are worked on at once where a step reads them many times.
PIECE = 1 << 15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    if x.ndim == 1 and len(x) > PIECE:
        out = np.empty(len(x), np.uint64)
        for s in range(0, len(x), PIECE):
            out[s : s + PIECE] = mix(x[s : s + PIECE])
        return out
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sum_hashes(cps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of strings that stand end to end in ``cps`` (code points or bytes), each ``sizes`` long.

    Every place of a string has random numbers of its own for the characters (mix is a bijection, and each pair of character and place gives it another
    number), so no pattern of letters makes two strings meet, as it would with powers of one base."""
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(cps)) - np.repeat(begin, sizes)
    with np.errstate(over="ignore"):
        x = mix((place.astype(np.uint64) << np.uint64(21)) + cps.astype(np.uint64) + np.uint64(ODD))
        total = np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64))
        return mix(total[begin + sizes] - total[begin] + sizes.astype(np.uint64))


def slide(v: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op (least or most) over v[i : i + w] for each i that has w values, in doubling widths; a piece that fits a cache at a time."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    out = np.empty(n, v.dtype)
    for s in range(0, n, PIECE):
        part, width = v[s : min(s + PIECE, n) + w - 1], 1
        while 2 * width <= w:
            part, width = op(part[:-width], part[width:]), 2 * width
        m = min(PIECE, n - s)
        op(part[:m], part[w - width : w - width + m], out=out[s : s + m])
    return out


@lru_cache(1)
def _blank() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[BLANKS] = True
    return out


def parts(text: str, group: int = GROUP) -> list[str]:
    """A text in parts of about ``group`` characters that no word crosses."""
    out, at = [], 0
    while len(text) - at > group and (m := EDGE.search(text, at + group)):
        out.append(text[at : m.start() + 1])
        at = m.start() + 1
    return [*out, text[at:]]


def hash_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): 64-bit hashes of the words between blanks of all texts, in order, and how many each text has."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    queue: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        for part in parts(text):
            queue.append((i, part))
            size += len(part) + 1
            if size >= GROUP:
                hashes.append(_hash_group(queue, counts))
                queue, size = [], 0
    if queue:
        hashes.append(_hash_group(queue, counts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def _hash_group(queue: list[tuple[int, str]], counts: np.ndarray) -> np.ndarray:
    cps = np.frombuffer("".join(p + "\n" for _, p in queue).encode("utf-32-le"), "<u4")
    blank = _blank()[cps]
    before = np.append(True, blank[:-1])
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(blank & ~before)
    bounds = np.cumsum([len(p) + 1 for _, p in queue])
    words = np.diff(np.searchsorted(starts, bounds), prepend=0)
    np.add.at(counts, [i for i, _ in queue], words)
    return sum_hashes(cps[~blank], ends - starts)


def shingles(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text numbers) of all runs of n words inside one text; a text with fewer words (but one) gives one run of them all."""
    ends = np.cumsum(counts)
    starts = ends - counts
    with np.errstate(over="ignore"):
        padded = np.append(hashes, np.zeros(n, np.uint64))
        of = np.repeat(np.arange(len(counts)), counts)
        left = np.repeat(ends, counts) - np.arange(len(hashes))
        h = np.zeros(len(hashes), np.uint64)
        for j in range(n):
            h = mix(h + np.where(left > j, padded[j : j + len(hashes)], 0).astype(np.uint64) + np.uint64(ODD * (j + 1) % 2**64))
    keep = (left >= n) | (np.arange(len(hashes)) == starts[of]) & (counts[of] < n)
    return h[keep], of[keep]


#: Bits of a hash that stand beside a text's number in one sortable key; a group has at most 2**20 texts.
KEY_BITS = 44


def keyed(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Text numbers and the upper KEY_BITS bits of hashes in one number each, sorted."""
    return np.sort((of.astype(np.uint64) << np.uint64(KEY_BITS)) | (hashes >> np.uint64(64 - KEY_BITS)))
