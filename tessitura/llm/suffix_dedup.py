"""Exact removal of repeated byte strings.

Windows of ``length`` bytes meet by the smallest k-gram hash that they hold (a minimizer), so equal windows land in one
bucket however the texts around them differ. Only windows whose minimizer stands in two places or more travel. In a
bucket, equal runs of windows are found by their bytes; the rest form a text whose Burrows-Wheeler transform is extended
backwards, breadth first, from all intervals at once: common prefixes come out in increasing length, and the extension
stops at ``length``. Neighbours in the suffix order that no boundary has cut by then share ``length`` bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cached_property, lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import text_ids, whole_text
from tessitura.llm.words import ODD, PIECE, mix, slide

LENGTH, GRAM = 100, 32
#: Bytes handled at once; a longer text goes in pieces that overlap by length - 1.
GROUP = 1 << 20
#: Expected bytes of a bucket, and bytes of one transform; runs that share a minimizer always go together.
BUCKET, TRANSFORM = 1 << 24, 1 << 22
#: A minimizer in more places than this is hot: its runs would fill a bucket, so its windows are matched one by one by their digests, with map-side combining.
HOT = 20_000
LAST = 2**63 - 1
MASK = 0x2127599BF4325C37


#: A prime below 2**31 and a base of powers modulo it.
PRIME, BASE = 2**31 - 1, 1_337_986_121


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo PRIME."""
    out = []
    for base in (BASE, pow(BASE, -1, PRIME)):
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), PRIME)) % np.uint64(PRIME)])
        out.append(p)
    return out[0], out[1]


class Sums:
    """Hashes of the strings inside ``data``, from running sums. They only propose what may be equal; bytes decide."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(1 << max(21, len(data).bit_length()))
        self.total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)] % np.uint64(PRIME), dtype=np.uint64))

    def of(self, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.total[at + size] - self.total[at]) % np.uint64(PRIME) * self.down[at] % np.uint64(PRIME)


def _contents(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of strings that stand end to end in ``data``, a megabyte or so at a time."""
    ends = np.cumsum(size)
    out, a = np.zeros(len(size), np.uint64), 0
    while a < len(size):
        first = int(ends[a] - size[a])
        b = max(a + 1, int(np.searchsorted(ends, first + GROUP, "right")))
        out[a:b] = Sums(data[first : int(ends[b - 1])]).of(ends[a:b] - size[a:b] - first, size[a:b])
        a = b
    return out


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a : a + size] and data[b : b + size] are the same bytes; about GROUP bytes at a time."""
    out, todo = np.ones(len(a), bool), np.flatnonzero(a != b)
    cuts = np.searchsorted(np.cumsum(size[todo]), np.arange(GROUP, int(size[todo].sum()) + 1, GROUP))
    for i in np.split(todo, cuts):
        if len(i):
            begin = np.cumsum(size[i]) - size[i]
            inner = np.arange(int(size[i].sum())) - np.repeat(begin, size[i])
            out[i] = np.logical_and.reduceat(data[np.repeat(a[i], size[i]) + inner] == data[np.repeat(b[i], size[i]) + inner], begin)
    return out


def _first_of(data: np.ndarray, at: np.ndarray, size: np.ndarray, content: np.ndarray, key: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """False for each run whose very bytes also stand at the first place among the runs of its minimizer, size and hash.

    ``place``: o, x and start, by which the runs are ordered; without, they are in order."""
    with np.errstate(over="ignore"):
        alike = mix(key + content * np.uint64(ODD) + size.astype(np.uint64))
    order = np.lexsort((*place[::-1], alike)) if place else np.argsort(alike, kind="stable")
    edge = np.append(True, alike[order][1:] != alike[order][:-1])
    lead = order[np.maximum.accumulate(np.where(edge, np.arange(len(order)), 0))]
    out = np.ones(len(order), bool)
    i, j = order[~edge], lead[~edge]
    same = size[i] == size[j]
    i, j = i[same], j[same]
    out[i] = ~_equal(data, at[i], at[j], size[i])
    return out


def _grams(data: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k bytes, k a multiple of eight."""
    eight, n = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)), len(data) - k + 1
    out = np.empty(n, np.uint64)
    for s in range(0, n, PIECE):
        part = mix(eight[s : s + PIECE + k - 8].astype(np.uint64))
        m = min(PIECE, n - s)
        total = part[:m] * np.uint64(ODD)
        for j in range(8, k, 8):
            total += part[j : j + m] * np.uint64(ODD * (2 * j + 1) % 2**64)
        out[s : s + m] = mix(total)
    return out


class Runs:
    """Runs of neighbouring windows with one minimizer in a group of pieces: piece, first window (within the piece), windows,
    minimizer (of k-grams, k a multiple of 8), whether it stands twice in the run, content hash; ``data`` and ``begin``: the bytes and where pieces begin."""

    def __init__(self, pieces: list[bytes], length: int, k: int):
        w = length - k + 1
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begin = np.cumsum(sizes) - sizes
        n = len(self.data)
        with np.errstate(over="ignore"):
            grams = _grams(self.data, k)
            least = slide(grams, w, np.minimum)
            piece = np.repeat(np.arange(len(pieces)), sizes)
            inside = np.zeros(len(least), bool)
            inside[:] = piece[: len(least)] == piece[length - 1 : length - 1 + len(least)]
            # A k-gram is a minimizer if it is the least of any window that holds it.
            held = np.where(inside, least, 0)
            most = slide(np.concatenate([np.zeros(w - 1, np.uint64), held, np.zeros(w - 1, np.uint64)]), w, np.maximum)
            anchor = np.flatnonzero(grams == most[: len(grams)])
            edge = np.append(True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1]) | (piece[1 : len(least)] != piece[: len(least) - 1]))
            first = np.flatnonzero(edge)
            count = np.diff(np.append(first, len(least)))
            keep = inside[first]
            first, count = first[keep], count[keep]
            self.piece, self.at, self.count, self.key = piece[first], first, count, least[first]
            self.size = count + length - 1
            # How many of the minimizers among a run's k-grams are its own.
            low, high = np.searchsorted(anchor, first), np.searchsorted(anchor, first + count + w - 1)
            n = high - low
            run = np.repeat(np.arange(len(first)), n)
            own = grams[anchor[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] == self.key[run]
            self.twice = np.bincount(run, own, len(first)) > 1


    @cached_property
    def content(self) -> np.ndarray:
        return Sums(self.data).of(self.at, self.size)


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    for s in range(0, max(1, len(text) - length + 1), GROUP):
        yield s, text[s : s + GROUP + length - 1]


def _grouped(rows: Iterator[tuple], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes], list[tuple]]]:
    """(piece -> (row number, offset), pieces, rows) of about GROUP bytes; row[0] is the text in bytes."""
    of, pieces, held, size = [], [], [], 0
    for row in rows:
        held.append(row)
        for s, piece in _pieces(row[0], length):
            if len(piece) >= length:
                of.append((len(held) - 1, s))
                pieces.append(piece)
                size += len(piece)
            if size >= GROUP:
                yield of, pieces, held
                of, pieces, held, size = [], [], [row], 0
    if pieces:
        yield of, pieces, held


def _rows(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """(text in bytes, o, x, ...) of batches sorted by text, repeated rows once."""
    last = None
    for batch in batches:
        for o, tx, ty, x, text, *rest in zip(batch["o"], batch["tx"], batch["ty"], batch["x"], batch["text"], *(batch[c] for c in columns)):
            if (o, tx, ty) != last:
                last = (o, tx, ty)
                yield (text.encode(), o, x, *rest)


def suffix_groups(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(sa, cut): places of ``text`` (codes from 0, 0 between strings) ordered by their first ``length`` codes or more, and whether each shares
    fewer than ``length`` codes with the one before it."""
    n = len(text)
    padded = np.concatenate([text.astype(np.uint8), np.zeros(8, np.uint8)])
    key = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    sa = np.argsort(key).astype(np.int32)
    sorted_key = key[sa]
    differs = np.append(True, sorted_key[1:] != sorted_key[:-1])
    # Common prefixes below 8 are read off the keys; deeper order comes by doubling, among ties only.
    shared = np.zeros(n, np.int64)
    if n > 1:
        x = sorted_key[1:] ^ sorted_key[:-1]
        shared[1:] = 8
        for b in range(7, -1, -1):
            shared[1:][x >> np.uint64(8 * (7 - b)) > 0] = np.minimum(shared[1:], b)[x >> np.uint64(8 * (7 - b)) > 0]
    rank = np.empty(n, np.int32)
    rank[sa] = np.maximum.accumulate(np.where(differs, np.arange(n), 0)).astype(np.int32)
    depth = 8
    while depth < length:
        tied = ~differs
        tied[:-1] |= ~differs[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = sa[at]
        ahead = own.astype(np.int64) + depth
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        both = (rank[own].astype(np.int64) << 32) | second
        order = np.argsort(both)
        sa[at], both = own[order], both[order]
        new = np.append(True, both[1:] != both[:-1])
        differs[at] = new
        rank[sa[at]] = np.maximum.accumulate(np.where(new, at, 0)).astype(np.int32)
        depth *= 2
    return sa, _boundaries(text, sa, shared, length)


def _boundaries(text: np.ndarray, sa: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """True where a place shares fewer than ``length`` codes with the one before it in ``sa``, by backward extension.

    An interval of depth d has all suffixes that begin with one string of d codes. Its extensions by the codes of the transform inside it are intervals of
    depth d + 1; one whose right end was no boundary yet makes it one, of value d, and is extended in turn."""
    n = len(text)
    cut = np.zeros(n + 1, bool)
    cut[:-1] = shared < 8
    cut[0] = cut[n] = True
    transform = text[sa - 1]
    order = np.argsort(transform, kind="stable").astype(np.int64)
    forward = np.empty(n, np.int64)
    forward[order] = np.arange(n)
    same = transform[order[1:]] == transform[order[:-1]]
    before, after = np.full(n, -1, np.int64), np.full(n, n, np.int64)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    starts = np.flatnonzero(cut[:-1])
    ends = np.append(starts[1:], n) - 1
    # Depth 8: the intervals whose right end is a boundary of value 7.
    fresh = np.append(shared, 7)[ends + 1] == 7
    low, high = starts[fresh], ends[fresh]
    for _ in range(8, length):
        if not len(low):
            break
        size = high - low + 1
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        first, last = before[at] < np.repeat(low, size), after[at] > np.repeat(high, size)
        low, high = np.sort(forward[at[first]]), np.sort(forward[at[last]])
        new = ~cut[high + 1]
        low, high = low[new], high[new]
        cut[high + 1] = True
    return cut[:-1]


def repeated_windows(data: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, place) of every window of ``length`` bytes that also starts earlier: in an earlier string or earlier in the same."""
    n = len(data) + len(sizes)
    ends = np.cumsum(sizes + 1) - 1
    text = np.zeros(n, np.uint8)
    keep = np.ones(n, bool)
    keep[ends] = False
    text[keep] = data + np.uint8(1)
    sa, cut = suffix_groups(text, length)
    string = np.repeat(np.arange(len(sizes)), sizes + 1)
    full = ends[string] - np.arange(n) >= length
    group = np.cumsum(cut) - 1
    on = full[sa]
    sa, group = sa[on], group[on]
    if not len(sa):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    earliest = np.full(int(group[-1]) + 1, n, np.int64)
    np.minimum.at(earliest, group, sa)
    again = np.sort(sa[sa != earliest[group]])
    return string[again], again - (ends - sizes)[string[again]]


_HEAD = struct.Struct("<qq")


def _pack(order: np.ndarray, runs: Runs, o: np.ndarray, x: np.ndarray, start: np.ndarray) -> bytes:
    """One zstd blob of runs: arrays of their fields, then their bytes."""
    size = runs.size[order]
    bytes_at = np.repeat(runs.at[order] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    fields = [o[order], x[order], start[order], runs.count[order], runs.key[order].view(np.int64), runs.twice[order].astype(np.int64)]
    raw = _HEAD.pack(len(order), int(size.sum())) + np.stack(fields).astype("<i8").tobytes() + runs.data[bytes_at].tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, _ = _HEAD.unpack_from(raw)
    return np.frombuffer(raw, "<i8", 6 * n, _HEAD.size).reshape(6, n), np.frombuffer(raw, np.uint8, offset=_HEAD.size + 48 * n)


def _anchors(length: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for of, pieces, rows in _grouped(_rows(batches, []), length):
            runs = Runs(pieces, length, k)
            doc = np.array([i for i, _ in of])[runs.piece]
            o, x = (np.array([r[c] for r in rows], np.int64)[doc] for c in (1, 2))
            # Once for each text; 2 where the minimizer stands in two places or more of it.
            order = np.lexsort((runs.key, doc))
            key, d, twice = runs.key[order], doc[order], runs.twice[order]
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (d[1:] != d[:-1])))
            n = np.diff(np.append(first, len(key)))
            yield pd.DataFrame({"h": key[first].view(np.int64), "o": o[order][first], "x": x[order][first], "n": np.where((n > 1) | np.maximum.reduceat(twice, first), 2, 1)})

    return run


def _select(rows: list[tuple], of: list[tuple[int, int]], runs: Runs, column: int) -> np.ndarray:
    """Runs whose minimizer is in the list of their text."""
    doc = np.array([i for i, _ in of])[runs.piece]
    out = np.zeros(len(doc), bool)
    bounds = np.searchsorted(doc, np.arange(len(rows) + 1))
    for i, row in enumerate(rows):
        keys = row[column]
        if keys is not None and len(keys) and bounds[i] < bounds[i + 1]:
            out[bounds[i] : bounds[i + 1]] = np.isin(runs.key[bounds[i] : bounds[i + 1]].view(np.int64), keys)
    return np.flatnonzero(out)


def _fields(rows: list[tuple], of: list[tuple[int, int]], runs: Runs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    doc, offset = np.array([i for i, _ in of])[runs.piece], np.array([s for _, s in of])[runs.piece]
    return np.array([r[1] for r in rows], np.int64)[doc], np.array([r[2] for r in rows], np.int64)[doc], runs.at - runs.begin[runs.piece] + offset


def _spread(length: int, k: int, buckets: int):
    """Runs of doubtful windows, packed by bucket; runs that repeat an earlier one of their group are marked at once (bucket null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for of, pieces, rows in _grouped(_rows(batches, ["cold"]), length):
            runs = Runs(pieces, length, k)
            chosen = _select(rows, of, runs, 3)
            if not len(chosen):
                continue
            o, x, start = _fields(rows, of, runs)
            first = _first_of(runs.data, runs.at[chosen], runs.size[chosen], runs.content[chosen], runs.key[chosen])
            again, chosen = chosen[~first], chosen[first]
            bucket = (runs.key[chosen] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            groups = [g for g in np.split(order, cuts) if len(g)]
            blobs = [_pack(chosen[g], runs, o, x, start) for g in groups]
            none = np.zeros(len(blobs), np.int64)
            yield pd.DataFrame({"bucket": bucket[[g[0] for g in groups]], "blob": blobs, "o": none, "x": none, "start": none, "count": none})
            if len(again):
                yield pd.DataFrame({"bucket": -1 - again % 64, "blob": None, "o": o[again], "x": x[again], "start": start[again], "count": runs.count[again]})

    return run


MARKS = "o long, x long, start long, count long"


def _judge(length: int, k: int):
    """The repeated windows of one bucket."""

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fields, data = [], []
        for batch in batches:
            known = batch["blob"].isna()
            if known.any():
                yield batch.loc[known, ["o", "x", "start", "count"]]
            for blob in batch["blob"].dropna():
                f, d = _unpack(blob)
                fields.append(f)
                data.append(d)
        if not fields:
            return
        f, d = np.concatenate(fields, 1), np.concatenate(data)
        o, x, start, count, h, twice = f
        size = count + length - 1
        content = _contents(d, size)
        at = np.cumsum(size) - size
        first = _first_of(d, at, size, content, h.view(np.uint64), o, x, start)
        out = [np.stack([o, x, start, count])[:, ~first]]
        # Alone with its minimizer, and without a repeat inside: nothing to compare.
        keep = np.flatnonzero(first)
        _, inverse, n = np.unique(h[keep], return_inverse=True, return_counts=True)
        keep = keep[(n[inverse] > 1) | (twice[keep] > 0) | (count[keep] > length - k + 1)]
        keep = keep[np.lexsort((start[keep], x[keep], o[keep], h[keep]))]
        while len(keep):
            # As many minimizers as fit one transform, one at least.
            upto = int(np.searchsorted(np.cumsum(size[keep]), TRANSFORM, "right"))
            upto = int(np.searchsorted(h[keep], h[keep[min(upto, len(keep) - 1)]], "left")) or int(np.searchsorted(h[keep], h[keep[0]], "right")) if upto < len(keep) else len(keep)
            part, keep = keep[:upto], keep[upto:]
            part = part[np.lexsort((start[part], x[part], o[part]))]
            s = size[part]
            bytes_at = np.repeat(at[part] - (np.cumsum(s) - s), s) + np.arange(int(s.sum()))
            string, place = repeated_windows(d[bytes_at], s, length)
            if len(string):
                i, begin = part[string], start[part[string]] + place
                edge = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (begin[1:] != begin[:-1] + 1)))
                out.append(np.stack([o[i[edge]], x[i[edge]], begin[edge], np.diff(np.append(edge, len(i)))]))
        marks = np.concatenate(out, 1)
        yield pd.DataFrame(dict(zip(("o", "x", "start", "count"), marks)))

    return run


def _hot_windows(length: int, k: int):
    """One row for each window of hot minimizers in the different runs of a group (w1, w2: its digest); and runs known to repeat (w1 null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for of, pieces, rows in _grouped(_rows(batches, ["hot"]), length):
            runs = Runs(pieces, length, k)
            chosen = _select(rows, of, runs, 3)
            if not len(chosen):
                continue
            o, x, start = _fields(rows, of, runs)
            first = _first_of(runs.data, runs.at[chosen], runs.size[chosen], runs.content[chosen], runs.key[chosen])
            again, chosen = chosen[~first], chosen[first]
            n = runs.count[chosen]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            i = np.repeat(chosen, n)
            data = runs.data.tobytes()
            digests = b"".join(blake2b(data[a : a + length], digest_size=16).digest() for a in (runs.at[i] + inner).tolist())
            w1, w2 = np.frombuffer(digests, "<i8").reshape(-1, 2).T
            yield pd.DataFrame({"w1": w1, "w2": w2, "o": o[i], "x": x[i], "start": start[i] + inner, "count": 1}).astype({"w1": "Int64", "w2": "Int64"})
            if len(again):
                none = pd.array([None] * len(again), "Int64")
                yield pd.DataFrame({"w1": none, "w2": none, "o": o[again], "x": x[again], "start": start[again], "count": runs.count[again]})

    return run


def _remove(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for batch in batches:
            out = []
            for o, tx, ty, i, text, marks in zip(batch["o"], batch["tx"], batch["ty"], batch["id"], batch["text"], batch["marks"]):
                if (o, tx, ty) == last:
                    continue
                last = (o, tx, ty)
                data = np.frombuffer(text.encode(), np.uint8)
                change = np.zeros(len(data) + 1, np.int32)
                if marks is not None and len(marks):
                    begin = np.array([m["start"] for m in marks])
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + np.array([m["count"] for m in marks]) - 1 + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                kept = data[~gone].tobytes()
                out.append((i, len(data), int(gone.sum()), int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0])), kept))
            if out:
                yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    A byte goes if it is covered by a string of ``length`` bytes that also starts earlier (smaller id, or same document and earlier place). Matches never
    cross documents and are judged on the input.

    Later copies of a whole text go by 128 bits of a cryptographic digest. Runs of windows that repeat are told by their bytes, what is left by the
    transform; only windows of minimizers in more than HOT places are told by a cryptographic digest of each. No other hash decides anything. Bucket
    sizes don't depend on how often a string repeats: repeated runs travel once for each megabyte read. A very long text goes in pieces of a megabyte.

    Defined cases: null counts as empty; texts shorter than ``length`` stay whole; a null id comes after all others; of repeated rows one is the first;
    different texts of one id (or of no id) are ordered by a hash and are dealt out by it; an empty table gives an empty table; other columns aren't read."""
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("o"), whole_text(text_col).alias("text"))
    base = base.select("id", "o", *(c.alias(n) for c, n in zip(text_ids(F.col("text")), ("tx", "ty"))), "text")
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total) * 4 // BUCKET))

    # Whole copies: every text but the first of its group goes, if it has the length.
    rows = base.select("id", "o", "tx", "ty", F.octet_length("text").cast("long").alias("n"), F.when(F.octet_length("text") < length, F.col("text")).alias("short")).groupBy("tx", "ty", "o", "id").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("short").alias("short"))
    first = rows.groupBy("tx", "ty").agg(F.min("o").alias("fo"))
    masked = lambda df: df.withColumns({"mx": F.col("tx").bitwiseXOR(F.lit(MASK)), "my": F.col("ty").bitwiseXOR(F.lit(MASK))})
    copies = masked(rows).join(masked(first).drop("tx", "ty"), ["mx", "my"]).withColumn("more", F.col("c") - F.when(F.col("o") == F.col("fo"), 1).otherwise(0)).filter("more > 0")
    gone = F.when(F.col("n") >= length, F.col("n")).otherwise(F.lit(0))
    copied = copies.select("id", "n", gone.alias("g"), "short", F.explode(F.sequence(F.lit(1), F.col("more"))).alias("i")).select("id", F.col("n").alias("n_bytes"), F.col("g").cast("long").alias("n_removed"), F.when(F.col("g") > 0, 1).otherwise(0).cast("long").alias("n_spans"), F.coalesce(F.col("short").cast("binary"), F.lit(b"")).alias("kept"))

    # x tells the texts of one id apart: 0 where there is but one (so it travels in no room), else a hash of the text.
    several = first.groupBy("fo").agg(F.count("*").alias("texts")).filter("texts > 1").select(F.col("fo").bitwiseXOR(F.lit(MASK)).alias("mo"))
    named = first.withColumn("mo", F.col("fo").bitwiseXOR(F.lit(MASK))).join(several.withColumn("many", F.lit(True)), "mo", "left").select(F.col("fo").alias("ro"), F.col("tx").alias("rx"), F.col("ty").alias("ry"), F.when(F.col("many"), F.col("tx")).otherwise(F.lit(0).cast("long")).alias("x"))
    # The first texts, dealt out by id and text once; all further steps that read texts share that exchange.
    this = (F.col("o") == F.col("ro")) & (F.col("tx") == F.col("rx")) & (F.col("ty") == F.col("ry"))
    texts = base.join(named.hint("merge"), this).select("id", "o", "tx", "ty", "x", "text")

    def with_text(listed: DataFrame, how: str = "inner") -> DataFrame:
        """Texts with what is listed for (lo, lx)."""
        keyed = named.withColumn("mo", F.col("ro").bitwiseXOR(F.lit(MASK))).join(listed.withColumn("mo", F.col("lo").bitwiseXOR(F.lit(MASK))).withColumnRenamed("lx", "x"), ["mo", "x"]).drop("mo", "x", "lo")
        return texts.join(keyed.hint("merge"), this, how).drop("ro", "rx", "ry")

    anchors = texts.mapInPandas(_anchors(length, GRAM), "h long, o long, x long, n int")
    shared = anchors.groupBy("h").agg(F.sum("n").alias("c")).filter("c > 1").select(F.col("h").bitwiseXOR(F.lit(MASK)).alias("k"), (F.col("c") > HOT).alias("hot"))
    doubtful = anchors.select("o", "x", F.col("h").bitwiseXOR(F.lit(MASK)).alias("k")).join(shared, "k").withColumn("h", F.col("k").bitwiseXOR(F.lit(MASK))).groupBy(F.col("o").alias("lo"), F.col("x").alias("lx")).agg(F.collect_set(F.when(~F.col("hot"), F.col("h"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"))
    listed = with_text(doubtful)
    spread = listed.mapInPandas(_spread(length, GRAM, buckets), f"bucket long, blob binary, {MARKS}")
    judged = spread.groupBy("bucket").applyInPandas(_judge(length, GRAM), MARKS)
    windows = listed.filter(F.size("hot") > 0).mapInPandas(_hot_windows(length, GRAM), f"w1 long, w2 long, {MARKS}")
    place = F.struct("o", "x", "start")
    earliest = windows.filter("w1 is not null").groupBy("w1", "w2").agg(F.min(place).alias("e")).select(F.col("w1").bitwiseXOR(F.lit(MASK)).alias("k1"), F.col("w2").bitwiseXOR(F.lit(MASK)).alias("k2"), "e")
    repeated = windows.withColumns({"k1": F.col("w1").bitwiseXOR(F.lit(MASK)), "k2": F.col("w2").bitwiseXOR(F.lit(MASK))}).join(earliest, ["k1", "k2"], "left").filter(F.col("w1").isNull() | (place != F.col("e"))).select("o", "x", "start", "count")
    marks = judged.unionByName(repeated).groupBy(F.col("o").alias("lo"), F.col("x").alias("lx")).agg(F.collect_list(F.struct("start", "count")).alias("marks"))
    # Ids travel as text: beside nulls, pandas would make floats of them.
    kept = with_text(marks, "left").withColumn("id", F.col("id").cast("string")).mapInPandas(_remove(length), "id string, n_bytes long, n_removed long, n_spans long, kept binary").withColumn("id", F.col("id").cast("long"))
    return kept.unionByName(copied).withColumnRenamed("id", id_col)
