"""Benchmark decontamination by the q-gram lemma.

Two strings within e edits of each other share (m - q + 1) - q * e q-grams whose diagonals (place in the text less place
in the item) differ by at most e. Shared q-grams are counted in overlapping diagonal bands; bands that meet the bound
are verified by banded alignment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessitura.llm.common import checkpointed, fresh
from tessitura.llm.words import ODD

Q, BUDGET = 8, 0.1
#: Characters of benchmark texts that are indexed, broadcast and searched for at once; a larger benchmark goes in as many blocks as it needs.
BLOCK = 1 << 22
GROUP = 1 << 20
TABLE_BITS = 22


def normal(text: str) -> str:
    """Lower case, each run of blanks one space, none at the ends."""
    return " ".join(text.lower().split())


def _folded(cps: np.ndarray) -> np.ndarray:
    """One byte for each code point; equal code points have equal bytes, so no shared q-gram is lost."""
    return (cps ^ (cps >> 8) ^ (cps >> 16)).astype(np.uint8)


def _grams(data: np.ndarray) -> np.ndarray:
    """All runs of eight bytes as numbers."""
    data = np.ascontiguousarray(data)
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, strides=(1,)) if len(data) >= Q else np.zeros(0, np.uint64)


def _slot(v: np.ndarray) -> np.ndarray:
    return ((v * np.uint64(ODD)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Index:
    """The q-grams of a block of items, sorted; texts, edit budgets and least counts of the items. Bounded by the block."""

    ids: list
    texts: list[str]
    edits: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    begin: np.ndarray
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], budget: float = BUDGET) -> Index:
        kept = [(i, t) for i, t in ((i, normal(t or "")) for i, t in rows) if i is not None and len(t) >= Q]
        size = np.array([len(t) for _, t in kept], np.int64)
        # The budget shrinks for short items until the lemma asks for at least one shared q-gram.
        edits = np.minimum((size * budget).astype(np.int64), (size - Q) // Q)
        grams = [_grams(_folded(np.frombuffer(t.encode("utf-32-le"), "<u4"))) for _, t in kept]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(kept)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        unique, begin = np.unique(flat, return_index=True)
        return cls([i for i, _ in kept], [t for _, t in kept], edits, size - Q + 1 - Q * edits, unique, np.append(begin, len(flat)), item[order], place[order])

    def table(self) -> np.ndarray:
        """A bit map that most q-grams of other texts miss."""
        if not hasattr(self, "_table"):
            with np.errstate(over="ignore"):
                self._table = np.zeros(1 << TABLE_BITS, bool)
                self._table[_slot(self.grams)] = True
        return self._table

    def search(self, texts: list[str]) -> list[list[tuple]]:
        """For each normalised text (item_id, start, end, distance) of the places where an item stands within its edit budget. Places of one item don't
        overlap: the nearest are taken first, of those equally near the ones that end first."""
        out: list[list[tuple]] = [[] for _ in texts]
        if not len(self.grams) or not texts:
            return out
        # A character that no text has keeps q-grams from crossing texts.
        cps = np.frombuffer("\x00".join(texts).encode("utf-32-le"), "<u4")
        data = _folded(cps)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        with np.errstate(over="ignore"):
            v = _grams(data)
            near = np.flatnonzero(self.table()[_slot(v)])
        v = v[near]
        at = np.minimum(np.searchsorted(self.grams, v), len(self.grams) - 1)
        exact = self.grams[at] == v
        near, at = near[exact], at[exact]
        count = self.begin[at + 1] - self.begin[at]
        entry = np.repeat(self.begin[at] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        item, diagonal = self.item[entry], np.repeat(near, count) - self.place[entry]
        width = self.edits[item] + 1
        band = diagonal // width
        # Bands are two widths wide and start every width, so any e + 1 neighbouring diagonals lie in one.
        span = np.int64(len(cps) + 2**20)
        keys, votes = np.unique(np.concatenate([item * span * 2 + band + span, item * span * 2 + band - 1 + span]), return_counts=True)
        item, band = keys // (span * 2), keys % (span * 2) - span
        keep = votes >= self.least[item]
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for k, low, high in self._regions(item[keep].tolist(), band[keep].tolist()):
            m, e = len(self.texts[k]), int(self.edits[k])
            for d in range(max(0, int(np.searchsorted(begin, low - e, "right")) - 1), len(texts)):
                if begin[d] > high + m + e:
                    break
                start, stop = max(low - e, begin[d]), min(high + m + e, begin[d + 1] - 1)
                if stop - start >= m - e:
                    at = int(start - begin[d])
                    found.setdefault((d, k), []).extend((at + a, at + b, c) for a, b, c in self._places(k, texts[d][at : int(stop - begin[d])]))
        for (d, k), hits in found.items():
            out[d] += [(self.ids[k], *hit) for hit in _apart(hits)]
        return out

    def _regions(self, items: list[int], bands: list[int]) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal); neighbouring bands of one item are one region."""
        out: list[tuple[int, int, int]] = []
        for k, b in zip(items, bands):
            w = int(self.edits[k]) + 1
            low, high = b * w, (b + 2) * w - 1
            if out and out[-1][0] == k and low <= out[-1][2] + 1:
                low = out.pop()[1]
            out.append((k, low, high))
        return out

    def _places(self, k: int, region: str) -> list[tuple[int, int, int]]:
        """(start, end, distance) of the places of item k inside a region: the exact ones, from the left, and those by alignment in what is between."""
        item, out, at = self.texts[k], [], 0
        while (exact := region.find(item, at)) >= 0:
            out += self._aligned(k, region, at, exact)
            out.append((exact, exact + len(item), 0))
            at = exact + len(item)
        return out + self._aligned(k, region, at, len(region))

    def _aligned(self, k: int, region: str, at: int, to: int) -> list[tuple[int, int, int]]:
        """The places of item k inside region[at:to] within its budget, by banded alignment."""
        item, e = self.texts[k], int(self.edits[k])
        if to - at < len(item) - e or not e:
            return []
        p, t = (np.frombuffer(x.encode("utf-32-le"), "<u4") for x in (item, region[at:to]))
        m, n = len(p), len(t)
        # A row holds the diagonals -e to n - m + e; cell x stands for the place i + x - e of the region after i characters of the item.
        width = n - m + 2 * e + 1
        far, cells = np.int64(m + n + 1), np.arange(width)
        padded = np.concatenate([np.full(e, 2**32 - 1, np.uint32), t, np.full(2 * e + 1, 2**32 - 1, np.uint32)])
        cost, start = np.where(cells < e, far, 0), cells - e
        for i in range(m):
            place = i + cells - e
            cross = np.where((place >= 0) & (place < n), cost + (padded[i : i + width] != p[i]), far)
            lacks, begun = np.append(cost[1:], far) + 1, np.append(start[1:], 0)
            level = np.minimum(cross, lacks) - cells
            begun = np.where(cross <= lacks, start, begun)
            # A character that only the region has: what stands to the left and one edit a cell.
            best = np.minimum.accumulate(level)
            came = np.maximum.accumulate(np.where(level == best, cells, 0))
            cost, start = best + cells, begun[came]
            if cost.min() > e:
                return []
        ends = m + cells - e
        on = np.flatnonzero((ends >= 0) & (ends <= n) & (cost <= e) & (start < ends))
        return _apart([(at + int(start[x]), at + int(ends[x]), int(cost[x])) for x in on])


def _apart(hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of (start, end, distance) that overlap none that is nearer or, as near, ends before; in order."""
    kept: list[tuple[int, int, int]] = []
    for a, b, c in sorted(set(hits), key=lambda h: (h[2], h[1], -h[0])):
        i = bisect_left(kept, (a, b, c))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or kept[i][0] >= b):
            kept.insert(i, (a, b, c))
    return kept


def find_leaks(docs: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block: int = BLOCK, text_col: str = "text") -> DataFrame:
    """Every input row and column, and a last column ``__hits`` (with more underscores where the input has that): array<struct<item_id,start,end,distance>>,
    ordered, places in the normalised text.

    An item leaks where its normalised text stands in a document's within floor(budget * length) edits (fewer for items under some 40 characters). Every
    place counts that overlaps no nearer one of the same item.

    The different rows of the benchmark are dealt out by a hash into shares of ``block`` characters at most on average, half as many expected; a share
    alone is collected, indexed and broadcast at a time, and with several shares the hits so far are written out between them. So memory doesn't grow with
    the benchmark. Every document is searched whole.

    Defined cases: null texts have no hits; null items, items without id and items of fewer than 8 characters are never found; repeated items count once;
    item ids may be of any type; very long texts are searched whole, in one piece; repeated rows stay; empty tables give no hits or no rows."""
    (name,) = fresh(docs, "__hits")
    items = benchmark.select("item_id", "text").filter("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // max(1, block // 2)))
    kind = benchmark.schema["item_id"].dataType
    out = docs.withColumn(name, F.lit(None).cast(f"array<struct<item_id:{kind.simpleString()},start:bigint,end:bigint,distance:bigint>>"))
    hits = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), *((c, pa.int64()) for c in ("start", "end", "distance"))]))
    for b in range(blocks):
        rows = [(r["item_id"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        out = _search_block(out, Index.of(rows, budget), text_col, name, hits)
        if b < blocks - 1:
            out = checkpointed(out)
    return out.withColumn(name, F.array_sort(F.coalesce(name, F.array().cast(out.schema[name].dataType))))


def _search_block(docs: DataFrame, index: Index, text_col: str, name: str, kind: pa.DataType) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            at = batch.schema.get_field_index(name)
            texts, before = batch.column(batch.schema.get_field_index(text_col)).to_pylist(), batch.column(at).to_pylist()
            hits: list[list] = []
            group, size = [], 0
            for text in texts:
                group.append(normal(text or ""))
                size += len(group[-1]) + 1
                if size >= GROUP:
                    hits += index.search(group)
                    group, size = [], 0
            hits += index.search(group)
            rows = [(old or []) + [dict(zip(("item_id", "start", "end", "distance"), h)) for h in new] for old, new in zip(before, hits)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, kind) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` in which no item of the benchmark leaks. Defined cases as for ``find_leaks``."""
    found = find_leaks(docs, benchmark, **how)
    return found.filter(F.size(found.columns[-1]) == 0).select(docs.columns)
