"""A quality classifier: histogram gradient-boosted trees over statistics of whole texts, scored by vectorised numpy traversal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import fresh
from tessitura.llm.words import KEY_BITS, hash_words, keyed, shingles

#: Labelled rows that the classifier is fitted on at most, chosen by a hash of their ids; so what reaches the driver is bounded.
SAMPLE = 20_000
THRESHOLD, FOLDS = 0.3, 5
BINS, DEPTH, TREES, RATE, RIDGE, LEAST = 64, 4, 60, 0.15, 1.0, 5.0
MARKS = "!#$%&*|.,?:;\"'()[]{}<>=+-_/\\@~^`"
NAMES = (
    "log_chars", "log_words", "word_length", "upper", "digits", "blanks", "lines_per_word", "non_ascii", "shout_marks", "symbol_marks", "bars", "stops", "other_marks",
    "distinct_words", "top_word", "same_as_last", "repeated_runs", "char_entropy",
)
#: Characters, and texts, that are handled at once.
GROUP, MOST = 1 << 20, 4096


def _share(flags: np.ndarray, starts: np.ndarray, over: np.ndarray) -> np.ndarray:
    return np.add.reduceat(flags.astype(np.int64), starts) / np.maximum(over, 1)


def _features(texts: list[str]) -> np.ndarray:
    n = len(texts)
    cps = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, texts), np.int64, n)
    starts = np.cumsum(size + 1) - size - 1
    low = np.minimum(cps, 255).astype(np.uint8)
    hashes, words = hash_words(texts)
    of = np.repeat(np.arange(n), words)
    upper = (low >= 65) & (low <= 90) | (cps >= 0xC0) & (cps <= 0xDE)
    lower = (low >= 97) & (low <= 122) | (cps >= 0xDF) & (cps <= 0x24F)
    letters = np.add.reduceat((upper | lower).astype(np.int64), starts)
    is_in = lambda s: np.isin(low, [ord(c) for c in s])
    blank = (low == 32) | (low >= 9) & (low <= 13)
    keys = keyed(hashes, of)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    owner = (keys[at] >> np.uint64(KEY_BITS)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, np.diff(np.append(at, len(keys))))
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])) if len(hashes) else np.zeros(0, bool)
    runs, run_of = shingles(hashes, words, 5)
    keys = keyed(runs, run_of)
    again = (keys[1:][keys[1:] == keys[:-1]] >> np.uint64(KEY_BITS)).astype(np.int64)
    n_runs = np.bincount(run_of, minlength=n)
    # Entropy of single bytes, by text.
    table = np.bincount(np.repeat(np.arange(n), size + 1) * 256 + low, minlength=n * 256).reshape(n, 256) / (size + 1)[:, None]
    entropy = -(table * np.log2(np.maximum(table, 1e-12))).sum(1)
    w = np.maximum(words, 1)
    return np.stack([
        np.log1p(size), np.log1p(words), letters / w, _share(upper, starts, letters), _share((low >= 48) & (low <= 57), starts, size), _share(blank, starts, size),
        _share(low == 10, starts, words), _share(cps > 127, starts, size), _share(is_in("!"), starts, words), _share(is_in("#$%&*"), starts, words), _share(is_in("|"), starts, words), _share(is_in("."), starts, words),
        _share(is_in(MARKS.translate({ord(c): None for c in "!#$%&*|."})), starts, words), np.bincount(owner, minlength=n) / w, top / w, np.bincount(of, same, minlength=n) / w,
        np.bincount(again, minlength=n) / np.maximum(n_runs, 1), entropy,
    ], 1)


def features(texts: list[str]) -> np.ndarray:
    """One row of statistics for each whole text, in groups of bounded size; the columns are NAMES."""
    out, group, size = [], [], 0
    for t in texts:
        group.append(t)
        size += len(t) + 1
        if size >= GROUP or len(group) >= MOST:
            out.append(_features(group))
            group, size = [], 0
    if group:
        out.append(_features(group))
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


@dataclass
class Trees:
    """Complete binary trees flattened into arrays: for each tree its nodes' columns and thresholds, level by level, and its leaves."""

    base: float
    column: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, depth: int = DEPTH, trees: int = TREES) -> Trees:
        """Logistic loss, second-order gains from histograms of at most BINS quantile bins. Without both labels: no trees."""
        inner, leaves = 2**depth - 1, 2**depth
        if len(y) == 0 or y.min() == y.max():
            return cls(0.0 if len(y) == 0 else float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
        base = float(np.log(y.mean() / (1 - y.mean())))
        margin = np.full(len(y), base)
        columns, thresholds, values = [], [], []
        offsets = np.arange(x.shape[1]) * BINS
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            column, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(depth):
                width, first = 2**level, 2**level - 1
                cell = ((node - first)[:, None] * (x.shape[1] * BINS) + offsets + binned).ravel()
                shape = (width, x.shape[1], BINS)
                hg = np.bincount(cell, np.repeat(g, x.shape[1]), width * x.shape[1] * BINS).reshape(shape).cumsum(2)
                hh = np.bincount(cell, np.repeat(h, x.shape[1]), width * x.shape[1] * BINS).reshape(shape).cumsum(2)
                n = np.bincount(cell, minlength=width * x.shape[1] * BINS).reshape(shape).cumsum(2)
                tg, th, tn = hg[:, :, -1:], hh[:, :, -1:], n[:, :, -1:]
                gain = hg**2 / (hh + RIDGE) + (tg - hg) ** 2 / (th - hh + RIDGE) - tg**2 / (th + RIDGE)
                gain[(n < LEAST) | (tn - n < LEAST)] = 0
                best = gain.reshape(width, -1).argmax(1)
                for k, b in enumerate(best):
                    j, cut = divmod(int(b), BINS)
                    if gain[k, j, cut] > 1e-6 and cut < len(edges[j]):
                        column[first + k], threshold[first + k] = j, edges[j][cut]
                node = 2 * node + 1 + (x[np.arange(len(y)), column[node]] > threshold[node])
            at = node - inner
            leaf = -RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + RIDGE)
            margin += leaf[at]
            columns.append(column)
            thresholds.append(threshold)
            values.append(leaf)
        return cls(base, np.stack(columns), np.stack(thresholds), np.stack(values))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row; all rows walk down all trees at once."""
        if not len(self.column):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        n, inner = self.column.shape
        tree, node = np.arange(n), np.zeros((len(x), n), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.column[tree, node]] > self.threshold[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, node - inner].sum(1))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Fits on labelled rows whose crc32(id as text) mod 5 is not 0: all of them, or the ``sample`` with the smallest hashes of their ids.

    Ties of that hash go by id and label. Labels without id or quality don't count; a label that is repeated, or whose id several texts have, counts as
    often as it stands; a label without a text doesn't count."""
    fold = F.crc32(F.col(id_col).cast("string")) % FOLDS
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull() & (fold != 0)).select(F.col(id_col).alias("__id"), F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("__id"), "__id", "y").limit(sample)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["__id"], "y": batch["y"], "x": list(features(batch["text"].tolist()))})

    # The sample has a fixed bound, so it is broadcast.
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "__id")
    rows = sorted((r["id"], r["y"], tuple(r["x"])) for r in texts.mapInPandas(count, "id long, y int, x array<double>").collect())
    return Trees.fit(np.array([r[2] for r in rows]).reshape(-1, len(NAMES)), np.array([float(r[1] > 0) for r in rows]))


def add_scores(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """Every input row and column, and a last column ``__score`` (with more underscores where the input has that): 0 to 1, higher where label 1 is likelier.

    Defined cases: null counts as empty; empty texts have a score like any other; very long texts are read whole; without labels every score is 0.5; rows
    don't depend on each other, so repeated ones have equal scores; an empty table gives an empty table."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    (name,) = fresh(docs, "__score")
    schema = docs.select("*", F.lit(0.0).alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            score = pa.array(shared.value.score(features(texts)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more from a classifier that is trained on them. Defined cases as for ``add_scores``."""
    scored = add_scores(docs, train(docs, labels))
    return scored.filter(F.col(scored.columns[-1]) >= threshold).select(docs.columns)
