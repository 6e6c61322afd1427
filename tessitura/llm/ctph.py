"""Context-triggered piecewise hashes: a rolling hash cuts the text into chunks, each chunk gives one character.

A fingerprint is "level:signature:signature"; the cut rule of level L fires on one byte in 2**L, the first signature uses
the smallest level that leaves at most 64 chunks, the second the level above. Fingerprints are compared where their
levels meet, by the edit distance of the signatures.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm.common import whole_text

WINDOW, MOST, SHARED = 7, 64, 7
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
BLOCK = 1 << 20
LOWEST = -(2**63)
#: Rows of one id from which on they are dealt out to several ranges.
CROWD = 1000


def _rolling(data: np.ndarray) -> np.ndarray:
    """Mixed hash of the last WINDOW bytes at each place (fewer at the start)."""
    b = data.astype(np.uint32)
    h = b.copy()
    for j in range(1, min(WINDOW, len(b))):
        h[j:] += b[:-j] * np.uint32(pow(0x01000193, j, 1 << 32))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(12)
    h *= np.uint32(0x297A2D39)
    h ^= h >> np.uint32(15)
    return h


def _cuts(data: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Places where the rule of ``level`` fires, the hashes there, the running sums up to there, and the whole sum; block by block."""
    mask, at, hashes, sums, total = np.uint32((1 << level) - 1), [], [], [], 0
    for s in range(0, len(data), BLOCK):
        first = max(0, s - WINDOW + 1)
        h = _rolling(data[first : s + BLOCK])[s - first :]
        running = np.cumsum(h, dtype=np.uint64)
        i = np.flatnonzero((h & mask) == mask)
        at.append(i + s)
        hashes.append(h[i])
        sums.append(running[i] + np.uint64(total))
        total = (total + int(running[-1])) % 2**64
    return np.concatenate(at), np.concatenate(hashes), np.concatenate(sums), total


def _signature(at: np.ndarray, sums: np.ndarray, total: int, n: int) -> str:
    ends = sums if len(at) and at[-1] == n - 1 else np.append(sums, np.uint64(total))
    chunk = np.diff(ends, prepend=np.uint64(0))
    chunk ^= chunk >> np.uint64(29)
    chunk *= np.uint64(0xBF58476D1CE4E5B9)
    return LETTERS[(chunk >> np.uint64(58)).astype(np.intp)].tobytes().decode()


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text (UTF-8); the empty text gives "0::"."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = len(data)
    if not n:
        return "0::"
    with np.errstate(over="ignore"):
        low = max(0, (n // MOST).bit_length() - 3)
        while True:
            at, h, sums, total = _cuts(data, low)
            if len(at) >= MOST or low == 0:
                break
            low = max(0, low - 4)
        level = low
        while len(at) >= MOST:
            level += 1
            mask = np.uint32((1 << level) - 1)
            keep = (h & mask) == mask
            at, h, sums = at[keep], h[keep], sums[keep]
        mask = np.uint32((1 << (level + 1)) - 1)
        keep = (h & mask) == mask
        return f"{level}:{_signature(at, sums, total, n)}:{_signature(at[keep], sums[keep], total, n)}"


@lru_cache(1)
def _codes() -> np.ndarray:
    codes = np.full(256, 0, np.uint8)
    codes[LETTERS] = np.arange(64)
    return codes


def _pad(sigs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, sigs), np.int64, len(sigs))
    out = np.zeros((len(sigs), MOST), np.uint8)
    out[np.arange(MOST) < size[:, None]] = _codes()[np.frombuffer("".join(sigs).encode(), np.uint8)]
    return out, size


def _alike(a: list[str], b: list[str]) -> np.ndarray:
    """2 * LCS / (sum of lengths), that is 1 - edit distance (insertions and deletions) / (sum of lengths); 0 unless the two share
    SHARED characters in a row (for short signatures half the shorter one)."""
    (x, nx), (y, ny) = _pad(a), _pad(b)
    rows = np.arange(len(a))
    masks = np.zeros((len(a), 64), np.uint64)
    for i in range(MOST):
        on = i < nx
        masks[rows[on], x[on, i]] |= np.uint64(1 << i)
    v = np.full(len(a), 2**64 - 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(MOST):
            u = v & masks[rows, y[:, i]]
            v = np.where(i < ny, (v + u) | (v - u), v)
    valid = np.where(nx >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(nx, 63).astype(np.uint64)) - np.uint64(1))
    lcs = np.bitwise_count(~v & valid)
    # Longest run in common: bit j of run[k] is set where the last k characters agree; by diagonals of the equality matrix.
    need = np.minimum(SHARED, np.maximum(1, (np.minimum(nx, ny) + 1) // 2))
    longest, run = np.zeros(len(a), np.int64), np.zeros((len(a), MOST + 1), np.int8)
    for i in range(MOST):
        equal = (x == y[:, i : i + 1]) & (np.arange(MOST) < nx[:, None]) & (i < ny)[:, None]
        new = np.zeros_like(run)
        new[:, 1:] = np.where(equal, run[:, :-1] + 1, 0)
        run = new
        np.maximum(longest, run.max(1), out=longest)
    total = nx + ny
    return np.where((longest >= need) & (total > 0), 2.0 * lcs / np.maximum(total, 1), 0.0)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints: 1 if equal, 0 if their levels are more than one apart, else the best of the signatures at a common level."""
    out = np.array([float(p == q) for p, q in zip(a, b)])
    jobs: list[tuple[int, str, str]] = []
    for i, (p, q) in enumerate(zip(a, b)):
        if p != q:
            (m, p1, p2), (n, q1, q2) = p.split(":"), q.split(":")
            d = int(m) - int(n)
            jobs += [(i, p1, q1), (i, p2, q2)] if d == 0 else [(i, p1, q2)] if d == 1 else [(i, p2, q1)] if d == -1 else []
    for s in range(0, len(jobs), 2000):
        part = jobs[s : s + 2000]
        np.maximum.at(out, [j[0] for j in part], _alike([j[1] for j in part], [j[2] for j in part]))
    return out


def add_fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the column ``fingerprint`` to any table with texts; a null text counts as empty."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(fingerprint)

    return docs.withColumn("fingerprint", of(F.col(text_col)))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt out by ranges of descending id, each range followed by a copy (``__ghost``) of the row after it (after the last
    range: the first row of all), sorted; every row's successor stands right below it in the same partition.

    The ranges are about as many as the shuffle partitions, so what reaches the driver doesn't grow with the data. A null id comes last;
    rows of one id are ordered by a hash of their texts, and an id (or the lack of one) that many rows share is cut into ranges of that hash."""
    spark: SparkSession = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The complement turns the order round without overflow: ids descend as it ascends.
    order = F.bitwise_not(F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)))
    base = docs.select(order.alias("__o"), F.xxhash64(whole_text(text_col)).alias("__h"), F.col(id_col).cast("long").cast("string").alias("__id"), whole_text(text_col).alias("__text"))
    found = base.agg(F.count("*").alias("n"), F.percentile_approx("__o", [i / n for i in range(1, n)] or [0.5], 10000).alias("b")).first()
    share = max(1, -(-found["n"] // n))
    # Ids that fill more than a range by themselves: n at most.
    crowded = {r["__o"]: -(-r["count"] // share) for r in base.groupBy("__o").count().filter(F.col("count") > max(share, CROWD)).collect()}
    cuts = {(b, LOWEST) for b in found["b"] or []} | {(o, LOWEST) for o in crowded} | {(o, LOWEST + 2**64 // k * j) for o, k in crowded.items() for j in range(1, k)} | {(o + 1, LOWEST) for o in crowded if o < -LOWEST - 1}
    key = F.struct(F.col("__o").alias("o"), F.col("__h").alias("h"))
    bucket = F.size(F.filter(F.array(*[F.struct(F.lit(o).cast("long").alias("o"), F.lit(h).cast("long").alias("h")) for o, h in sorted(cuts)]), lambda c: c <= key)) if cuts else F.lit(0)
    heads = sorted((r["k"], (r["m"]["o"], r["m"]["h"])) for r in base.groupBy(bucket.alias("k")).agg(F.min(key).alias("m")).collect())
    placed = base.withColumn("__k", bucket)
    if not heads:
        return placed.withColumn("__ghost", F.lit(False))
    # The head of each range also follows the range before it; the first head follows the last range.
    own = F.struct(F.col("__k").alias("k"), F.lit(False).alias("g"))
    head = F.create_map(*[x for i, (k, (o, h)) in enumerate(heads) for x in (F.lit(k), F.struct(F.lit(o).cast("long").alias("o"), F.lit(h).cast("long").alias("h"), F.lit(heads[i - 1][0]).alias("before")))])[F.col("__k")]
    is_head = (head["o"] == F.col("__o")) & (head["h"] == F.col("__h"))
    spread = placed.withColumn("__c", F.explode(F.when(is_head, F.array(own, F.struct(head["before"].alias("k"), F.lit(True).alias("g")))).otherwise(F.array(own))))
    rows = spread.select("__o", "__h", "__id", "__text", F.col("__c.k").alias("__k"), F.col("__c.g").alias("__ghost"))
    return rows.repartitionById(max(k for k, _ in heads) + 1, F.col("__k")).sortWithinPartitions("__k", "__ghost", "__o", "__h")


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they and the next document's are.

    Columns: id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next. A null text counts as empty; very long texts are read whole,
    in blocks; a lone row is its own successor; repeated rows stay; rows of one id, or without, follow one another in order of a hash; an empty table gives
    an empty table; other columns aren't read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for i, text, k, ghost in zip(batch["__id"], batch["__text"], batch["__k"], batch["__ghost"]):
                row = (i, text, k, ghost, fingerprint(text))
                if held is not None and not held[3] and held[2] == k:
                    changed = edited(held[1], text)
                    out.append((held[0], len(held[1]), changed, held[4], fingerprint(changed), row[4]))
                held = row
            if out:
                ids, n, texts, f, e, after = map(list, zip(*out))
                yield pd.DataFrame({id_col: ids, "n_chars": n, "edited_text": texts, "fingerprint": f, "edited_fingerprint": e, "near_edited": likeness(f, e), "near_next": likeness(f, after)})

    # Ids travel as text: beside nulls, pandas would make floats of them.
    done = with_next(docs, id_col, text_col).mapInPandas(run, f"{id_col} string, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.withColumn(id_col, F.col(id_col).cast("long"))
