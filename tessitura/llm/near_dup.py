"""Near duplicates: DartMinHash signatures of word shingles, banded joining, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import checkpointed, fresh, text_ids, whole_text
from tessitura.llm.words import KEY_BITS, ODD, hash_words, keyed, mix, shingles

WORDS, SIMILARITY, ROWS, BANDS = 5, 0.8, 5, 24
#: A key of its own for each join, so that both sides are dealt out for it and AQE can split what is skewed.
MASK = 0x2545F4914F6CDD1D
#: Rows of a bucket that are compared at once, and shingles in them; a larger bucket goes in pairs of blocks of about so many.
BLOCK, SHINGLES = 4096, 8_000_000


def dart_signatures(elements: np.ndarray, of: np.ndarray, n: int, k: int, weights: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
    """DartMinHash: an n x k array of 64-bit numbers; two sets agree at each place with the probability of their weighted Jaccard similarity.

    elements: hashes, distinct within a set; of: their set, ascending; weights: positive, 1 by default. Each unit of an element's weight is a region
    at which darts arrive in order of rank as a Poisson process drawn from hashes; a dart that falls above the element's weight misses. Of the darts
    at each coordinate the earliest stays. Only darts up to a rank at which k * (ln k + 2) are expected are thrown; a set with a coordinate left empty
    gets twice as many, until none is. Sets without elements give zeros."""
    out = np.zeros((n, k), np.uint64)
    if not len(elements):
        return out
    if weights is None:
        region, owner, share, mass = mix(elements + np.uint64(seed)), of, None, np.bincount(of, minlength=n).astype(float)
    else:
        layers = np.ceil(weights).astype(np.int64)
        owner = np.repeat(of, layers)
        layer = np.arange(layers.sum()) - np.repeat(np.cumsum(layers) - layers, layers)
        region = mix(np.repeat(elements, layers) + np.uint64(seed)) ^ mix(layer.astype(np.uint64))
        region[layer == 0] = mix(elements + np.uint64(seed))
        share = np.minimum(1.0, np.repeat(weights, layers) - layer)
        mass = np.bincount(of, weights, minlength=n)
    reach = k * (np.log(k) + 2) / np.maximum(mass, 1e-300)
    todo = mass > 0
    while todo.any():
        on = todo[owner]
        slots, ranks, darts = _throw(region[on], owner[on], reach, k, None if share is None else share[on])
        best = np.full(n * k, np.inf)
        np.minimum.at(best, slots, ranks)
        first = ranks == best[slots]
        flat = out.reshape(-1)
        flat[slots[first]] = darts[first]
        todo = todo & ~np.isfinite(best).reshape(n, k).all(1)
        reach = reach * 2
    return out


def _throw(region: np.ndarray, owner: np.ndarray, reach: np.ndarray, k: int, share: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set * k + coordinate, rank, number) of every dart of the regions up to their sets' reach."""
    rank, limit, slots, ranks, darts, m = np.zeros(len(region)), reach[owner], [], [], [], 0
    with np.errstate(over="ignore"):
        while len(region):
            g = mix(region + np.uint64(ODD * (m + 1) % 2**64))
            rank = rank - np.log1p(-(g >> np.uint64(11)).astype(float) * 2.0**-53)
            on = rank < limit
            region, owner, rank, limit, g = region[on], owner[on], rank[on], limit[on], g[on]
            number = mix(g + np.uint64(0x632BE59BD9B4E019))
            hit = slice(None)
            if share is not None:
                share = share[on]
                hit = (mix(number + np.uint64(7)) >> np.uint64(11)).astype(float) * 2.0**-53 < share
            coordinate = ((number >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
            slots.append((owner * k + coordinate.astype(np.int64))[hit])
            ranks.append(rank[hit])
            darts.append(number[hit])
            m += 1
    return np.concatenate(slots), np.concatenate(ranks), np.concatenate(darts)


def _counted(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (KEY_BITS bits each) of each lower-cased text, ordered by text and hash; their texts; and how often each stands."""
    h, of = shingles(*hash_words([t.lower() for t in texts]), words)
    keys, count = np.unique(keyed(h, of), return_counts=True)
    return keys & np.uint64(2**KEY_BITS - 1), (keys >> np.uint64(KEY_BITS)).astype(np.int64), count


def _sets(texts: list[str], words: int) -> list[bytes]:
    """For each text the sorted 32-bit hashes of (shingle, how many of it stand before): their Jaccard similarity is that of the counts."""
    h, of, count = _counted(texts, words)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    with np.errstate(over="ignore"):
        each = (mix(np.repeat(h, count) + nth.astype(np.uint64) * np.uint64(ODD)) >> np.uint64(32)).astype(np.uint32)
    return [np.unique(x).tobytes() for x in np.split(each, np.searchsorted(np.repeat(of, count), np.arange(1, len(texts))))]


def _groups(texts: list[str], most: int = 1 << 20, count: int = 1024) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters, ``count`` texts at most: each throws hundreds of darts, however short it is."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most or i + 1 - start >= count:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def sign(texts: list[str], words: int = WORDS, rows: int = ROWS, bands: int = BANDS) -> tuple[list[np.ndarray], list[bytes], list[int]]:
    """The band hashes of each text (none for a text without words), its sketch (16 bits of each place of the signature) and how many shingles it has."""
    keys: list[np.ndarray] = []
    sketches: list[bytes] = []
    sizes: list[int] = []
    for a, b in _groups(texts):
        h, of, count = _counted(texts[a:b], words)
        sig = dart_signatures(h, of, b - a, rows * bands, count.astype(float))
        sketches += [x.tobytes() for x in (sig >> np.uint64(48)).astype(">u2")]
        sig = sig.reshape(b - a, bands, rows)
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(ODD), (b - a, bands)).copy()
            for r in range(rows):
                key = mix(key + sig[:, :, r])
        size = np.bincount(of, count, minlength=b - a).astype(np.int64).tolist()
        keys += [row if n else row[:0] for row, n in zip(key.astype(np.int64), size)]
        sizes += size
    return keys, sketches, sizes


def _neighbours(places: int, least: float, reach: int = 3):
    """Pairs of rows of one bucket that stand next to each other, up to ``reach`` apart, and whose sketches agree at a share of ``least`` or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = None
        for batch in batches:
            rows = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            h, rep = rows["h"].to_numpy(), rows["node"].to_numpy()
            sketch = np.frombuffer(b"".join(rows["order"]), ">u2").reshape(-1, places)
            for d in range(1, reach + 1):
                i = np.flatnonzero((h[d:] == h[:-d]) & (rep[d:] != rep[:-d])) if len(h) > d else np.zeros(0, np.int64)
                i = i[(sketch[i] == sketch[i + d]).mean(1) >= least] if len(i) else i
                yield pd.DataFrame({"a": np.maximum(rep[i], rep[i + d]), "b": np.minimum(rep[i], rep[i + d])})
            tail = rows.iloc[-reach:]

    return run


#: Rows of a pair of blocks (p, q) of the bucket h; own: the block of the row.
PLACE = "h long, band int, p long, q long, own long, node long, class long"


def _block_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one pair of blocks at a time, of rows sorted by it; those of the last one wait for the next batch."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        keys = batch[["h", "p", "q"]].to_numpy()
        edge = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        if held and (held[-1][["h", "p", "q"]].to_numpy()[-1] != keys[0]).any():
            yield pd.concat(held, ignore_index=True)
            held = []
        for part in np.split(np.arange(len(batch)), edge)[:-1]:
            yield pd.concat([*held, batch.iloc[part]], ignore_index=True)
            held = []
        held.append(batch.iloc[edge[-1] if len(edge) else 0 :])
    if held:
        yield pd.concat(held, ignore_index=True)


def _candidates(rows: pd.DataFrame, places: int, least: float, known: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(rows i, step d): pairs i, i + d of one pair of blocks whose classes in ``known`` differ and whose sketches agree at a share of ``least`` or more.

    A pair that also meets in the bucket of an earlier band is left to that one. Where p <> q, only rows of different blocks meet. ``known`` may change
    between steps."""
    sketch, bands = np.frombuffer(b"".join(rows["sketch"]), ">u2").reshape(-1, places), np.stack(rows["bands"])[:, : int(rows["band"].iat[0])]
    own, crossed, n = rows["own"].to_numpy(), rows["p"].iat[0] != rows["q"].iat[0], len(rows)
    for d in range(1, n):
        on = known[:-d] != known[d:]
        if crossed:
            on &= own[:-d] != own[d:]
        i = np.flatnonzero(on)
        i = i[(sketch[i] == sketch[i + d]).mean(1) >= least] if len(i) else i
        i = i[~(bands[i] == bands[i + d]).any(1)] if len(i) else i
        if len(i):
            yield i, d


def _needed(places: int, least: float):
    """Those rows of each pair of blocks that have a candidate there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _block_pairs(batches):
            on = np.zeros(len(rows), bool)
            for i, d in _candidates(rows, places, least, rows["class"].to_numpy()):
                on[i] = on[i + d] = True
            if on.any():
                yield rows.loc[on, ["h", "band", "p", "q", "own", "node", "class"]]

    return run


def _linked(places: int, least: float, similarity: float):
    """Links between the classes of each pair of blocks, judged by the sets; classes that a link has joined there are one from then on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _block_pairs(batches):
            known, node, found = rows["class"].to_numpy().copy(), rows["node"].to_numpy(), []
            sets = [np.frombuffer(x, np.uint32) for x in rows["set"]]
            for i, d in _candidates(rows, places, least, known):
                for k in i.tolist():
                    if known[k] != known[k + d] and _alike(sets[k], sets[k + d], similarity):
                        found.append((max(node[k], node[k + d]), min(node[k], node[k + d])))
                        known[known == known[k]] = known[k + d]
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    if min(len(p), len(q)) < similarity * max(len(p), len(q)):
        return False
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= similarity * (len(p) + len(q) - both)


def _joined(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join that deals out both sides anew by a masked key. Never by broadcast: over many rounds the driver would gather the tables of all."""
    masked = lambda df: df.withColumn("__key", F.col(key).bitwiseXOR(F.lit(MASK))).drop(key)
    return masked(left).join(masked(right).hint("merge"), "__key", how).withColumn(key, F.col("__key").bitwiseXOR(F.lit(MASK))).drop("__key")


def components(edges: DataFrame) -> DataFrame:
    """(node, class): for each node the smallest of its connected component, by alternating large and small stars.

    edges: (a, b) of longs, in any direction. Nodes without edges and those that are the smallest themselves are not in the result."""
    now, before = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), forget=True), None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            break
        before = state
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _joined(around.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _joined(large, least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = checkpointed(small.select("e.u", "e.v").filter("u <> v").distinct(), forget=True)
    return now.select(F.col("u").alias("node"), F.col("v").alias("class"))


def _similar(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [_alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity) for x, y in zip(batch["x"], batch["y"])]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "ok": ok})

    return run


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, t1, t2, text)."""
    return docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).select("id", *text_ids(F.col("text"), "t"), "text")


def text_classes(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(t1, t2, rep, node, class) for each different text of rows with an id: its digest, smallest id, number, and the smallest number of its class."""
    spark, places = docs.sparkSession, rows * bands
    base = _named(docs, id_col, text_col).filter("id is not null")

    def signed_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, sketches, sizes = sign(batch["text"].tolist(), words, rows, bands)
            yield batch[["id", "t1", "t2"]].assign(bands=keys, sketch=sketches, size=sizes)

    signed = base.mapInPandas(signed_rows, "id long, t1 long, t2 long, bands array<long>, sketch binary, size long")
    reps = checkpointed(signed.groupBy("t1", "t2").agg(F.min_by(F.struct("bands", "sketch", "size"), "id").alias("s"), F.min("id").alias("rep")).select("t1", "t2", "rep", "s.bands", "s.sketch", "s.size"), forget=True)
    # A text goes by its smallest id. Where several texts have one, all but one go by a number of their own, above 2**62.
    several = reps.groupBy("rep").agg(F.count("*").alias("texts"), F.min("t1").alias("least")).filter("texts > 1").select(F.col("rep").bitwiseXOR(F.lit(MASK)).alias("m"), "least")
    reps = reps.withColumn("node", F.col("rep"))
    if not several.isEmpty():
        own = F.when(F.col("t1") != F.col("least"), F.col("t1").bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62))
        reps = checkpointed(reps.withColumn("m", F.col("rep").bitwiseXOR(F.lit(MASK))).join(several.hint("merge"), "m", "left").withColumn("node", F.coalesce(own, "rep")).drop("m", "least"), forget=True)
    rows_of = reps.select("node", F.posexplode("bands").alias("band", "h"))
    shared = rows_of.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")
    open_rows = checkpointed(_joined(rows_of, shared, "h"), forget=True)
    candidates = open_rows.select("node").distinct()

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, sets = batch["text"].tolist(), []
            for a, b in _groups(texts):
                sets += _sets(texts[a:b], words)
            yield pd.DataFrame({"node": batch["node"], "set": sets})

    # A repeated row would double its links, so one row of each text stays.
    wanted = _joined(reps.select("node", F.col("rep").alias("id"), "t1", "t2"), candidates, "node")
    sets = checkpointed(base.join(wanted.hint("merge"), ["id", "t1", "t2"]).select("node", "text").mapInPandas(collect, "node long, set binary").dropDuplicates(["node"]), forget=True)
    weight = open_rows.groupBy("node").agg(F.sum("n").alias("w"))
    centre = _joined(open_rows.select("h", "node"), weight, "node").groupBy("h").agg(F.max(F.struct("w", F.negative("node").alias("r"))).alias("c")).select("h", F.negative(F.col("c.r")).alias("c"))
    star = _joined(open_rows.select("h", "node"), centre, "h").filter("node <> c").select(F.greatest("node", "c").alias("a"), F.least("node", "c").alias("b"))
    turned = _joined(open_rows, reps.select("node", "sketch"), "node").select("h", "node", F.expr(f"concat(substring(sketch, (band + 1) * {2 * rows} + 1), substring(sketch, 1, (band + 1) * {2 * rows}))").alias("order"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Of two texts at exactly the similarity the sketches' estimate lies lower than six deviations below it once in 10**8.
    least = similarity - 6 * (similarity * (1 - similarity) / places) ** 0.5
    near = turned.repartitionByRange(parts, "h", "order", "node").sortWithinPartitions("h", "order", "node").mapInPandas(_neighbours(places, least), "a long, b long")
    one = _joined(star.unionByName(near).distinct().withColumnRenamed("a", "node"), sets.withColumnRenamed("set", "x"), "node").withColumnRenamed("node", "a")
    two = _joined(one.withColumnRenamed("b", "node"), sets.withColumnRenamed("set", "y"), "node").withColumnRenamed("node", "b")
    first = components(two.select("a", "b", "x", "y").mapInPandas(_similar(similarity), "a long, b long, ok boolean").filter("ok").select("a", "b"))
    # Buckets that still hold several classes: each pair of rows of different classes is compared, by sketches and then by sets.
    placed = checkpointed(_joined(open_rows.select("h", "band", "node"), first, "node", "left").select("h", "band", "node", F.coalesce("class", "node").alias("class")), forget=True)
    mixed = placed.groupBy("h").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low < high").select("h")
    sized = _joined(_joined(placed, mixed, "h"), reps.select("node", "size"), "node")
    blocks = sized.groupBy("h").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") / SHINGLES)).cast("long").alias("blocks"))
    own = _joined(sized, blocks, "h").withColumn("own", F.expr("pmod(xxhash64(node, h), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    met = own.select("h", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "class")
    in_pairs = lambda df: df.repartition(parts, "h", "p", "q").sortWithinPartitions("h", "p", "q")
    signs = reps.select("node", "sketch", "bands")
    needed = checkpointed(in_pairs(_joined(met, signs, "node")).mapInPandas(_needed(places, least), PLACE), forget=True)
    more = in_pairs(_joined(_joined(needed, signs, "node"), sets, "node")).mapInPandas(_linked(places, least, similarity), "a long, b long")
    second = _joined(more.withColumnRenamed("a", "node"), first, "node", "left").select(F.coalesce("class", "node").alias("a"), F.col("b").alias("node"))
    second = checkpointed(_joined(second, first, "node", "left").select("a", F.coalesce("class", "node").alias("b")), forget=True)
    merged = components(second).select(F.col("node").alias("class"), F.col("class").alias("into"))
    known = _joined(reps.select("node", "t1", "t2", "rep"), first, "node", "left").select("t1", "t2", "rep", "node", F.coalesce("class", "node").alias("class"))
    return _joined(known, merged, "class", "left").select("t1", "t2", "rep", "node", F.coalesce("into", "class").alias("class"))


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, rows: int = ROWS, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, class_id (smallest id of its class) and copy_of (smallest id with the same text).

    Texts are of one class if a chain of links joins them; a link is a weighted Jaccard similarity of ``similarity`` or more of the runs of ``words``
    lower-cased words, each weighted by how often it stands (for texts that don't repeat themselves, the Jaccard similarity of the sets). Equal texts
    fall together first.

    Every two texts of a bucket (equal band hash) are compared or already joined by a chain of links that were found. First each text is compared with the
    most central one of the bucket, whose buckets are largest in sum, and with its nearest three in the order of the rest of the signature, begun after
    the band: that joins nearly all that are alike, with comparisons that grow with the rows of the buckets. Then, in the buckets that still hold several
    classes, all pairs of texts of different classes are compared by their sketches, and exactly where those don't lie far below the similarity. Buckets
    of more than BLOCK rows (or SHINGLES shingles) are dealt out by pairs of blocks. A task hands on links alone, at most one for each class that it
    joins, and the sets of those texts travel that have a candidate. So only rows of buckets with several classes cost squares, 240 bytes of sketches a
    time. The result doesn't depend on how rows are dealt out.

    Shingles are compared by 32 bits of their hashes: with n of them, about n / 2**32 of the similarity may be wrong.

    Defined cases: null counts as empty; texts without words are of one class only with equal texts; rows with a null id don't link texts, and
    get null unless a row with an id has their text; repeated rows stay and share a class; several texts of one id are texts of their own, all but one
    under a number above 2**62 instead of the id; very long texts count whole; an empty table gives an empty table; other columns aren't read."""
    classes = text_classes(docs, words, similarity, rows, bands, id_col, text_col)
    keys = [F.col(t).bitwiseXOR(F.lit(MASK)).alias(k) for t, k in (("t1", "k1"), ("t2", "k2"))]
    known = classes.select(*keys, "node", "class")
    return _named(docs, id_col, text_col).select("id", *keys).join(known.hint("merge"), ["k1", "k2"], "left").select(F.col("id").alias(id_col), F.col("class").alias("class_id"), F.col("node").alias("copy_of"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each class, one for each class; rows with a null id stay if no row with an id has their text, one for
    each text. All columns pass through. Defined cases as for ``near_duplicates``."""
    c1, c2, i1, i2, i3 = fresh(docs, "__t1", "__t2", "__k1", "__k2", "__id")
    stay = text_classes(docs, id_col=id_col, text_col=text_col, **how).filter("node = class").select(F.col("t1").alias(i1), F.col("t2").alias(i2), F.col("rep").alias(i3))
    named = docs.withColumns(dict(zip((c1, c2), text_ids(whole_text(text_col)))))
    kept = named.join(stay.hint("merge"), (F.col(id_col).cast("long") == F.col(i3)) & (F.col(c1) == F.col(i1)) & (F.col(c2) == F.col(i2)), "left_semi").dropDuplicates([c1, c2]).select(docs.columns)
    nameless = named.filter(F.col(id_col).isNull())
    if nameless.isEmpty():
        return kept
    others = named.filter(F.col(id_col).isNotNull()).select(c1, c2)
    return kept.unionByName(nameless.join(others, [c1, c2], "left_anti").dropDuplicates([c1, c2]).select(docs.columns))
