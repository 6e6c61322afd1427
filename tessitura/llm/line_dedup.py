"""Corpus-wide line deduplication, in DataFrame functions alone.

Lines are exploded, normalised and hashed; hashes found in enough documents are counted with map-side
combining; the places to drop travel back to their documents, which are reassembled by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import ascii_lower, checkpointed, fresh, two_hashes, whole_text

BLANKS = " \t\n\x0b\x0c\r"
#: Both join sides are keyed by hash ^ MASK: a key of its own makes Spark deal out both sides for the join,
#: so that a line held by a third of all documents can be split by AQE's skew join.
MASK = 0x5DEECE66D


def line_key(line: Column) -> Column:
    """The line stripped of ASCII blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines whose key has ``min_chars`` code points or more and is found in ``min_docs`` documents or more,
    except in the document with the largest id that holds it (which keeps every such line).

    Returns every input row and column, ``text_col`` rewritten, plus two last columns, ``__n_lines`` (before) and ``__n_dropped`` (with more underscores
    where the input has those).

    The hashed lines are written once to the shared checkpoint folder, as counting and dropping both read them.

    Defined cases: a null or empty text is one empty line and comes back empty; rows with a null id neither
    count as documents nor lose lines; repeated rows of one id count as one document and each loses the same
    lines; very long texts are split whole; an empty table gives an empty table; other columns pass through untouched.
    """
    th, di, dt, gone, lines_, stay, n1, n2 = fresh(docs, "__th", "__id", "__dth", "__drop", "__lines", "__stay", "__n_lines", "__n_dropped")
    split = F.split(whole_text(text_col), "\n", -1)
    base = docs.withColumn(th, F.xxhash64(whole_text(text_col)))
    lines = checkpointed(
        base.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.col(th).alias("th"), F.posexplode(split).alias("pos", "line"))
        .select("id", "th", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.char_length("key") >= min_chars)
        .select("id", "th", "pos", *two_hashes(F.col("key"), "h"))
    )
    common = (
        lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keep"))
        .filter(F.col("n") >= min_docs)
        .select(F.col("h1").bitwiseXOR(F.lit(MASK)).alias("k1"), F.col("h2").bitwiseXOR(F.lit(MASK)).alias("k2"), "keep")
    )
    drops = (
        lines.select("id", "th", "pos", F.col("h1").bitwiseXOR(F.lit(MASK)).alias("k1"), F.col("h2").bitwiseXOR(F.lit(MASK)).alias("k2"))
        .join(common, ["k1", "k2"])
        .filter(F.col("id") != F.col("keep"))
        .groupBy(F.col("id").alias(di), F.col("th").alias(dt))
        .agg(F.collect_set("pos").alias(gone))
    )
    joined = base.join(drops, (F.col(id_col) == F.col(di)) & (F.col(th) == F.col(dt)), "left")
    marked = joined.withColumn(lines_, split).withColumn(stay, F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.coalesce(gone, F.array().cast("array<int>"))))
    text = F.when(F.col(gone).isNull(), whole_text(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines_, i)), "\n"))
    n_lines = F.size(lines_).cast("long")
    return marked.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], n_lines.alias(n1), (n_lines - F.size(stay)).alias(n2))
