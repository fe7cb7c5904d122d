"""Stage 1: documents -> numbered, normalized lines.

Everything here is narrow: a document row is split into an array of lines,
the neighbour-keyword count (C2) is computed on that array with higher-order
functions, and one ``posexplode`` turns it into line rows.  No shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.escapes import normalize_line

#: The name of a document without one.
UNKNOWN = "unknown"
# str.splitlines() boundaries.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: Those besides the line feed, in ASCII and above.
ASCII_BREAKS, OTHER_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e", "\x85\u2028\u2029"


def line_parts(text: Column) -> Column:
    """A text cut at its line breaks; one with line feeds only (tested by plain searches) needs no pattern."""
    text = F.coalesce(text, F.lit(""))
    others = tx.contains_any(text, ASCII_BREAKS) | ((F.octet_length(text) > F.length(text)) & tx.contains_any(text, OTHER_BREAKS))
    return F.when(others, F.split(text, LINE_BREAKS, -1)).otherwise(F.split(text, "\n", -1))


def without_last_empty(parts: str) -> Column:
    """The lines of an array column of ``line_parts``: what follows the last break is a line unless it is empty."""
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(F.col(parts))


def nearby_counts(flags: Column) -> Column:
    """For each line, how many of lines -2,-1,+1,+2 hold a keyword.

    ``flags`` must be an already computed int array column (it is referenced
    inside the lambda, so it must not be an expression to re-evaluate).
    """
    def around(_, i):
        total = F.lit(0)
        for off in (-2, -1, 1, 2):
            total = total + F.coalesce(F.get(flags, i + off), F.lit(0))
        return total
    return F.transform(flags, around)


def document_hash(filename: Column, text: Column) -> Column:
    """Tells documents apart that share an id; rows equal in id, name and text are one document."""
    return F.xxhash64(F.coalesce(filename, F.lit(UNKNOWN)), text)


def split_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """N1 as a table: (doc_id, line_num, raw_line) for every line."""
    staged = docs.select("doc_id", line_parts(F.col(text_col)).alias("parts"))
    return (staged.select("doc_id", F.posexplode_outer(without_last_empty("parts")).alias("pos", "raw_line"))
            .where(F.col("pos").isNotNull())
            .select("doc_id", (F.col("pos") + 1).cast("int").alias("line_num"), "raw_line"))


def lines(docs: DataFrame, latin1_compat: bool = False, keep_text: bool = True, nearby: bool = True) -> DataFrame:
    """Stage 1: one row per line with the normalized text and line features.

    Columns: doc_id, doc_hash, filename, is_test, line_num, raw_line, line,
    nearby, is_comment, is_code (non-blank and not a comment), nonblank, kw
    (sensitive word), env_ref, noise (C1 words), pnoise (C3 words).  Without
    ``nearby`` that column is missing; an unused one isn't pruned from the explode.

    ``doc_id`` may be of any type.  ``doc_hash`` (of name and text) keeps
    different documents apart that share an id; rows that are equal in id, name
    and text are one document.  A NULL name is ``unknown``, a NULL text empty.

    Each array is produced in its own projection; Catalyst keeps them apart
    because they are referenced more than once downstream.
    """
    filename = F.coalesce(F.col("filename"), F.lit(UNKNOWN))
    parts = docs.select(
        "doc_id", document_hash(F.col("filename"), F.col("text")).alias("doc_hash"), filename.alias("filename"), tx.is_test_file(filename).alias("is_test"),
        line_parts(F.col("text")).alias("parts"))
    raw = parts.select("doc_id", "doc_hash", "filename", "is_test", without_last_empty("parts").alias("raw"))
    if nearby:
        flagged = raw.select("*", tx.nearby_flags("raw").alias("flags"))
        raw = flagged.select("doc_id", "doc_hash", "filename", "is_test", "raw", nearby_counts(F.col("flags")).alias("nearby"))
    # posexplode_outer + a filter on the generated column: an inner explode
    # makes Catalyst infer size(array) > 0 and push it below, re-evaluating
    # the arrays there.
    exploded = raw.select(
        "doc_id", "doc_hash", "filename", "is_test",
        F.posexplode_outer(F.arrays_zip("raw", "nearby") if nearby else F.col("raw")).alias("pos", "l")).where(F.col("pos").isNotNull())
    out = exploded.select(
        "doc_id", "doc_hash", "filename", "is_test",
        (F.col("pos") + 1).cast("int").alias("line_num"),
        (F.col("l.raw") if nearby else F.col("l")).alias("raw_line"),
        *([F.col("l.nearby").cast("int").alias("nearby")] if nearby else []))
    out = out.withColumn("line", normalize_line(F.col("raw_line"), latin1_compat))
    out = line_features(out)
    if not keep_text:
        out = out.drop("raw_line")
    return out


def line_features(df: DataFrame, line: str = "line") -> DataFrame:
    """Line flags; the lower-cased line is computed once (Unicode lower-casing
    is costly on non-ASCII text) and shared by the three keyword tests."""
    l = F.col(line)
    staged = df.select("*", F.lower(l).alias("_lower"))
    low = F.col("_lower")
    comment = tx.is_comment(l)
    # all prefix noise words are line noise words
    pnoise = tx.contains_any(low, tx.PREFIX_NOISE_WORDS)
    noise = pnoise | tx.contains_any(low, [w for w in tx.LINE_NOISE_WORDS if w not in tx.PREFIX_NOISE_WORDS])
    return staged.select(
        *df.columns,
        comment.alias("is_comment"),
        (tx.is_nonblank(l) & ~comment).alias("is_code"),
        tx.is_nonblank(l).alias("nonblank"),
        tx.contains_any(low, tx.SENSITIVE_WORDS).alias("kw"),
        tx.has_env_reference(l).alias("env_ref"),
        noise.alias("noise"),
        pnoise.alias("pnoise"),
    )
