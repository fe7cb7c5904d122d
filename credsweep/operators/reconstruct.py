"""Stage 3: reconstruction.

R1 is a projection of one line.  R2/R3 gather ``name<n> = part`` and
``name[n] = part`` assignments over a whole document; the grouping itself is
in ``plans.scan.fold_parts``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dialect import java, shared
from .candidates import has_assignment, has_quote
from .tables import PREFIXES

# FIXED VALUES: what a concatenation and a part of a split value look like.
CONCAT = shared(r"['\"]([a-zA-Z0-9_-]{3,})['\"]{S}*[\+\.]{S}*(?:['\"]([a-zA-Z0-9_-]{3,})['\"]|({W}+))")
SPLIT_PART = shared(r"^{S}*({W}+?)({D}+){S}*[=:]{S}*['\"]?({NS}+?)['\"]?{S}*\z")
ARRAY_PART = shared(r"^{S}*([{WC}.]+)\[({D}+)\]{S}*[=:]{S}*['\"]?({NS}+?)['\"]?{S}*\z")
# SPLIT_PART in time linear in the line: the whole name first, its last digits from it.
SPLIT_WORD = java(r"^{S}*+({W}++){S}*+[=:]{S}*['\"]?({NS}+?)['\"]?{S}*\z")
LAST_DIGITS = java(r"(?<!{D})({D}++)\z")
ARRAY_NAME = java(r"^{S}*+([{WC}.]++)\[({D}++)\]{S}*+[=:]{S}*['\"]?({NS}+?)['\"]?{S}*\z")
METHODS = {1: "string_concat", 2: "split_assignment", 3: "array_split"}
# Entropy needed to keep a group without a known prefix.
MIN_GROUP_ENTROPY = {2: 4.0, 3: 3.5}


def first_literal(line: Column) -> Column:
    """``a`` of the first ``"a" + "b"`` / ``"a" . b``; NULL or empty when none."""
    return F.when((line.contains("+") | line.contains(".")) & has_quote(line), F.regexp_extract(line, CONCAT, 1))


def concat_literal(line: Column, g1: Column, prefixes=PREFIXES) -> Column:
    """struct<value, prefix> of a line and its ``first_literal`` when that has a known prefix."""
    g2 = F.regexp_extract(line, CONCAT, 2)
    g3 = F.regexp_extract(line, CONCAT, 3)
    suffix = F.when(g2 != "", g2).otherwise(F.concat(F.lit("<"), g3, F.lit(">")))
    return F.when((g1 != "") & tx.has_known_prefix(g1, prefixes),
                  F.struct(F.concat(g1, suffix).alias("value"), g1.alias("prefix")))


def split_word(line: Column) -> Column:
    """The whole name that a line assigns to, with its digits; NULL or empty when none."""
    return F.when(has_assignment(line), F.regexp_extract(line, SPLIT_WORD, 1))


def split_index(word: Column) -> Column:
    """The digits that end a name; NULL or empty when none."""
    tail = F.regexp_extract(word, LAST_DIGITS, 1)
    # a name has one character at least, so of digits alone the first one is the name
    return F.when(word != "", F.when(F.length(tail) < F.length(word), tail).otherwise(word.substr(F.lit(2), F.length(word))))


def array_name(line: Column) -> Column:
    """``name`` of ``name[n] = part``; NULL or empty when none."""
    return F.when(has_assignment(line) & line.contains("["), F.regexp_extract(line, ARRAY_NAME, 1))


def assignment_part(line: Column, word: Column | None = None, idx: Column | None = None, a_name: Column | None = None) -> Column:
    """R2/R3 part of one line: struct<kind (2 split, 3 array), name, idx, value> or NULL.

    Name and index are used several times; a caller with many lines gives them as columns.
    """
    word = split_word(line) if word is None else word
    idx = split_index(word) if idx is None else idx
    a_name = array_name(line) if a_name is None else a_name
    split = F.struct(F.lit(2).alias("kind"), word.substr(F.lit(1), F.length(word) - F.length(idx)).alias("name"),
                     idx.alias("idx"), F.regexp_extract(line, SPLIT_WORD, 2).alias("value"))
    arr = F.struct(F.lit(3).alias("kind"), a_name.alias("name"),
                   F.regexp_extract(line, ARRAY_NAME, 2).alias("idx"),
                   F.regexp_extract(line, ARRAY_NAME, 3).alias("value"))
    return F.when(idx != "", split).when(a_name != "", arr)


def index_key(idx: Column) -> Column:
    """Exact numeric order of a digit string of any length: (length, digits) without leading zeros."""
    digits = F.regexp_replace(idx, "^0+(?=.)", "")
    return F.struct(F.length(digits).alias("n"), digits.alias("d"))


def part_key(idx: Column, line_num: Column, value: Column) -> Column:
    """What a part is kept as until its value is joined; parts stand in this order, by index, ties by line."""
    return F.struct(index_key(idx).alias("k"), line_num.alias("line_num"), value.alias("value"))


def without_repeats(parts: str) -> Column:
    """A sorted array column's elements, equal ones once.

    The neighbour is looked at: ``array_distinct`` compares all pairs of structs.
    """
    return F.filter(parts, lambda p, i: (i == 0) | (p != F.get(F.col(parts), i - 1)))


def keep_group(kind: Column, value: Column, entropy: Column, prefixes=PREFIXES) -> Column:
    """A joined value counts if it has a known prefix or enough entropy for its kind."""
    return tx.has_known_prefix(value, prefixes) | ((kind == 2) & (entropy > MIN_GROUP_ENTROPY[2])) | ((kind == 3) & (entropy > MIN_GROUP_ENTROPY[3]))
