"""Candidate values (V1-V5): projections of a normalized line.

V1/V2 feed the decoder, V3/V4 the prefix stage; all skip blank and comment
lines (V5), which the caller expresses with ``is_code``.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import java

# FIXED VALUES: what candidate values look like (dialect markers); the SQL oracle
# uses these as written.
QUOTED_TOKEN_SPEC = r"['\"]([^{SC}'\"]{12,})['\"]"
ASSIGNED_TOKEN_SPEC = r"[{WC}.]+{S}*[=:]{S}*['\"]?([^{SC}'\"]{12,})['\"]?"
QUOTED_VALUE_SPEC = r"['\"]([^'\"]{8,})['\"]"
ASSIGNED_VALUE_SPEC = r"[{WC}.]+{S}*[=:]{S}*({NS}{8,})"
# Java forms.  A leftmost ``name =`` match always starts where a run of name
# characters starts, and nothing after the run can be a name character, so a
# look-behind plus possessive quantifiers give the same first match while
# keeping the backtracking engine linear on long tokens without spaces.
QUOTED_TOKEN = java(QUOTED_TOKEN_SPEC)
ASSIGNED_TOKEN = java(r"(?<![{WC}.])[{WC}.]++{S}*+[=:]{S}*['\"]?([^{SC}'\"]{12,})['\"]?")
QUOTED_VALUE = java(QUOTED_VALUE_SPEC)
ASSIGNED_VALUE = java(r"(?<![{WC}.])[{WC}.]++{S}*+[=:]{S}*({NS}{8,})")


def has_quote(line: Column) -> Column:
    """What a line needs for V1 and V3."""
    return line.contains("'") | line.contains('"')


def has_assignment(line: Column) -> Column:
    """What a line needs for V2, V4 and the parts of a split value."""
    return line.contains("=") | line.contains(":")


def quoted_tokens(line: Column) -> Column:
    """V1: every quoted run of 12+ characters without spaces or quotes; NULL or empty when none."""
    return F.when(has_quote(line), F.regexp_extract_all(line, F.lit(QUOTED_TOKEN), 1))


def assigned_token(line: Column) -> Column:
    """V2: value of the first ``name = value`` / ``name: value`` (12+ chars); NULL or empty when none."""
    return F.when(has_assignment(line), F.regexp_extract(line, ASSIGNED_TOKEN, 1))


def raw_values(v1: Column, v2: Column) -> Column:
    """V1 followed by V2 when V2 is not already among V1 (input of the decoder)."""
    v1 = F.coalesce(v1, F.array().cast("array<string>"))
    return F.when(F.coalesce(v2, F.lit("")) == "", v1).when(F.array_contains(v1, v2), v1).otherwise(F.concat(v1, F.array(v2)))


def quoted_values(line: Column) -> Column:
    """V3: every quoted run of 8+ characters (spaces allowed); NULL or empty when none."""
    return F.when(has_quote(line), F.regexp_extract_all(line, F.lit(QUOTED_VALUE), 1))


def assigned_value(line: Column) -> Column:
    """V4: first ``name =/: \\S{8,}`` (quote characters included); NULL or empty when none."""
    return F.when(has_assignment(line), F.regexp_extract(line, ASSIGNED_VALUE, 1))


def prefix_line_candidates(quoted: Column, assigned: Column) -> Column:
    """V3 then V4 of a line, as array<struct<sub, pos, value>> (sub 0 quoted, 1 unquoted)."""
    none = F.array().cast("array<struct<sub:int,pos:int,value:string>>")
    q = F.coalesce(F.transform(quoted, lambda v, i: F.struct(
        F.lit(0).alias("sub"), i.cast("int").alias("pos"), v.alias("value"))), none)
    return F.when(assigned != "", F.concat(q, F.array(F.struct(
        F.lit(1).alias("sub"), F.lit(0).alias("pos"), assigned.alias("value"))))).otherwise(q)


#: Kinds of candidate rows, in the order of a line's rows, and what gives their values.
KINDS = {"quoted_token": quoted_tokens, "assigned_token": assigned_token, "quoted_value": quoted_values, "assigned_value": assigned_value}


def candidate_rows(lines: DataFrame, kinds=tuple(KINDS)) -> DataFrame:
    """V1-V4 as rows: (doc_id, line_num, kind, pos, value) for code lines (V5); only the ``kinds`` asked for are planned.

    Other lines have NULLs: a filter on ``is_code`` would be pushed below the
    normalization, which would then run twice a line.
    """
    code = F.col("is_code")
    v = lines.select("doc_id", "line_num", *[F.when(code, KINDS[k](F.col("line"))).alias(k) for k in kinds])
    none = F.array().cast("array<struct<kind:string,pos:int,value:string>>")

    def rows(k: str) -> Column:
        if k.startswith("quoted"):
            return F.coalesce(F.transform(k, lambda x, i: F.struct(F.lit(k).alias("kind"), i.cast("int").alias("pos"), x.alias("value"))), none)
        return F.when(F.col(k) != "", F.array(F.struct(F.lit(k).alias("kind"), F.lit(0).alias("pos"), F.col(k).alias("value")))).otherwise(none)

    some = reduce(or_, [F.size(k) > 0 if k.startswith("quoted") else F.col(k) != "" for k in kinds])
    # a column of its own: what stands in the explode itself is interpreted
    made = v.select("doc_id", "line_num", F.when(some, F.concat(*[rows(k) for k in kinds])).alias("cs"))
    return (made.select("doc_id", "line_num", F.explode_outer("cs").alias("c")).where(F.col("c").isNotNull())
            .select("doc_id", "line_num", "c.kind", "c.pos", "c.value"))
