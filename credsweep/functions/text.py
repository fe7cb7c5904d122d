"""Scalar column functions (M1-M6, N5-N7, P2/P6 helpers).

Every function maps Columns to a Column built from Spark built-ins, so it
runs on the executors, without Python.  Most of it is compiled with its stage;
the lambda functions (entropy, prefix matching) are interpreted.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import java
from .reuse import once
from ..operators.tables import PREFIXES

# --------------------------------------------------------------------------
# FIXED VALUES: word lists and markers that must equal the detector being
# reproduced.
# --------------------------------------------------------------------------
PLACEHOLDER_WORDS = (
    "xxx", "yyy", "zzz", "todo", "fixme", "changeme", "replace_me",
    "your_key_here", "your_secret_here", "your_api_key", "insert_here",
    "placeholder", "example", "test", "dummy", "sample", "fake",
    "none", "null", "undefined", "empty", "n/a", "change_me",
    "your_token_here", "your_password", "enter_here", "update_me",
)
TEST_FILE_MARKERS = ("test", "spec", "mock", "fake", "fixture", "stub",
                     "example", "sample", "demo", "_test.", ".test.")
COMMENT_STARTS = ("//", "#", "*", "/*", "<!--", "--", "REM ")
SENSITIVE_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey",
                   "auth", "credential", "private", "access_key")
NEARBY_WORDS = ("password", "secret", "key", "token")
LINE_NOISE_WORDS = ("example", "sample", "dummy", "fake", "mock", "test", "placeholder")
PREFIX_NOISE_WORDS = ("example", "sample", "dummy", "fake", "mock", "test")
ENV_REFERENCE = r"\$\{|\$\(|process\.env|os\.environ|getenv|System\.getenv"
VALUE_ENV_REFERENCE = r"os\.environ|process\.env|System\.getenv|getenv"
#: The same as plain words: what one of the patterns finds holds one of these.
ENV_WORDS = ("${", "$(", "process.env", "os.environ", "getenv")
VALUE_ENV_WORDS = ("os.environ", "process.env", "getenv")
SEVERITY_CUTS = ((90, "CRITICAL"), (70, "HIGH"), (50, "MEDIUM"), (30, "LOW"))
SEQUENTIAL_STARTS = ("0123456789", "abcdefghij", "ABCDEFGHIJ")
CONFUSABLES_FROM = "аеорсухａｅｏ‘’“”"
CONFUSABLES_TO = "aeopcyxaeo''\"\""
# ------------------------------------------------------------------ end FIXED


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _alternation(words) -> str:
    import re
    return "|".join(re.escape(w) for w in words)


def contains_any(c, words) -> Column:
    """True when the string contains any of ``words`` (plain substring test)."""
    c = _col(c)
    out = None
    for w in words:
        t = c.contains(w)
        out = t if out is None else (out | t)
    return out


def starts_with_any(c, prefixes) -> Column:
    c = _col(c)
    out = None
    for p in prefixes:
        t = c.startswith(p)
        out = t if out is None else (out | t)
    return out


# M1 ------------------------------------------------------------------------
def entropy_raw(s) -> Column:
    """Shannon entropy in bits per code point; '' -> 0.0 (unrounded).

    H = log2(n) - (1/n) * sum(c * log2 c) over character counts c.  The
    counts come from sorting the characters and cutting the sorted string
    into runs of one character (a back-reference regex), so the cost is a
    JVM sort plus one lambda call per character that stands more than once
    (a run of one adds 1 * log2 1 = 0).
    """
    s = _col(s)
    n = F.length(s)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(s, "")), ""), F.lit(r"(?s)((.)\2+)"), 1)
    total = F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.length(r) * F.log2(F.length(r)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n) - total / n)


def entropy(s) -> Column:
    """M1 rounded to 9 digits, the form used for every threshold test.

    Summation order differs between engines; rounding makes exact values such
    as 16 equally frequent characters compare as exactly 4.0.
    """
    return F.round(entropy_raw(s), 9)


# M2 ------------------------------------------------------------------------
def is_placeholder(v) -> Column:
    """M2; ``${...}`` and ``%(...)s`` begin as the plain tests ask, and the patterns run on values that begin as theirs do."""
    v = _col(v)
    low = F.btrim(F.lower(v), F.lit("'\" "))
    return (low.isin(*PLACEHOLDER_WORDS)
            | (F.substring(low, 1, 1).isin(*"x*#<>") & low.rlike(r"(?s)^[x*#<>]{4,}\n?\z"))
            | (v.startswith("{{") & v.rlike(java(r"^\{\{.+\}\}\n?\z")))
            | v.startswith("${") | v.startswith("#{") | v.startswith("%(")
            | contains_any(v, VALUE_ENV_WORDS))


# M3 / M4 -------------------------------------------------------------------
def mask(v) -> Column:
    v = _col(v)
    n = F.length(v)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), n - 8), F.right(v, F.lit(4))))


def clip_match(v) -> Column:
    v = _col(v)
    return F.when(F.length(v) > 80,
                  F.concat(F.substring(v, 1, 40), F.lit("..."), F.right(v, F.lit(20)))).otherwise(v)


# M5 ------------------------------------------------------------------------
def severity(score) -> Column:
    score = _col(score)
    out = F.lit("INFO")
    for cut, name in reversed(SEVERITY_CUTS):
        out = F.when(score >= cut, F.lit(name)).otherwise(out)
    return out


# M6 and line flags ---------------------------------------------------------
def has_nearby_word(raw_line) -> Column:
    return contains_any(F.lower(_col(raw_line)), NEARBY_WORDS)


def nearby_flags(raw_lines) -> Column:
    """``has_nearby_word`` of each line of an array, as 0 or 1; a line is lower-cased once."""
    return F.transform(F.transform(_col(raw_lines), F.lower), lambda l: contains_any(l, NEARBY_WORDS).cast("int"))


def has_env_reference(line) -> Column:
    return contains_any(line, ENV_WORDS)


def is_test_file(filename) -> Column:
    """Lower-cased file name contains a test marker (``latest.py`` counts)."""
    return contains_any(F.lower(_col(filename)), TEST_FILE_MARKERS)


def is_comment(line) -> Column:
    """N6 on the whitespace-stripped line (Unicode whitespace, as str.strip)."""
    return _col(line).rlike(java(r"^{S}*(?://|#|\*|/\*|<!--|--|REM {S}*{NS})"))


def is_nonblank(line) -> Column:
    """The line has a non-whitespace character."""
    return _col(line).rlike(java("{NS}"))


# P2 / P6 -------------------------------------------------------------------
def prefix_array(prefixes=PREFIXES) -> Column:
    """The prefix table as a literal array of structs (35 rows, size fixed)."""
    return once(("prefixes", tuple(prefixes)), lambda: F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(p.prefix).alias("prefix"),
                 F.lit(p.provider).alias("provider"), F.lit(p.type).alias("type"),
                 F.lit(p.length).alias("expected_length"), F.lit(p.score).alias("base_score"))
        for i, p in enumerate(prefixes, 1)]))


def has_known_prefix(v, prefixes=PREFIXES) -> Column:
    """Value starts with any prefix (case-sensitive)."""
    v = _col(v)
    out = None
    for p in prefixes:
        t = v.startswith(p.prefix)
        out = t if out is None else (out | t)
    return out


#: What ``matching_prefixes`` gives.
PREFIX_ROWS = "array<struct<ord:int,prefix:string,provider:string,type:string,expected_length:int,base_score:int>>"


def matching_prefixes(v, prefixes=PREFIXES) -> Column:
    """Every prefix row the value starts with, in table order."""
    v = _col(v)
    found = F.filter(prefix_array(prefixes), lambda p: v.startswith(p["prefix"]))
    n = min((len(p.prefix) for p in prefixes), default=0)
    if not n:
        return found
    # a set lookup first: few values begin as any prefix does
    return F.when(F.substring(v, 1, n).isin(*sorted({p.prefix[:n] for p in prefixes})), found).otherwise(F.array().cast(PREFIX_ROWS))


def first_prefix(v, prefixes=PREFIXES) -> Column:
    """First prefix row in table order, or NULL."""
    return F.get(matching_prefixes(v, prefixes), 0)


def confusables(line) -> Column:
    """Map look-alike characters, none of which is ASCII, to ASCII."""
    line = _col(line)
    return F.when(F.octet_length(line) > F.length(line), F.translate(line, CONFUSABLES_FROM, CONFUSABLES_TO)).otherwise(line)
