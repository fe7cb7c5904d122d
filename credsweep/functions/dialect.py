"""Regex dialect shared by Spark (java.util.regex) and the DuckDB oracle (RE2).

The detection semantics are defined with Python ``re`` in mind: ``\\w``, ``\\d``
and ``\\s`` are Unicode-aware, ``.`` stops only at ``\\n`` and ``$`` also matches
before one final ``\\n``.  Java and RE2 disagree with Python (and with each
other) on all of these, so every pattern in this package is written with the
explicit classes below, which mean the same thing in both engines.
"""

from __future__ import annotations

import unicodedata

# Python str.isspace() characters (includes \x1c-\x1f, which Java's \s lacks).
SPACE_CHARS = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = "[" + SPACE_CHARS + "]"
NON_SPACE = "[^" + SPACE_CHARS + "]"
# Python \w for str patterns: letters, numbers and underscore.
WORD_CHARS = r"\p{L}\p{N}_"
WORD = "[" + WORD_CHARS + "]"
# Python \d for str patterns: decimal digits (category Nd).
DIGIT = r"\p{Nd}"


def _latin1(member) -> str:
    return "".join(f"\\x{c:02x}" for c in range(256) if member(chr(c)))


# The same classes for Java, which tests the members of a class one after the other, but has single
# characters below 256 in one bit set: those are listed, what is above is looked at behind one range.
JAVA_SPACE_CHARS = _latin1(str.isspace) + r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
JAVA_WORD_CHARS = _latin1(lambda c: c == "_" or unicodedata.category(c)[0] in "LN") + r"[\x{100}-\x{10ffff}&&[\p{L}\p{N}]]"
JAVA_DIGIT = r"[0123456789[\x{100}-\x{10ffff}&&\p{Nd}]]"


def expand(pattern: str, space: str = SPACE_CHARS, word: str = WORD_CHARS, digit: str = DIGIT) -> str:
    """Replace the ``{W}``/``{D}``/``{S}``/``{NS}``/``{WC}``/``{SC}`` markers."""
    return (pattern.replace("{WC}", word)
            .replace("{SC}", space)
            .replace("{NS}", f"[^{space}]")
            .replace("{W}", f"[{word}]")
            .replace("{D}", digit)
            .replace("{S}", f"[{space}]"))


def java(pattern: str, ignore_case: bool = False) -> str:
    """Pattern for Spark ``rlike``/``regexp_*``: ``(?d)`` makes ``.`` stop at \\n only."""
    return ("(?diu)" if ignore_case else "(?d)") + expand(pattern, JAVA_SPACE_CHARS, JAVA_WORD_CHARS, JAVA_DIGIT)


def shared(pattern: str) -> str:
    """Like ``java``, with the classes that RE2 reads too: for patterns that the SQL oracle takes from here."""
    return "(?d)" + expand(pattern)


def re2(pattern: str, ignore_case: bool = False) -> str:
    """Pattern for DuckDB's RE2 (``.`` already stops at \\n only)."""
    return ("(?i)" if ignore_case else "") + expand(pattern)


def sql_str(s: str) -> str:
    """DuckDB string literal (backslashes are literal in standard strings)."""
    return "'" + s.replace("'", "''") + "'"
