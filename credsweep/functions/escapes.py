"""Line normalization N2-N4 as built-in column expressions.

N2 interprets backslash escapes the way a ``unicode_escape`` codec does:
``\\n \\t \\' \\" \\\\ \\a \\b \\f \\v \\r``, ``\\xHH``, ``\\uHHHH``, ``\\UHHHHHHHH``
and 1-3 digit octal; unknown escapes stay as written.  One malformed escape
(``\\x`` without two hex digits, a trailing ``\\`` ...) leaves the whole line
unchanged.  ``\\N{NAME}`` is left as written (no name database in the JVM
built-ins; documented deviation).  Lone surrogates become U+FFFD.

``latin1_compat=True`` reproduces a codec quirk: the line's UTF-8 bytes are
read as Latin-1, so every non-ASCII line turns into mojibake (``é`` -> ``Ã©``).
The default keeps the text as written (the stated intent).

N3 replaces the ``\\xHH`` sequences still present afterwards (``\\\\x41`` -> ``A``).
N4 maps look-alike characters (functions.text.confusables).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import confusables

ESCAPE_TOKENS = (r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]*\}|[0-7]{1,3}|[\s\S])"
                 r"|\\|[^\\]+")
HEX_ESCAPE_TOKENS = r"\\x[0-9a-fA-F]{2}|[^\\]+|\\"

# FIXED VALUES: single-character escapes and what they stand for.
SIMPLE_ESCAPES = {"\\": "\\", "'": "'", '"': '"', "a": "\x07", "b": "\x08",
                  "f": "\x0c", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b"}


def code_point_char(hex_digits: Column) -> Column:
    """Character for a code point given as hex digits (U+FFFD for surrogates)."""
    cp = F.conv(hex_digits, 16, 10).cast("long")
    ch = F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")
    return F.when((cp >= 0xD800) & (cp <= 0xDFFF), F.lit("\ufffd")).otherwise(ch)


def latin1_view(s: Column) -> Column:
    """UTF-8 bytes of ``s`` read as Latin-1 (the codec quirk)."""
    return F.decode(F.encode(s, "UTF-8"), "ISO-8859-1")


def _escape_parts(t: Column):
    kind = F.substring(t, 2, 1)
    n = F.length(t)
    hexd = (F.when((kind == "x") & (n == 4), F.substring(t, 3, 2))
            .when((kind == "u") & (n == 6), F.substring(t, 3, 4))
            .when((kind == "U") & (n == 10), F.substring(t, 3, 8))
            .when(kind.rlike("^[0-7]$"), F.conv(F.substring(t, 2, 3), 8, 16)))
    malformed = ((n == 1)
                 | (kind.isin("x", "u", "U", "N") & (n == 2))
                 | ((kind == "U") & (n == 10)
                    & (F.conv(F.substring(t, 3, 8), 16, 10).cast("long") > 0x10FFFF)))
    return kind, hexd, malformed


def decode_escapes(line, latin1_compat: bool = False) -> Column:
    """N2 on one line."""
    line = F.col(line) if isinstance(line, str) else line
    tokens = F.regexp_extract_all(line, F.lit(ESCAPE_TOKENS), 0)

    def tok(t: Column) -> Column:
        kind, hexd, _ = _escape_parts(t)
        plain = latin1_view(t) if latin1_compat else t
        simple = None
        for k, v in SIMPLE_ESCAPES.items():
            simple = (F.when(kind == k, F.lit(v)) if simple is None
                      else simple.when(kind == k, F.lit(v)))
        other = latin1_view(t) if latin1_compat else t
        return (F.when(F.substring(t, 1, 1) != "\\", plain)
                .when(hexd.isNotNull(), code_point_char(hexd))
                .otherwise(F.coalesce(simple.otherwise(F.lit(None)), other)))

    malformed = F.exists(tokens, lambda t: (F.substring(t, 1, 1) == "\\") & _escape_parts(t)[2])
    decoded = F.when(malformed, line).otherwise(F.array_join(F.transform(tokens, tok), ""))
    if latin1_compat:
        return (F.when(line.contains("\\"), decoded)
                .when(line.rlike("[^\\x00-\\x7f]"), latin1_view(line))
                .otherwise(line))
    return F.when(line.contains("\\"), decoded).otherwise(line)


def decode_hex_escapes(line) -> Column:
    """Remaining ``\\xHH`` -> character (left-to-right, non-overlapping)."""
    line = F.col(line) if isinstance(line, str) else line
    tokens = F.regexp_extract_all(line, F.lit(HEX_ESCAPE_TOKENS), 0)
    out = F.array_join(F.transform(tokens, lambda t: F.when(
        t.rlike(r"^\\x[0-9a-fA-F]{2}$"), code_point_char(F.substring(t, 3, 2))).otherwise(t)), "")
    return F.when(line.contains("\\x"), out).otherwise(line)


def normalize_line(line, latin1_compat: bool = False) -> Column:
    """N2 -> N3 -> N4."""
    return confusables(decode_hex_escapes(decode_escapes(line, latin1_compat)))
