"""Value decoders D1-D3 and the printable test D10, as built-in expressions.

Each decoder returns the decoded string or NULL.  Spark's decoders are more
lenient than the strict behaviour being reproduced (base64 ignores spaces and
missing padding, URL decoding turns ``+`` into a space and rejects ``%zz``),
so each one is gated by a regex first.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Printable = assigned letters, marks, numbers, punctuation, symbols, or a space.
# Written as "no character outside that class" so Java runs one class test per
# character (an alternation under * recurses per character and overflows the
# stack on long text).
NON_PRINTABLE = r"[^\p{L}\p{M}\p{N}\p{P}\p{S} ]"


def is_printable(s: Column) -> Column:
    """Str.isprintable() -- no control, format, unassigned, separator except space."""
    return ~s.rlike(NON_PRINTABLE)


def _utf8_printable(b: Column, min_len: int) -> Column:
    s = b.cast("string")
    return F.when(F.is_valid_utf8(s) & is_printable(s) & (F.length(s) >= min_len), s)


def decode_base64(v: Column) -> Column:
    """Strict standard-alphabet base64 of a value of 12+ characters.

    The value is padded to a multiple of four; characters ``-``/``_`` pass
    the first gate but never decode (the URL-safe fallback never applies).
    """
    padded = F.concat(v, F.repeat(F.lit("="), F.pmod(-F.length(v), F.lit(4))))
    ok = ((F.length(v) >= 12) & v.rlike(r"^[A-Za-z0-9+/=_-]+\z")
          & padded.rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (F.length(padded) % 4 == 0))
    return F.when(ok, _utf8_printable(F.try_to_binary(padded, F.lit("base64")), 6))


def decode_hex(v: Column) -> Column:
    """Even-length hex of 16+ characters to UTF-8 text of 8+ characters."""
    ok = (F.length(v) >= 16) & (F.length(v) % 2 == 0) & v.rlike(r"^[0-9a-fA-F]+\z")
    return F.when(ok, _utf8_printable(F.unhex(v), 8))


def decode_url(v: Column) -> Column:
    """D3: percent-decoding; ``+`` stays, malformed ``%`` stays, result must differ and have 6+ chars."""
    prepared = F.regexp_replace(F.regexp_replace(v, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    d = F.try_url_decode(prepared)
    return F.when(v.contains("%") & (d != v) & (F.length(d) >= 6), d)
