"""Stage 2: decoding (D4-D9) as projections of a line row.

The depth-first chain (base64, hex, url; at most three layers; JSON tokens
one level deeper) is unrolled into per-layer arrays built with
higher-order functions, each in its own projection so a layer is computed
once.  Emission order is the lexicographic order of (pos, path): base64 0,
hex 1, url 2, JSON token j 3+j, parents before children.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.codecs import decode_base64, decode_hex, decode_url
from ..functions.dialect import shared
from .tables import PREFIXES

# FIXED VALUES: encodings, JSON tokens and command forms.
ENCODINGS = ("base64", "hex", "url")
CHAIN_SEP = "→"
JSON_TOKEN = r"['\"]([A-Za-z0-9+/=_-]{16,})['\"]"
CMD_BASE64_SUBSHELL = shared(r"\$\(echo{S}+['\"]?([A-Za-z0-9+/=_-]{12,})['\"]?{S}*\|{S}*base64{S}+--decode\)")
CMD_BASE64_BACKTICK = shared(r"`echo{S}+['\"]?([A-Za-z0-9+/=_-]{12,})['\"]?{S}*\|{S}*base64{S}+--decode`")
CMD_REVERSE = shared(r"echo{S}+['\"]?({NS}{8,})['\"]?{S}*\|{S}*rev")
CMD_ECHO = shared(r"echo{S}+['\"]([^'\"]{8,})['\"]")
EMISSION = "struct<pos:int,path:array<int>,original:string,decoded:string,encoding:string>"


def decode_options(v: Column) -> Column:
    """D1-D3 on one value: array<struct<enc, name, d>> of successes that differ from it."""
    opts = F.array(*[
        F.struct(F.lit(i).alias("enc"), F.lit(name).alias("name"), fn(v).alias("d"))
        for i, (name, fn) in enumerate(zip(ENCODINGS, (decode_base64, decode_hex, decode_url)))])
    return F.filter(opts, lambda o: o["d"].isNotNull() & (o["d"] != v))


def _emit(pos, path, original, decoded, encoding) -> Column:
    return F.struct(pos.cast("int").alias("pos"), path.alias("path"), original.alias("original"),
                    decoded.alias("decoded"), encoding.alias("encoding"))


def _deeper(parents: Column) -> Column:
    """One more layer under each parent of 8+ characters."""
    return F.flatten(F.transform(
        F.filter(parents, lambda p: F.length(p["decoded"]) >= 8),
        lambda p: F.transform(decode_options(p["decoded"]), lambda o: _emit(
            p["pos"], F.concat(p["path"], F.array(o["enc"])), p["decoded"], o["d"],
            F.concat(p["encoding"], F.lit(CHAIN_SEP), o["name"])))))


def _json_layer(parents: Column) -> Column:
    """Quoted key-like tokens of a decoded JSON text, decoded one level deeper."""
    is_json = lambda p: ((p["decoded"].startswith("{") | p["decoded"].startswith("["))
                         & (F.length(p["decoded"]) >= 8))
    return F.flatten(F.transform(F.filter(parents, is_json), lambda p: F.flatten(F.transform(
        F.regexp_extract_all(p["decoded"], F.lit(JSON_TOKEN), 1),
        lambda t, j: F.transform(decode_options(t), lambda o: _emit(
            p["pos"], F.concat(p["path"], F.array(j.cast("int") + 3, o["enc"])), t, o["d"],
            F.concat(p["encoding"], F.lit(CHAIN_SEP + "json_extract" + CHAIN_SEP), o["name"])))))))


def add_decode_chain(df: DataFrame, values: str, out: str = "decoded") -> DataFrame:
    """Adds ``out`` = array of emissions for the raw values in ``values``.

    Raw values (V1/V2) contain no quote characters, so JSON tokens can only
    come from decoded text (layer 2).
    """
    cols = df.columns

    def below(parents: str, made: Column) -> Column:
        # lambda functions are interpreted: only lines with something to decode get to them
        return F.when(F.size(parents) > 0, made).otherwise(F.array().cast(f"array<{EMISSION}>"))

    l1 = df.select("*", below(values, F.flatten(F.transform(F.col(values), lambda v, i: F.transform(
        decode_options(v), lambda o: _emit(i, F.array(o["enc"]), v, o["d"], o["name"]))))).alias("_l1"))
    l2 = l1.select("*", below("_l1", _deeper(F.col("_l1"))).alias("_l2"), below("_l1", _json_layer(F.col("_l1"))).alias("_l2j"))
    l3 = l2.select("*", below("_l2", _deeper(F.col("_l2"))).alias("_l3"))
    return l3.select(*cols, F.concat("_l1", "_l2", "_l2j", "_l3").alias(out))


def cmd_matches(line: Column) -> list[Column]:
    """What the four command forms match first in a line; NULL or empty when nothing."""
    return [F.when(line.contains("echo"), F.regexp_extract(line, form, 1)) for form in (CMD_BASE64_SUBSHELL, CMD_BASE64_BACKTICK, CMD_REVERSE, CMD_ECHO)]


def cmd_decodes(x6: Column, x7: Column, x8: Column, x9: Column, prefixes=PREFIXES) -> Column:
    """First match of each command form in a line (``cmd_matches``, as columns; comments not skipped).

    pos 0 ``$(echo X | base64 --decode)``, 1 the backtick form, 2 ``echo X | rev``
    (kept if the reversed text has a known prefix or entropy > 4.0),
    3 ``echo "X"`` (kept if X has a known prefix).
    """
    d6, d7, r8 = decode_base64(x6), decode_base64(x7), F.reverse(x8)
    none = F.array().cast("array<int>")
    arr = F.array(
        F.when(d6.isNotNull(), _emit(F.lit(0), none, x6, d6, F.lit("cmd:base64_decode"))),
        F.when(d7.isNotNull(), _emit(F.lit(1), none, x7, d7, F.lit("cmd:base64_decode"))),
        F.when((x8 != "") & (tx.has_known_prefix(r8, prefixes) | (tx.entropy(r8) > 4.0)),
               _emit(F.lit(2), none, x8, r8, F.lit("cmd:reverse"))),
        F.when((x9 != "") & tx.has_known_prefix(x9, prefixes), _emit(F.lit(3), none, x9, x9, F.lit("cmd:echo"))))
    return F.when((x6 != "") | (x7 != "") | (x8 != "") | (x9 != ""), F.filter(arr, lambda e: e.isNotNull())).otherwise(
        F.array().cast(f"array<{EMISSION}>"))
