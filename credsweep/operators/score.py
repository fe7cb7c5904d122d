"""Stage 6: confidence scoring and merge.

Input is the ``evidence`` table: one row per thing that may become a
finding (regex hit, prefix hit, decoded value, reconstructed value), keyed
by an explicit order struct ``key`` (phase, grp, ln, sub, pos, path, pord)
that reproduces the insertion order of the sequential detector.  Scoring is
column arithmetic; de-duplication is a window within a document's line, so a
document with very many hits is dealt over tasks, and only the rank of what is
left is a window over the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.reuse import once
from .rules import rule_attr
from .tables import RULES

EV_REGEX, EV_PREFIX, EV_DECODED, EV_RECON = 1, 2, 3, 4
SUPPRESS_BELOW = 15

# --------------------------------------------------------------------------
# FIXED VALUES: label and message formats of findings.
# --------------------------------------------------------------------------
PREFIX_FIX = "Detected {provider} {type}. Store in env vars or secrets manager."
DECODED_RULE = "{provider} {type} ({enc} encoded)"
DECODED_MATCH = "[{enc}] {original30}... → {decoded30}..."
DECODED_FIX = "Found {enc}-encoded {provider} key. Encoding is not security."
DECODED_ENTROPY_RULE = "High-entropy {enc}-decoded value"
DECODED_ENTROPY_MATCH = "[{enc}] → {decoded40}"
DECODED_ENTROPY_FIX = "This {enc}-encoded value decodes to a suspicious string. Review it."
RECON_RULE = "{provider} {type} (reconstructed via {method})"
RECON_MATCH = "[{method}] {value}"
RECON_FIX = "Found split/concatenated {provider} key. Splitting doesn't hide secrets."
RECON_ENTROPY_RULE = "High-entropy reconstructed value ({method})"
RECON_ENTROPY_FIX = "Reconstructed value has high entropy. Review if it's a secret."
DECODED_ENTROPY_BASE, RECON_ENTROPY_BASE = 45, 40
DECODED_MIN_LEN, RECON_MIN_LEN = 16, 20
# ------------------------------------------------------------------ end FIXED


def _fmt(template: str, **cols: Column) -> Column:
    """Render a ``{name}`` template with Columns (literal text in between)."""
    import re
    parts, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(cols[m.group(1)])
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c))


def regex_confidence(secret: Column, e: Column, rule_id: Column, is_test: Column, kw: Column,
                     is_comment: Column, env_ref: Column, noise: Column, nearby: Column,
                     rules=RULES) -> Column:
    """C1 (with C2 folded in through ``nearby``)."""
    n = F.length(secret)
    ne = rule_attr("needs_entropy", rule_id, rules)
    base = rule_attr("base_score", rule_id, rules)
    ladder = (F.when((e >= 5.0) & (n >= 32), 20).when(e >= 5.0, 15).when((e >= 4.5) & (n >= 20), 12)
              .when(e >= 4.5, 10).when(e >= 4.0, 5).when((e < 2.5) & ne, -20).otherwise(0))
    length = F.when(n >= 40, 10).when(n >= 24, 5).when((n < 8) & ne, -15).otherwise(0)
    distinct = F.size(F.array_distinct(F.split(secret, "")))
    few = F.when((n >= 16) & (distinct <= 3), -50).when((n >= 16) & (e < 2.0), -35).otherwise(0)
    seq = F.when(tx.starts_with_any(secret, tx.SEQUENTIAL_STARTS), -15).otherwise(0)
    lower = F.when(secret.rlike(r"^[a-z]+\n?\z") & (e < 3.5), -20).otherwise(0)
    digits = F.when(secret.rlike(r"^[0-9]+\n?\z") & (e < 3.0), -25).otherwise(0)
    ctx = (F.when(kw, 10).otherwise(0) + F.when(is_test, -25).otherwise(0)
           + F.when(tx.is_placeholder(secret), -40).otherwise(0) + F.when(is_comment, -20).otherwise(0)
           + F.when(env_ref, -30).otherwise(0) + F.when(noise, -20).otherwise(0)
           + F.when(nearby >= 2, 5).otherwise(0)
           + F.when((e >= 4.5) & kw & ~is_test, 5).otherwise(0))
    return clamp(base + ladder + length + few + seq + lower + digits + ctx)


def prefix_confidence(value: Column, e: Column, pscore: Column, plen: Column, is_test: Column,
                      pnoise: Column) -> Column:
    """C3."""
    ent = F.when(e >= 4.5, 10).when((e < 3.0) & (pscore < 90), -15).otherwise(0)
    return clamp(pscore + F.when(is_test, -25).otherwise(0)
                 + F.when(tx.is_placeholder(value), -40).otherwise(0)
                 + F.when(pnoise, -20).otherwise(0) + ent
                 + F.when(F.length(value) * 2 < plen, -20).otherwise(0))


def _scores(rules) -> tuple[Column, ...]:
    """Rule name, category, confidence, match, fix and source of an evidence row with its entropy ``_e``."""
    e, v, kind = F.col("_e"), F.col("value"), F.col("ev")
    enc = F.col("label")
    has_p = F.col("pord").isNotNull()
    conf = (F.when(kind == EV_REGEX, regex_confidence(
                v, e, F.col("rule_id"), F.col("is_test"), F.col("kw"), F.col("is_comment"),
                F.col("env_ref"), F.col("noise"), F.col("nearby"), rules))
            .when(kind == EV_PREFIX, prefix_confidence(v, e, F.col("pscore"), F.col("plen"),
                                                       F.col("is_test"), F.col("pnoise")))
            .when(((kind == EV_DECODED) | (kind == EV_RECON)) & has_p, F.least(F.lit(100), F.col("pscore") + 5))
            .when((kind == EV_DECODED) & (e >= 4.0) & (F.length(v) >= DECODED_MIN_LEN),
                  F.least(F.lit(100), DECODED_ENTROPY_BASE + F.floor(e * 5).cast("int")))
            .when((kind == EV_RECON) & (e >= 4.0) & (F.length(v) >= RECON_MIN_LEN),
                  F.least(F.lit(100), RECON_ENTROPY_BASE + F.floor(e * 5).cast("int"))))
    provider, ptype = F.col("provider"), F.col("ptype")
    rule = (F.when(kind == EV_REGEX, rule_attr("name", F.col("rule_id"), rules))
            .when(kind == EV_PREFIX, F.concat_ws(" ", provider, ptype))
            .when((kind == EV_DECODED) & has_p, _fmt(DECODED_RULE, provider=provider, type=ptype, enc=enc))
            .when(kind == EV_DECODED, _fmt(DECODED_ENTROPY_RULE, enc=enc))
            .when(has_p, _fmt(RECON_RULE, provider=provider, type=ptype, method=enc))
            .otherwise(_fmt(RECON_ENTROPY_RULE, method=enc)))
    category = (F.when(kind == EV_REGEX, rule_attr("category", F.col("rule_id"), rules))
                .when(kind == EV_PREFIX, F.lit("prefix"))
                .when(kind == EV_DECODED, F.lit("decoded")).otherwise(F.lit("reconstructed")))
    raw_match = (F.when(kind == EV_REGEX, F.col("text"))
                 .when(kind == EV_PREFIX, v)
                 .when((kind == EV_DECODED) & has_p, _fmt(
                     DECODED_MATCH, enc=enc, original30=F.substring(F.col("text"), 1, 30),
                     decoded30=F.substring(v, 1, 30)))
                 .when(kind == EV_DECODED, _fmt(DECODED_ENTROPY_MATCH, enc=enc, decoded40=F.substring(v, 1, 40)))
                 .otherwise(_fmt(RECON_MATCH, method=enc, value=v)))
    fix = (F.when(kind == EV_REGEX, rule_attr("fix", F.col("rule_id"), rules))
           .when(kind == EV_PREFIX, _fmt(PREFIX_FIX, provider=provider, type=ptype))
           .when((kind == EV_DECODED) & has_p, _fmt(DECODED_FIX, enc=enc, provider=provider))
           .when(kind == EV_DECODED, _fmt(DECODED_ENTROPY_FIX, enc=enc))
           .when(has_p, _fmt(RECON_FIX, provider=provider))
           .otherwise(F.lit(RECON_ENTROPY_FIX)))
    source = (F.when(kind == EV_REGEX, F.lit("regex"))
              .when((kind == EV_PREFIX) & F.col("label").isin("quoted", "unquoted"),
                    F.concat(F.lit("prefix:"), provider))
              .when(kind == EV_PREFIX, F.concat(
                  F.lit("prefix:"), provider, F.lit("("),
                  F.when(F.col("key.grp") <= 2, F.lit("decoded:")).otherwise(F.lit("reconstructed:")),
                  F.col("label"), F.lit(")")))
              .when(kind == EV_DECODED, F.concat(F.lit("decoded:"), enc))
              .otherwise(F.concat(F.lit("reconstructed:"), enc)))
    return rule, category, conf, raw_match, fix, source


def score_evidence(ev: DataFrame, rules=RULES) -> DataFrame:
    """One candidate finding per evidence row (or none).

    ``ev`` columns: doc_id, doc_hash, filename, is_test, line_num, kw, env_ref, noise,
    pnoise, is_comment, nearby, ev, key, rule_id, value, text, label, pord,
    provider, ptype, plen, pscore.
    """
    staged = ev.select("*", tx.entropy(F.col("value")).alias("_e"))
    rule, category, conf, raw_match, fix, source = once(("scores", tuple(rules)), lambda: _scores(rules))
    conf = conf.cast("int")
    # Regex and prefix findings below 15 are dropped; no score -> no finding.
    # Kept as a flag: a filter here would be pushed below this projection and
    # re-evaluate the whole confidence expression inside the predicate.
    # Made of the expression, not of the column: what a projection has twice is
    # compiled as a method of its own, and the JVM compiles no method above 8,000 bytes.
    keep = conf.isNotNull() & ((F.col("ev") >= EV_DECODED) | (conf >= SUPPRESS_BELOW))
    return staged.select(
        "doc_id", "doc_hash", F.col("filename").alias("file"), F.col("line_num").alias("line"), "ev", "key",
        rule.alias("rule"), category.alias("category"), conf.alias("confidence"),
        tx.clip_match(raw_match).alias("match"), fix.alias("fix"), source.alias("source"), keep.alias("keep"))


def rows_where(df: DataFrame, flag: str) -> DataFrame:
    """The rows whose column ``flag`` holds, without it.

    A filter would be pushed below the projection that makes the flag and evaluate
    all that the flag is made of once more (the entropy once for each use); one on
    the generated column stays where it is.
    """
    row = F.struct(*[c for c in df.columns if c != flag])
    made = df.select(F.when(F.col(flag), F.array(row)).alias("rows"))  # in the explode itself it would be interpreted
    return made.select(F.explode_outer("rows").alias("row")).where(F.col("row").isNotNull()).select("row.*")


def suppress_low(scored: DataFrame) -> DataFrame:
    """C7 as a filter (for callers that do not de-duplicate next)."""
    return rows_where(scored, "keep")


def dedup_findings(scored: DataFrame) -> DataFrame:
    """C7 + C9: first kept finding per (doc, line, rule) in merge order.

    Dropped rows sort after kept ones, so "drop, then keep the first" is one
    window followed by a filter that cannot be pushed below it.
    """
    w = Window.partitionBy("doc_id", "doc_hash", "line", "rule").orderBy(F.desc("keep"), "key")
    return (scored.withColumn("_rn", F.row_number().over(w))
            .where((F.col("_rn") == 1) & F.col("keep")).drop("_rn", "keep"))


def rank_findings(findings: DataFrame) -> DataFrame:
    """Per document, confidence descending; ties keep insertion order."""
    w = Window.partitionBy("doc_id", "doc_hash").orderBy(F.desc("confidence"), F.asc("key"))
    return findings.withColumn("rank", F.row_number().over(w).cast("int"))


def with_severity(findings: DataFrame) -> DataFrame:
    return findings.withColumn("severity", tx.severity(F.col("confidence")))
