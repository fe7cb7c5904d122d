"""Registered queries: one per operator of the inventory, Spark side + SQL oracle.

Every query reads the given tables (``documents`` and the planted corpus
derived from ``orders``; ``pages``/``conversations`` for S1), over their
whole content.  Keys start with the inventory ID.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import candidates as cd
from ..operators.lines import lines as line_table
from ..operators.lines import split_lines
from ..functions.codecs import is_printable
from ..operators.report import (VERDICT_REST, VERDICTS, check_entropy, clean_docs, corpus_report, corpus_summary,
                                file_report, rank_corpus, split_confirmed)
from ..operators.rules import add_rule_matches, match_rules_join
from ..operators.score import (EV_DECODED, EV_PREFIX, EV_RECON, EV_REGEX, SUPPRESS_BELOW, dedup_findings, prefix_confidence, regex_confidence, rows_where,
                               score_evidence, suppress_low)
from ..operators.tables import PREFIXES, prefix_table, rule_table
from ..session import checkpoint_dir
from ..sources import files
from ..sources.planted import planted_sql
from ..sources.tables import conversations, conversations_sql, corpus, corpus_sql, documents, pages, pages_sql, planted_slices, planted_table
from . import oracle as O
from .scan import (FAMILIES, K_CAND, K_DECODED, K_RECON, K_REGEX, VALUES, bearing, evidence, fold_parts, line_items,
                   prefix_dedup, scan, scan_files)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


# ---------------------------------------------------------------- building blocks
def _lines(spark, sf, nearby=True):
    return line_table(corpus(spark, sf), nearby=nearby)


def _items(spark, sf, *families):
    """Item rows of some families; the plan holds nothing of the others."""
    return line_items(_lines(spark, sf), families=families or FAMILIES)


def _values(spark, sf):
    """Items that the prefix table is matched with, split values joined."""
    return fold_parts(_items(spark, sf, *VALUES))


def _regex_evidence(spark, sf):
    return evidence(_items(spark, sf, "rules"))


def _scored(spark, sf, *families, ev=None):
    """Scored evidence (of one kind) after C7 (suppressed rows removed)."""
    items = bearing(_items(spark, sf, *families))
    found = prefix_dedup(evidence(fold_parts(items) if "parts" in (families or FAMILIES) else items))
    return suppress_low(score_evidence(found if ev is None else found.where(F.col("ev") == ev)))


def _path_str(c):
    return F.array_join(c, ".")


W = O.with_ctes


def _cand_values(spark, sf, *kinds):
    """Candidate values of some kinds; the plan holds nothing of the others."""
    return cd.candidate_rows(_lines(spark, sf, nearby=False), kinds or tuple(cd.KINDS))


CAND_SQL = ("SELECT doc_id, line_num, 'quoted_token' AS kind, pos, value FROM v1 UNION ALL "
            "SELECT doc_id, line_num, 'assigned_token', 0, value FROM v2 UNION ALL "
            "SELECT doc_id, line_num, 'quoted_value', pos, value FROM v3 UNION ALL "
            "SELECT doc_id, line_num, 'assigned_value', 0, value FROM v4")


# ---------------------------------------------------------------- N, M: lines and scalars
@register("N1_split_lines", W("SELECT doc_id, line_num, raw_line FROM raw_lines"))
def q_split_lines(spark, sf):
    return split_lines(corpus(spark, sf))


@register("M1_shannon_entropy", W(f"SELECT doc_id, line_num, kind, pos, value, round({O.entropy('value')}, 6) AS entropy "
                                  f"FROM ({CAND_SQL})"))
def q_entropy(spark, sf):
    c = _cand_values(spark, sf)
    return c.select("*", F.round(tx.entropy(F.col("value")), 6).alias("entropy"))


@register("M2_is_placeholder", W(f"SELECT doc_id, line_num, kind, pos, value, {O.placeholder('value')} AS is_placeholder "
                                 f"FROM ({CAND_SQL})"))
def q_placeholder(spark, sf):
    return _cand_values(spark, sf).select("*", tx.is_placeholder(F.col("value")).alias("is_placeholder"))


@register("M3_mask", W(f"SELECT doc_id, line_num, kind, pos, {O.mask('value')} AS masked FROM ({CAND_SQL})"))
def q_mask(spark, sf):
    return _cand_values(spark, sf).select("doc_id", "line_num", "kind", "pos", tx.mask(F.col("value")).alias("masked"))


@register("M4_clip_match", W(f"SELECT doc_id, line_num, kind, pos, {O.clip('value')} AS clipped FROM ({CAND_SQL})"))
def q_clip(spark, sf):
    return _cand_values(spark, sf).select("doc_id", "line_num", "kind", "pos", tx.clip_match(F.col("value")).alias("clipped"))


@register("M5_severity", W(f"SELECT confidence, {O.severity('confidence')} AS severity, count(*) AS n FROM rscored GROUP BY confidence"))
def q_severity(spark, sf):
    ev = q_score_regex(spark, sf)
    return ev.groupBy("confidence").agg(F.count("*").alias("n")).select(
        "confidence", tx.severity(F.col("confidence")).alias("severity"), "n")


@register("M6_line_keywords", W("SELECT doc_id, line_num FROM lines WHERE kw"))
def q_keywords(spark, sf):
    return _lines(spark, sf).where("kw").select("doc_id", "line_num")


@register("N5_flag_test_file", W(f"SELECT doc_id, filename, {O.any_contains('lower(filename)', tx.TEST_FILE_MARKERS)} AS is_test FROM corpus"))
def q_test_file(spark, sf):
    return corpus(spark, sf).select("doc_id", "filename", tx.is_test_file(F.col("filename")).alias("is_test"))


@register("N6_flag_comment", W("SELECT doc_id, line_num FROM lines WHERE is_comment"))
def q_comment(spark, sf):
    return _lines(spark, sf).where("is_comment").select("doc_id", "line_num")


@register("N7_filter_blank", W("SELECT doc_id, count(*) FILTER (WHERE nonblank) AS nonblank_lines, "
                               "count(*) FILTER (WHERE NOT nonblank) AS blank_lines FROM lines GROUP BY doc_id"))
def q_blank(spark, sf):
    return _lines(spark, sf).groupBy("doc_id").agg(F.count_if("nonblank").alias("nonblank_lines"),
                                                   F.count_if(~F.col("nonblank")).alias("blank_lines"))


@register("N2_decode_escapes", W(f"SELECT doc_id, line_num, line FROM lines WHERE contains(raw_line, '\\')"))
def q_escapes(spark, sf):
    return _lines(spark, sf).where(F.col("raw_line").contains("\\")).select("doc_id", "line_num", "line")


@register("N3_decode_hex_escapes", W("SELECT doc_id, line_num, line FROM lines WHERE contains(raw_line, '\\x')"))
def q_hex_escapes(spark, sf):
    return _lines(spark, sf).where(F.col("raw_line").contains("\\x")).select("doc_id", "line_num", "line")


@register("N4_map_confusables", W("SELECT doc_id, line_num, line FROM lines WHERE regexp_matches(raw_line, "
                                  f"{O.q('[' + tx.CONFUSABLES_FROM + ']')})"))
def q_confusables(spark, sf):
    return (_lines(spark, sf).where(F.col("raw_line").rlike("[" + tx.CONFUSABLES_FROM + "]"))
            .select("doc_id", "line_num", "line"))


# ---------------------------------------------------------------- X: rules
@register("X1_rule_table", W("SELECT r.rule_id, rule, category, base_score, needs_entropy, skip_test, file_pattern, captures, fix, "
                             "count(h.doc_id) AS hits, count(DISTINCT h.doc_id) AS docs FROM rules_t r LEFT JOIN rhits h USING (rule_id) GROUP BY ALL"))
def q_rule_table(spark, sf):
    """The rule table with what each rule hits in the corpus."""
    h = _items(spark, sf, "rules").groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("docs"))
    return rule_table(spark).drop("pattern").join(h, "rule_id", "left").fillna(0, ["hits", "docs"])


def _rule_matches(spark, sf):
    """(doc_id, line_num, rule_id, whole, secrets) of every (line, rule) with a match."""
    m = add_rule_matches(_lines(spark, sf)).select("doc_id", "line_num", F.explode_outer("rule_matches").alias("m")).where(F.col("m").isNotNull())
    return m.select("doc_id", "line_num", "m.rule_id", "m.whole", "m.secrets")


@register("X2_rule_match", W("SELECT doc_id, line_num, rule_id, len(whole)::INTEGER AS matches FROM rmatch WHERE len(whole) > 0"))
def q_rule_match(spark, sf):
    return _rule_matches(spark, sf).select("doc_id", "line_num", "rule_id", F.size("secrets").cast("int").alias("matches"))


@register("X3_skip_test_rules", W("SELECT h.rule_id, count(*) AS hits_in_test_files FROM rhits h JOIN lines l USING (doc_id, line_num) "
                                  "WHERE l.is_test GROUP BY h.rule_id"))
def q_skip_test(spark, sf):
    h = _items(spark, sf, "rules").where("is_test")
    return h.groupBy("rule_id").agg(F.count("*").alias("hits_in_test_files"))


@register("X4_file_pattern_rules", W("SELECT h.doc_id, l.filename, h.line_num, h.rule_id FROM rhits h JOIN lines l USING (doc_id, line_num) "
                                     "WHERE h.rule_id IN (41, 42)"))
def q_file_pattern(spark, sf):
    return (_items(spark, sf, "rules").where(F.col("rule_id").isin(41, 42))
            .select("doc_id", "filename", "line_num", "rule_id"))


@register("X5_secret_value", W("SELECT doc_id, line_num, rule_id, unnest(range(len(whole)))::INTEGER AS pos, unnest(whole) AS match, "
                               "unnest(secrets) AS secret FROM rmatch"))
def q_secret_value(spark, sf):
    r = _rule_matches(spark, sf)
    z = r.select("doc_id", "line_num", "rule_id", F.posexplode_outer(F.arrays_zip("whole", "secrets")).alias("pos", "z"))
    return z.where(F.col("z").isNotNull()).select("doc_id", "line_num", "rule_id", F.col("pos").cast("int").alias("pos"),
                                                  F.col("z.whole").alias("match"), F.col("z.secrets").alias("secret"))


@register("X6_drop_placeholders", W(f"SELECT * FROM (SELECT doc_id, line_num, rule_id, unnest(secrets) AS secret FROM rmatch) "
                                    f"WHERE {O.placeholder('secret')}"))
def q_drop_placeholders(spark, sf):
    r = _rule_matches(spark, sf)
    s = r.select("doc_id", "line_num", "rule_id", F.explode_outer("secrets").alias("secret")).where(F.col("secret").isNotNull())
    return s.where(tx.is_placeholder(F.col("secret")))


@register("X2_rule_match_table", W("SELECT doc_id, line_num, rule_id, unnest(whole) AS match FROM rmatch"))
def q_rule_match_table(spark, sf):
    """X2 with the rules read from a table (the path for user-supplied rules)."""
    return match_rules_join(_lines(spark, sf), rule_table(spark))


@register("N2_decode_escapes_latin1", W("SELECT doc_id, line_num, line FROM lines WHERE contains(raw_line, '\\') "
                                        "OR regexp_matches(raw_line, '[^\\x00-\\x7f]')", latin1=True))
def q_escapes_latin1(spark, sf):
    """N2 with latin1_compat=True (non-ASCII lines read as Latin-1 bytes)."""
    ls = line_table(corpus(spark, sf), latin1_compat=True)
    return ls.where(F.col("raw_line").contains("\\") | F.col("raw_line").rlike("[^\\x00-\\x7f]")).select(
        "doc_id", "line_num", "line")


@register("X7_first_per_line_rule", W("SELECT doc_id, line_num, rule_id, match, secret FROM rhits"))
def q_first_per_line(spark, sf):
    return (_items(spark, sf, "rules")
            .select("doc_id", "line_num", "rule_id", F.col("text").alias("match"), F.col("value").alias("secret")))


@register("X_rule_hits_by_rule", W("SELECT rule_id, rule, count(h.doc_id) AS hits FROM rules_t LEFT JOIN rhits h USING (rule_id) "
                                   "GROUP BY rule_id, rule"))
def q_hits_by_rule(spark, sf):
    h = _items(spark, sf, "rules").groupBy("rule_id").agg(F.count("*").alias("hits"))
    return (rule_table(spark).select("rule_id", "rule").join(h, "rule_id", "left")
            .select("rule_id", "rule", F.coalesce("hits", F.lit(0)).alias("hits")))


# ---------------------------------------------------------------- C1, C2, C7
@register("C1_score_regex", W("SELECT doc_id, line_num, rule_id, confidence FROM rscored"))
def q_score_regex(spark, sf):
    ev = _regex_evidence(spark, sf)
    e = ev.select("*", tx.entropy(F.col("value")).alias("_e"))
    return e.select("doc_id", "line_num", "rule_id", regex_confidence(
        F.col("value"), F.col("_e"), F.col("rule_id"), F.col("is_test"), F.col("kw"), F.col("is_comment"),
        F.col("env_ref"), F.col("noise"), F.col("nearby")).cast("int").alias("confidence"))


@register("C2_nearby_lines", W("SELECT doc_id, line_num, nearby FROM lines WHERE nearby > 0"))
def q_nearby(spark, sf):
    return _lines(spark, sf).where("nearby > 0").select("doc_id", "line_num", "nearby")


@register("C2_nearby_lines_window", W("SELECT doc_id, line_num, nearby FROM lines WHERE nearby > 0"))
def q_nearby_window(spark, sf):
    """Same result as C2 through a window over line rows (shuffles on doc_id)."""
    from pyspark.sql import Window
    ls = split_lines(corpus(spark, sf)).select("doc_id", "line_num", tx.has_nearby_word(F.col("raw_line")).cast("int").alias("k"))
    w = Window.partitionBy("doc_id").orderBy("line_num").rowsBetween(-2, 2)
    out = ls.select("doc_id", "line_num", (F.sum("k").over(w) - F.col("k")).cast("int").alias("nearby"))
    return out.where("nearby > 0")


@register("C7_suppress_low", W(f"SELECT doc_id, line_num, rule_id, confidence FROM rscored WHERE confidence < {O.SUPPRESS_BELOW}"))
def q_suppress(spark, sf):
    return rows_where(q_score_regex(spark, sf).withColumn("low", F.col("confidence") < SUPPRESS_BELOW), "low")


# ---------------------------------------------------------------- P, V: prefixes and candidates
def _prefix_rows(c):
    """(value, p): the prefix rows of each value, matched once a value (an inner explode matches again to drop values without any)."""
    m = c.select("value", tx.matching_prefixes(F.col("value")).alias("ps"))
    return m.select("value", F.explode_outer("ps").alias("p")).where(F.col("p").isNotNull())


@register("P1_prefix_table", W("SELECT p.ord, prefix, provider, type, expected_length, base_score, count(c.value) AS hits, "
                               "coalesce(max(length(c.value)), 0)::INTEGER AS longest FROM prefixes_t p LEFT JOIN pcands c "
                               "ON starts_with(c.value, p.prefix) GROUP BY ALL"))
def q_prefix_table(spark, sf):
    """The prefix table with how many candidate values of the corpus begin so."""
    m = _prefix_rows(_pcands(spark, sf)).groupBy(F.col("p.ord").alias("ord")) \
        .agg(F.count(F.lit(1)).alias("hits"), F.max(F.length("value")).alias("longest"))
    return prefix_table(spark).join(m, "ord", "left").fillna(0, ["hits", "longest"])


@register("V5_code_line_filter", W("SELECT doc_id, count(*) FILTER (WHERE is_code) AS code_lines, "
                                   "count(*) FILTER (WHERE NOT is_code) AS skipped_lines FROM lines GROUP BY doc_id"))
def q_code_lines(spark, sf):
    return _lines(spark, sf).groupBy("doc_id").agg(F.count_if("is_code").alias("code_lines"),
                                                   F.count_if(~F.col("is_code")).alias("skipped_lines"))


@register("V1_quoted_tokens", W("SELECT doc_id, line_num, pos, value FROM v1"))
def q_v1(spark, sf):
    return _cand_values(spark, sf, "quoted_token").select("doc_id", "line_num", "pos", "value")


@register("V2_assigned_token", W("SELECT doc_id, line_num, value FROM v2"))
def q_v2(spark, sf):
    return _cand_values(spark, sf, "assigned_token").select("doc_id", "line_num", "value")


@register("V3_quoted_values", W("SELECT doc_id, line_num, pos, value FROM v3"))
def q_v3(spark, sf):
    return _cand_values(spark, sf, "quoted_value").select("doc_id", "line_num", "pos", "value")


@register("V4_assigned_value", W("SELECT doc_id, line_num, value FROM v4"))
def q_v4(spark, sf):
    return _cand_values(spark, sf, "assigned_value").select("doc_id", "line_num", "value")


def _pcands(spark, sf, known=False):
    """Values that the prefix table is matched with; if only ``known`` ones count, candidates without a prefix are left out (by their first characters) before values are joined."""
    it = fold_parts(bearing(_items(spark, sf, *VALUES))) if known else _values(spark, sf)
    src = (F.when(F.col("kind") == K_CAND, F.col("label"))
           .when(F.col("kind") == K_DECODED, F.concat(F.lit("decoded:"), F.col("label")))
           .otherwise(F.concat(F.lit("reconstructed:"), F.col("label"))))
    return it.select("doc_id", "line_num", "grp", "ln", "sub", "pos", "path", "value", src.alias("src"))


@register("P3_prefix_candidates", W("SELECT doc_id, line_num, grp, ln, sub, pos, array_to_string(path, '.') AS path, value, src FROM pcands"))
def q_pcands(spark, sf):
    return _pcands(spark, sf).withColumn("path", _path_str(F.col("path")))


@register("P4_prefix_join", W("SELECT doc_id, line_num, grp, ln, sub, pos, array_to_string(path, '.') AS path, ord FROM ppairs"))
def q_prefix_join(spark, sf):
    """Candidate values x prefix table: broadcast equi-join on the value's leading substrings."""
    c = _pcands(spark, sf)
    p = prefix_table(spark)
    lengths = sorted({len(x.prefix) for x in PREFIXES})   # 2..9: one leading substring per length
    heads = c.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.substring("value", 1, n).alias("head")) for n in lengths])).alias("h"))
    j = heads.join(F.broadcast(p), (F.col("h.head") == p["prefix"]) & (F.col("h.n") == F.length(p["prefix"])), "inner")
    return j.select("doc_id", "line_num", "grp", "ln", "sub", "pos", _path_str(F.col("path")).alias("path"), "ord")


@register("P5_prefix_dedup", W("SELECT doc_id, line_num, ord, value, src FROM phits"))
def q_prefix_dedup(spark, sf):
    ev = prefix_dedup(evidence(fold_parts(bearing(_items(spark, sf, *VALUES))))).where(F.col("ev") == EV_PREFIX)
    src = (F.when(F.col("key.grp") == 0, F.col("label"))
           .when(F.col("key.grp") <= 2, F.concat(F.lit("decoded:"), F.col("label")))
           .otherwise(F.concat(F.lit("reconstructed:"), F.col("label"))))
    return ev.select("doc_id", "line_num", F.col("pord").alias("ord"), "value", src.alias("src"))


@register("P6_first_prefix", W(f"SELECT doc_id, line_num, kind, pos, value, "
                               f"(SELECT min(ord) FROM prefixes_t WHERE starts_with(value, prefix)) AS first_ord "
                               f"FROM ({CAND_SQL}) WHERE {O.known_prefix('value')}"))
def q_first_prefix(spark, sf):
    c = _cand_values(spark, sf)
    return c.select("*", tx.first_prefix(F.col("value"))["ord"].alias("first_ord")).where(F.col("first_ord").isNotNull())


@register("P2_has_known_prefix", W("SELECT p.ord, p.prefix, count(c.value) AS hits FROM prefixes_t p LEFT JOIN pcands c "
                                   "ON starts_with(c.value, p.prefix) GROUP BY p.ord, p.prefix"))
def q_has_prefix(spark, sf):
    c = _pcands(spark, sf, known=True).where(tx.has_known_prefix(F.col("value")))
    m = _prefix_rows(c).groupBy(F.col("p.ord").alias("ord")).count()
    return (prefix_table(spark).select("ord", "prefix").join(m, "ord", "left")
            .select("ord", "prefix", F.coalesce(F.col("count"), F.lit(0)).alias("hits")))


# ---------------------------------------------------------------- D: decoding
def _decoded(spark, sf, family):
    return (_items(spark, sf, family)
            .select("doc_id", "line_num", "pos", _path_str(F.col("path")).alias("path"),
                    F.col("text").alias("original"), F.col("value").alias("decoded"), F.col("label").alias("encoding")))


CHAIN_SQL = "SELECT doc_id, line_num, pos, array_to_string(path, '.') AS path, original, decoded, encoding FROM chain"


@register("D4_decode_chain", W(CHAIN_SQL))
def q_chain(spark, sf):
    return _decoded(spark, sf, "chain")


@register("D5_extract_json_tokens", W(CHAIN_SQL + " WHERE contains(encoding, 'json_extract')"))
def q_json(spark, sf):
    return _decoded(spark, sf, "chain").where(F.col("encoding").contains("json_extract"))


for _key, _enc in (("D1_decode_base64", "base64"), ("D2_decode_hex", "hex"), ("D3_decode_url", "url")):
    def _mk(enc):
        def fn(spark, sf):
            return _decoded(spark, sf, "chain").where(F.col("encoding") == enc).select("doc_id", "line_num", "pos", "original", "decoded")
        return fn
    register(_key, W(f"SELECT doc_id, line_num, pos, original, decoded FROM chain WHERE encoding = '{_enc}'"))(_mk(_enc))


@register("D10_printable_filter", W(f"SELECT doc_id, line_num FROM lines WHERE NOT {O.printable('line')}"))
def q_printable(spark, sf):
    return _lines(spark, sf).where(~is_printable(F.col("line"))).select("doc_id", "line_num")


for _key, _pos in (("D6_cmd_base64_subshell", 0), ("D7_cmd_base64_backtick", 1), ("D8_cmd_reverse", 2), ("D9_cmd_echo", 3)):
    def _mkc(pos):
        def fn(spark, sf):
            return _decoded(spark, sf, "commands").where(F.col("pos") == pos).select("doc_id", "line_num", "original", "decoded", "encoding")
        return fn
    register(_key, W(f"SELECT doc_id, line_num, original, decoded, encoding FROM cmd WHERE pos = {_pos}"))(_mkc(_pos))


# ---------------------------------------------------------------- R: reconstruction
@register("R1_concat_literals", W("SELECT doc_id, line_num, value, g1 AS prefix FROM r1"))
def q_concat(spark, sf):
    return _items(spark, sf, "concat").select("doc_id", "line_num", "value", F.col("text").alias("prefix"))


def _joined(spark, sf, grp):
    g = fold_parts(_items(spark, sf, "parts")).where(F.col("grp") == grp)
    return g.select("doc_id", "line_num", F.col("ln").alias("first_seen"), "value", F.col("text").alias("prefix"))


@register("R2_split_assignments", W("SELECT doc_id, line_num, first_seen, value, substr(value, 1, 10) AS prefix FROM groups WHERE kind = 2"))
def q_split(spark, sf):
    return _joined(spark, sf, 4)


@register("R3_array_parts", W("SELECT doc_id, line_num, first_seen, value, substr(value, 1, 10) AS prefix FROM groups WHERE kind = 3"))
def q_array(spark, sf):
    return _joined(spark, sf, 5)


# ---------------------------------------------------------------- C3-C11: merge and rank
@register("C3_score_prefix", W("SELECT doc_id, line_num, ord, confidence FROM pscored"))
def q_score_prefix(spark, sf):
    ev = prefix_dedup(evidence(fold_parts(bearing(_items(spark, sf, *VALUES))))).where(F.col("ev") == EV_PREFIX)
    e = ev.select("*", tx.entropy(F.col("value")).alias("_e"))
    return e.select("doc_id", "line_num", F.col("pord").alias("ord"), prefix_confidence(
        F.col("value"), F.col("_e"), F.col("pscore"), F.col("plen"), F.col("is_test"), F.col("pnoise")).cast("int").alias("confidence"))


FIND_COLS = "doc_id, file, line, rule, category, confidence, match, fix, source"


@register("C4_label_prefix", W(f"SELECT {FIND_COLS} FROM merged WHERE phase = 1"))
def q_label_prefix(spark, sf):
    return _scored(spark, sf, *VALUES, ev=EV_PREFIX).select(*FIND_COLS.split(", "))


@register("C5_score_decoded", W(f"SELECT {FIND_COLS} FROM merged WHERE phase = 2"))
def q_score_decoded(spark, sf):
    return _scored(spark, sf, "chain", "commands", ev=EV_DECODED).select(*FIND_COLS.split(", "))


@register("C6_score_reconstructed", W(f"SELECT {FIND_COLS} FROM merged WHERE phase = 3"))
def q_score_recon(spark, sf):
    return _scored(spark, sf, "concat", "parts", ev=EV_RECON).select(*FIND_COLS.split(", "))


@register("C8_merge_findings", W(f"SELECT {FIND_COLS} FROM merged"))
def q_merge(spark, sf):
    return _scored(spark, sf).select(*FIND_COLS.split(", "))


@register("C9_dedup_findings", W(f"SELECT {FIND_COLS} FROM deduped"))
def q_dedup(spark, sf):
    return dedup_findings(score_evidence(prefix_dedup(evidence(fold_parts(bearing(_items(spark, sf))))))).select(*FIND_COLS.split(", "))


@register("C10_rank_findings", W("SELECT doc_id, file, line, rule, category, severity, confidence, match, fix, source, rank FROM ranked"))
def q_rank(spark, sf):
    return scan(corpus(spark, sf)).drop("doc_hash")


@register("C10_user_tables", W("SELECT doc_id, file, line, rule, category, severity, confidence, match, fix, source, rank FROM ranked"))
def q_user_tables(spark, sf):
    """The scan with its rules and prefixes read from tables."""
    return scan(corpus(spark, sf), rules=rule_table(spark), prefixes=prefix_table(spark)).drop("doc_hash")


# ---------------------------------------------------------------- flagship and S1
@register("S1_scan_table", W("SELECT doc_id, file, line, rule, category, severity, confidence, match, fix, source, rank FROM ranked",
                             source_sql="SELECT concat('document/', cast(doc_id as varchar)) AS doc_id, source AS filename, text FROM documents "
                                        f"UNION ALL {pages_sql()} UNION ALL {conversations_sql()}"))
def q_scan_table(spark, sf):
    """Three tables with ids of their own in one scan."""
    docs = documents(spark, sf).withColumn("doc_id", F.concat(F.lit("document/"), F.col("doc_id").cast("string")))
    return scan(docs.unionByName(pages(spark, sf)).unionByName(conversations(spark, sf))).drop("doc_hash")


# ---------------------------------------------------------------- C11, E: reports
def _findings(spark, sf):
    return scan(corpus(spark, sf))


RANKED = "SELECT doc_id, file, line, rule, category, severity, confidence, match, fix, source, rank FROM ranked"


@register("C11_rank_corpus", W("SELECT doc_id, file, line, rule, confidence, row_number() OVER "
                               "(ORDER BY confidence DESC, file, doc_id, rank) AS corpus_rank FROM ranked"))
def q_rank_corpus(spark, sf):
    # the numbering writes the rows down with all their columns
    shown = _findings(spark, sf).select("doc_id", "doc_hash", "file", "line", "rule", "confidence", "rank")
    return rank_corpus(shown).select("doc_id", "file", "line", "rule", "confidence", "corpus_rank")


_E1_SQL = ("SELECT doc_id, line_num, kind, pos, round(e, 6) AS entropy, length(value)::INTEGER AS length, score, "
           f"{O.severity('score')} AS severity, "
           "(SELECT concat(provider, ' ', type) FROM prefixes_t WHERE ord = (SELECT min(ord) FROM prefixes_t "
           "WHERE starts_with(value, prefix))) AS prefix_match, "
           f"{O.mask('value')} AS masked, CASE " + " ".join(f"WHEN score >= {cut} THEN {O.q(t)}" for cut, t in VERDICTS) +
           f" ELSE {O.q(VERDICT_REST)} END AS verdict "
           "FROM (SELECT *, (CASE WHEN e >= 5.0 AND length(value) >= 32 THEN 95 WHEN e >= 4.5 AND length(value) >= 24 THEN 80 "
           "WHEN e >= 4.0 AND length(value) >= 16 THEN 60 WHEN e >= 3.5 AND length(value) >= 12 THEN 40 "
           "WHEN e >= 3.0 THEN 20 ELSE 5 END)::INTEGER AS score FROM (SELECT *, "
           f"{O.entropy('value')} AS e FROM ({CAND_SQL})))")


@register("E1_check_entropy", W(_E1_SQL))
def q_check_entropy(spark, sf):
    return check_entropy(_cand_values(spark, sf))


@register("E2_split_confirmed", W("SELECT doc_id, count(*) FILTER (WHERE category <> 'candidate') AS confirmed, "
                                  "count(*) FILTER (WHERE category = 'candidate') AS candidates FROM ranked GROUP BY doc_id"))
def q_split_confirmed(spark, sf):
    return split_confirmed(_findings(spark, sf)).drop("doc_hash")


_SECTION = "CASE WHEN category = 'candidate' THEN 'candidates' ELSE 'confirmed' END"


@register("E3_file_report", W(f"SELECT doc_id, section, row_number() OVER (PARTITION BY doc_id, section ORDER BY rank)::INTEGER AS n, "
                              "severity, confidence, file, line, source, rule, match, fix FROM "
                              f"(SELECT *, {_SECTION} AS section FROM ranked)"))
def q_file_report(spark, sf):
    return file_report(_findings(spark, sf)).drop("doc_hash")


@register("E4_corpus_report", W(f"SELECT section, row_number() OVER (PARTITION BY section ORDER BY confidence DESC, file, doc_id, rank) AS n, "
                                "severity, confidence, file, doc_id, line, source, rule, match, fix FROM "
                                f"(SELECT *, {_SECTION} AS section FROM ranked)"))
def q_corpus_report(spark, sf):
    return corpus_report(_findings(spark, sf)).drop("doc_hash")


@register("E4_corpus_summary", W("SELECT (SELECT count(DISTINCT doc_id) FROM corpus) AS files_scanned, "
                                 "count(*) FILTER (WHERE category <> 'candidate') AS confirmed, "
                                 "count(*) FILTER (WHERE category = 'candidate') AS candidates FROM ranked"))
def q_corpus_summary(spark, sf):
    return corpus_summary(corpus(spark, sf), _findings(spark, sf))


@register("E5_clean_docs", W("SELECT doc_id, filename FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM ranked)"))
def q_clean_docs(spark, sf):
    return clean_docs(corpus(spark, sf), _findings(spark, sf))


# ---------------------------------------------------------------- E: ids that repeat or are missing
#: Four documents share an id, every fifth has none.
_SHARED = "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id {div} 4 END"
_SHARED_SQL = _SHARED.format(div="//")
# rows equal in id, name and text are one document
_SHARED_DOCS = f"SELECT min(doc_id) AS doc_id, filename, text FROM ({corpus_sql()}) GROUP BY {_SHARED_SQL}, filename, text"


def _shared(spark, sf):
    """The corpus with ids that repeat or are NULL."""
    return corpus(spark, sf).withColumn("doc_id", F.expr(_SHARED.format(div="div")))


def _shown(df):
    """Results with -1 where there is no id: clients differ in how they show whole numbers beside NULLs."""
    return df.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


_SHOWN_SQL = f"coalesce({_SHARED_SQL}, -1)"


@register("E2_split_confirmed_shared_ids", W(f"SELECT {_SHOWN_SQL} AS doc_id, count(*) FILTER (WHERE category <> 'candidate') AS confirmed, "
                                             "count(*) FILTER (WHERE category = 'candidate') AS candidates FROM ranked GROUP BY ranked.doc_id", source_sql=_SHARED_DOCS))
def q_split_shared(spark, sf):
    return _shown(split_confirmed(scan(_shared(spark, sf))).drop("doc_hash"))


@register("E3_file_report_shared_ids", W(f"SELECT {_SHOWN_SQL} AS doc_id, section, row_number() OVER (PARTITION BY s.doc_id, section ORDER BY rank)::INTEGER AS n, "
                                         "severity, confidence, file, line, source, rule, match, fix FROM "
                                         f"(SELECT *, {_SECTION} AS section FROM ranked) s", source_sql=_SHARED_DOCS))
def q_file_report_shared(spark, sf):
    return _shown(file_report(scan(_shared(spark, sf))).drop("doc_hash"))


@register("E4_corpus_report_shared_ids", W("SELECT section, confidence, file, min(n) AS first, max(n) AS last, count(*) AS rows FROM "
                                           "(SELECT *, row_number() OVER (PARTITION BY section ORDER BY confidence DESC, file) AS n FROM "
                                           f"(SELECT *, {_SECTION} AS section FROM ranked)) GROUP BY section, confidence, file", source_sql=_SHARED_DOCS))
def q_corpus_report_shared(spark, sf):
    """Where each file name's findings of one confidence stand in the corpus report."""
    return corpus_report(scan(_shared(spark, sf))).groupBy("section", "confidence", "file") \
        .agg(F.min("n").alias("first"), F.max("n").alias("last"), F.count(F.lit(1)).alias("rows"))


@register("E4_corpus_summary_shared_ids", W("SELECT (SELECT count(*) FROM corpus) AS files_scanned, "
                                            "count(*) FILTER (WHERE category <> 'candidate') AS confirmed, "
                                            "count(*) FILTER (WHERE category = 'candidate') AS candidates FROM ranked", source_sql=_SHARED_DOCS))
def q_corpus_summary_shared(spark, sf):
    return corpus_summary(_shared(spark, sf), scan(_shared(spark, sf)))


@register("E5_clean_docs_shared_ids", W(f"SELECT {_SHOWN_SQL} AS doc_id, filename FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM ranked)", source_sql=_SHARED_DOCS))
def q_clean_docs_shared(spark, sf):
    return _shown(clean_docs(_shared(spark, sf), scan(_shared(spark, sf))))


# ---------------------------------------------------------------- S2-S7: directory trees
_PLANTED_PATHS = f"SELECT doc_id, path, text FROM ({planted_sql()})"
_BASENAME = "regexp_extract(path, '([^/]*)$', 1)"
_EXT = f"regexp_extract({_BASENAME}, '^\\.*[^.].*(\\.[^.]*)$', 1)"
_DIRS = "string_split(path, '/')"
_SKIPPED = f"list_has_any({_DIRS}[1:len({_DIRS}) - 1], [" + ", ".join(O.q(d) for d in files.SKIP_DIRS) + "])"
_BINARY = f"lower({_EXT}) IN (" + ", ".join(O.q(e) for e in files.BINARY_EXTS) + ")"
_KEPT = f"SELECT path AS doc_id, {_BASENAME} AS filename, text FROM ({_PLANTED_PATHS}) WHERE NOT {_SKIPPED} AND NOT {_BINARY}"
S4_EXTENSIONS = ".py,java"


@register("S3_filter_skip_dirs", W(f"SELECT doc_id, path, {_SKIPPED} AS skipped FROM ({_PLANTED_PATHS})"))
def q_skip_dirs(spark, sf):
    return planted_table(spark, sf).select("doc_id", "path", files.in_skipped_dir(F.col("path")).alias("skipped"))


@register("S4_filter_extensions", W(f"SELECT doc_id, path, (ends_with({_BASENAME}, '.java') OR ends_with({_BASENAME}, '.py')) AS kept "
                                    f"FROM ({_PLANTED_PATHS})"))
def q_extensions(spark, sf):
    return planted_table(spark, sf).select("doc_id", "path", files.has_extension(files.basename(F.col("path")), S4_EXTENSIONS).alias("kept"))


@register("S5_filter_binary_ext", W(f"SELECT doc_id, path, {_EXT} AS ext, {_BINARY} AS is_binary FROM ({_PLANTED_PATHS})"))
def q_binary(spark, sf):
    return planted_table(spark, sf).select("doc_id", "path", files.extension(F.col("path")).alias("ext"),
                                           files.is_binary(F.col("path")).alias("is_binary"))


_TREES: dict[tuple[str, str], DataFrame] = {}


def _tree(spark, sf):
    """The planted corpus written as files and read back through the directory walk, a slice at a time, once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TREES:
        base = checkpoint_dir(spark).rstrip("/") + f"/tree-{uuid.uuid4().hex}"
        files.delete_on_exit(spark, base)
        _TREES[key] = files.through_tree(planted_slices(spark, sf), base)
    return _TREES[key]


@register("S7_files_scanned", W(f"SELECT count(*) AS files_scanned FROM ({_KEPT})"))
def q_files_scanned(spark, sf):
    """Files kept by the directory walk of the planted tree."""
    return _tree(spark, sf).agg(F.count(F.lit(1)).alias("files_scanned"))


@register("S6_tolerant_read", W(f"SELECT doc_id AS file, length(text)::INTEGER AS chars, md5(text) AS digest FROM ({_KEPT})"))
def q_tolerant_read(spark, sf):
    """Planted tree read back: invalid UTF-8 bytes dropped, text otherwise unchanged."""
    return _tree(spark, sf).select("file", F.length("text").alias("chars"), F.md5("text").alias("digest"))


@register("S2_scan_corpus", W("SELECT doc_id, doc_id AS file, line, rule, category, severity, confidence, match, fix, source, rank FROM ranked", source_sql=_KEPT))
def q_scan_corpus(spark, sf):
    """Directory scan of the planted tree -> findings with relative paths."""
    return scan_files(_tree(spark, sf)).drop("doc_hash")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
