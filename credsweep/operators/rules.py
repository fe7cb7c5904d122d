"""Stage 5: rule matching (X2-X7) on normalized lines.

All rules are unrolled into one projection over the line rows: a gated
``regexp_extract_all`` per rule, the first match whose secret is not a
placeholder, and one array of hits per line.  Constant patterns are compiled
once per task; there is no join and no shuffle.  A user's rule table becomes the
same kind of projection (``rules_from_table``).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.dialect import java
from ..functions.reuse import once
from .tables import RULES, Rule

GATE_FOLD_FROM = "ſıİK"
GATE_FOLD_TO = "siik"


def pattern_of(rule: Rule) -> str:
    """The rule's Java pattern."""
    return rule.pattern if rule.java_pattern else java(rule.pattern, True)


def gate_text(line: Column) -> Column:
    """Lower-cased line for gate tests (folds the few characters that match
    ASCII letters case-insensitively but do not lower-case to them, none of
    which is ASCII)."""
    return F.when(F.octet_length(line) > F.length(line), F.lower(F.translate(line, GATE_FOLD_FROM, GATE_FOLD_TO))).otherwise(F.lower(line))


#: Characters that many gates hold: a line without one isn't searched for those gates.
GATE_MARKS = "_-:="


def gate_marks(low: Column) -> list[Column]:
    """``_mark<i>``: which of ``GATE_MARKS`` a gate text holds."""
    return [low.contains(c).alias(f"_mark{i}") for i, c in enumerate(GATE_MARKS)]


def gate_condition(rule: Rule, low: Column) -> Column:
    """Whether a gate text holds all literals of one of the rule's gates; needs the columns of ``gate_marks``."""
    if not rule.gate:
        return F.lit(True)
    out = None
    for alt in rule.gate:
        cond = None
        for lit in alt:
            c = low.contains(lit)
            mark = next((i for i, m in enumerate(GATE_MARKS) if m in lit), None)
            c = c if mark is None else F.col(f"_mark{mark}") & c
            cond = c if cond is None else (cond & c)
        out = cond if out is None else (out | cond)
    return out


def rule_applies(rule: Rule, is_test: Column, filename: Column, nonblank: Column) -> Column:
    """X3/X4 plus the blank-line skip; a NULL file name or flag turns no rule off but those that need a name."""
    cond = nonblank
    if rule.skip_test:
        cond = cond & ~F.coalesce(is_test, F.lit(False))
    if rule.file_pattern:
        cond = cond & F.coalesce(filename.rlike(rule.file_pattern), F.lit(False))
    return cond


# ---------------------------------------------------------------- linear forms
# Three patterns take time quadratic in a line's length: many places where a match
# could begin, and from each of them a scan to the end.  The forms below give the
# same matches and try each stretch of the line once.

# JDBC: a match lies within one run without spaces and quotes, and there is at most
# one in it: from the first URL head to the last password.  So only the run's start
# is tried, and the head is found without going back.
JDBC_HEAD = r"jdbc:[a-z]+://"
JDBC_RUN = java(r"(?<![^{SC}'\"])(?>[^{SC}'\"]*?(?=" + JDBC_HEAD + r"))(" + JDBC_HEAD + r"[^{SC}'\"]*(?:password|pwd)=[^{SC}&'\"]+)", True)
# Firebase: the same between closing braces.
FIREBASE_HEAD = r"(?:firebase|firebaseConfig){S}*[=:]{S}*\{"
FIREBASE_RUN = java(r"(?<![^}])(?>[^}]*?(?=" + FIREBASE_HEAD + r"))(" + FIREBASE_HEAD + r"[^}]*apiKey{S}*:)", True)
URL_PIECE = r"[^@]*@|[^@]+\z"
MARK = "\ue000"


def credential_urls(line: Column, pattern: str) -> Column:
    """Matches of the URL rule: scheme, user, first colon, password, first ``@`` after it, host.

    All URLs whose first colon lies in the same piece between two ``@`` share the
    ``@`` that ends the piece.  If no host can follow that ``@``, none of them
    matches: their ``://`` is marked, so that the pattern doesn't scan for it from
    each.  Only the last colon of such a piece may begin a URL whose first colon
    comes later.
    """
    pieces = F.regexp_extract_all(line, F.lit("(?s)" + URL_PIECE), 0)
    after = F.slice(F.concat(pieces, F.array(F.lit(""))), 2, F.size(pieces))

    def marked(piece: Column, then: Column) -> Column:
        last = F.length(piece) - F.locate(":", F.reverse(piece))  # characters before the last colon
        host = piece.endswith("@") & then.rlike(java(r"^[^{SC}'\"]"))
        return F.when(host | ~piece.contains(":"), piece).otherwise(
            F.concat(F.replace(piece.substr(F.lit(1), last), F.lit("://"), F.lit(":" + MARK + "/")), piece.substr(last + 1, F.length(piece))))

    quick = F.transform(F.regexp_extract_all(F.array_join(F.zip_with(pieces, after, marked), ""), F.lit(pattern), 1),
                        lambda m: F.replace(m, F.lit(MARK), F.lit("/")))
    return F.when(line.contains(MARK), F.regexp_extract_all(line, F.lit(pattern), 1)).otherwise(quick)


#: Rules with a linear form; in all of them the secret is the whole match.
LINEAR = {
    "JDBC Connection with Password": lambda line, pattern: F.regexp_extract_all(line, F.lit(JDBC_RUN), 1),
    "URL with Embedded Credentials": credential_urls,
    "Firebase Config Inline": lambda line, pattern: F.regexp_extract_all(line, F.lit(FIREBASE_RUN), 1),
}


def all_matches(line: Column, rule: Rule, group: int) -> Column:
    """Every match of a rule in a line: whole (group 0) or its secret (group 1, or the whole where the rule has none)."""
    if rule in RULES and rule.name in LINEAR:
        return LINEAR[rule.name](line, pattern_of(rule))
    return F.regexp_extract_all(line, F.lit(pattern_of(rule)), group if rule.captures else 0)


def _staged_matches(df: DataFrame, rules, use_gates: bool) -> DataFrame:
    """Line rows with ``_m<i>``: the secrets of rule i's matches, NULL where the rule does not apply."""
    cols = df.columns
    staged = df.select("*", gate_text(F.col("line")).alias("_low")) if use_gates else df
    staged = staged.select("*", *gate_marks(F.col("_low"))) if use_gates else staged

    def matches(i: int, r: Rule) -> Column:
        cond = rule_applies(r, F.col("is_test"), F.col("filename"), F.col("nonblank"))
        if use_gates:
            cond = cond & gate_condition(r, F.col("_low"))
        return F.when(cond, all_matches(F.col("line"), r, 1)).alias(f"_m{i}")

    return staged.select(*cols, *once(("matches", tuple(rules), use_gates), lambda: [matches(i, r) for i, r in enumerate(rules, 1)]))


def add_rule_matches(df: DataFrame, rules=RULES, use_gates: bool = True, out: str = "rule_matches") -> DataFrame:
    """Adds ``out`` = array<struct<rule_id, whole, secrets>>, one element for each rule with a match in the line."""
    staged = _staged_matches(df, rules, use_gates)

    def found(i: int, r: Rule) -> Column:
        whole = all_matches(F.col("line"), r, 0) if r.captures else F.col(f"_m{i}")
        return F.when(F.size(f"_m{i}") > 0, F.struct(F.lit(i).alias("rule_id"), whole.alias("whole"), F.col(f"_m{i}").alias("secrets")))

    def every() -> Column:
        # lambda functions are interpreted with all that they hold: only lines with a match get to them, and the
        # array that they look through is a column of its own
        some = reduce(or_, [F.size(f"_m{i}") > 0 for i in range(1, len(rules) + 1)], F.lit(False))
        return F.when(some, F.array(*[found(i, r) for i, r in enumerate(rules, 1)])).alias("_every")

    all_rules = staged.select(*df.columns, once(("found", tuple(rules)), every))
    kept = F.when(F.col("_every").isNotNull(), F.filter("_every", lambda m: m.isNotNull())) \
        .otherwise(F.array().cast("array<struct<rule_id:int,whole:array<string>,secrets:array<string>>>"))
    return all_rules.select(*df.columns, kept.alias(out))


def add_rule_hits(df: DataFrame, rules=RULES, use_gates: bool = True, out: str = "regex_hits") -> DataFrame:
    """Adds ``out`` = array<struct<rule_id, match, secret>> to line rows.

    Needs columns line, is_test, filename, nonblank.  At most one hit per
    (line, rule): the first match whose secret value is not a placeholder.

    Built as projections (gate text, matches, matches of the rules that have
    any, hits).  Each intermediate column is referenced several times, so
    Catalyst keeps it materialized instead of re-evaluating it.  The
    placeholder test stands in the plan once, over the few rules with matches.
    """
    found = add_rule_matches(df, rules, use_gates, "_found")

    def kept() -> Column:
        placed = F.transform("_found", lambda m: F.struct(
            m["rule_id"].alias("rule_id"), m["whole"].alias("whole"), m["secrets"].alias("secrets"),
            F.array_position(F.transform(m["secrets"], lambda s: ~tx.is_placeholder(s)), True).cast("int").alias("at")))
        return F.when(F.size("_found") > 0, F.filter(placed, lambda m: m["at"] > 0)).alias("_kept")

    staged = found.select(*df.columns, once(("kept",), kept))
    hits = F.when(F.size("_kept") > 0, F.transform("_kept", lambda m: F.struct(
        m["rule_id"].alias("rule_id"), F.get(m["whole"], m["at"] - 1).alias("match"), F.get(m["secrets"], m["at"] - 1).alias("secret")))) \
        .otherwise(F.array().cast("array<struct<rule_id:int,match:string,secret:string>>"))
    return staged.select(*df.columns, hits.alias(out))


def rule_hits(lines: DataFrame, rules=RULES, use_gates: bool = True) -> DataFrame:
    """Regex hits as rows: (doc_id, line_num, rule_id, match, secret) + line features."""
    with_hits = add_rule_hits(lines, rules, use_gates)
    return (with_hits.select(*[c for c in lines.columns if c not in ("raw_line", "line")],
                             F.explode_outer("regex_hits").alias("h"))
            .where(F.col("h").isNotNull())
            .select("*", "h.rule_id", "h.match", "h.secret").drop("h"))


def rule_attr(attr: str, rule_id: Column, rules=RULES) -> Column:
    """Look up a rule attribute by 1-based id from a literal array."""
    return F.element_at(once(("attr", attr, tuple(rules)), lambda: F.array(*[F.lit(getattr(r, attr)) for r in rules])), rule_id)


def rules_from_table(rule_df: DataFrame) -> tuple[Rule, ...]:
    """Rules of a user's table (``rule_table`` shape, Java patterns), in the order of ``rule_id``.

    A rule table is configuration: its rows become the plan, as the built-in
    rules do, so lines are never joined with rules.  A built-in rule that comes
    back unchanged keeps its gate and its linear form.
    """
    own = {(r.name, pattern_of(r), r.skip_test, r.file_pattern, r.captures, r.score_fields()): r for r in RULES}
    out = []
    for t in sorted(rule_df.collect(), key=lambda t: t["rule_id"]):
        made = Rule(t["rule"], t["pattern"], t["base_score"], t["category"], t["fix"], bool(t["captures"]), bool(t["needs_entropy"]),
                    bool(t["skip_test"]), t["file_pattern"], java_pattern=True)
        out.append(own.get((made.name, made.pattern, made.skip_test, made.file_pattern, made.captures, made.score_fields()), made))
    return tuple(out)


def match_rules_join(lines: DataFrame, rule_df: DataFrame) -> DataFrame:
    """Every whole match of every rule of a user's table: (doc_id, line_num, rule_id, match)."""
    rules = rules_from_table(rule_df)
    found = add_rule_matches(lines, rules).select("doc_id", "line_num", F.explode_outer("rule_matches").alias("m")).where(F.col("m").isNotNull())
    ids = [t["rule_id"] for t in sorted(rule_df.select("rule_id").collect())]
    rule_id = F.element_at(F.array(*[F.lit(i) for i in ids]), F.col("m.rule_id"))
    rows = found.select("doc_id", "line_num", rule_id.alias("rule_id"), F.explode_outer("m.whole").alias("match"))
    return rows.where(F.col("match").isNotNull())
