"""Independent DuckDB formulation of every stage, for the correctness gate.

The SQL is written from the detection semantics by other routes than the
Spark plan: rules are one UNION ALL branch each instead of an unrolled
array, neighbour keywords are a window over line rows instead of array
arithmetic, the decode chain is one CTE per layer, prefixes are a theta
join, grouping uses ``string_agg ... ORDER BY``.  Only the fixed tables
(rules, prefixes, word lists, formats) are shared with the Spark side.
"""

from __future__ import annotations

from ..functions import text as tx
from ..functions.dialect import SPACE_CHARS, re2, sql_str
from ..operators import candidates as cd
from ..operators import decode as dc
from ..operators import reconstruct as rc
from ..operators.score import (DECODED_ENTROPY_BASE, DECODED_MIN_LEN, RECON_ENTROPY_BASE,
                               RECON_MIN_LEN, SUPPRESS_BELOW)
from ..operators.tables import PREFIXES, RULES
from ..sources.tables import corpus_sql

S = "[" + SPACE_CHARS + "]"
LB = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def q(s: str) -> str:
    return sql_str(s)


def any_contains(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def entropy(v: str) -> str:
    return f"round(coalesce(list_aggregate(string_split({v}, ''), 'entropy'), 0.0), 9)"


def placeholder(v: str) -> str:
    low = f"trim(lower({v}), '''\" ')"
    words = ", ".join(q(w) for w in tx.PLACEHOLDER_WORDS)
    return (f"({low} IN ({words}) OR regexp_matches({low}, '^[x*#<>]{{4,}}\\n?$')"
            f" OR regexp_matches({v}, '^\\$\\{{.+\\}}\\n?$') OR regexp_matches({v}, '^%\\(.+\\)s\\n?$')"
            f" OR regexp_matches({v}, '^\\{{\\{{.+\\}}\\}}\\n?$')"
            f" OR starts_with({v}, '${{') OR starts_with({v}, '#{{') OR starts_with({v}, '%(')"
            f" OR regexp_matches({v}, {q(tx.VALUE_ENV_REFERENCE)}))")


def known_prefix(v: str) -> str:
    return "(" + " OR ".join(f"starts_with({v}, {q(p.prefix)})" for p in PREFIXES) + ")"


def severity(c: str) -> str:
    return (f"(CASE WHEN {c} >= 90 THEN 'CRITICAL' WHEN {c} >= 70 THEN 'HIGH' WHEN {c} >= 50 THEN 'MEDIUM'"
            f" WHEN {c} >= 30 THEN 'LOW' ELSE 'INFO' END)")


def clip(v: str) -> str:
    return f"(CASE WHEN length({v}) > 80 THEN concat(substr({v}, 1, 40), '...', right({v}, 20)) ELSE {v} END)"


def mask(v: str) -> str:
    return (f"(CASE WHEN length({v}) <= 8 THEN repeat('*', length({v})) "
            f"ELSE concat(substr({v}, 1, 4), repeat('*', length({v}) - 8), right({v}, 4)) END)")


def printable(v: str) -> str:
    return f"NOT regexp_matches({v}, '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{P}}\\p{{S}} ]')"


def b64(v: str) -> str:
    padded = f"concat({v}, repeat('=', (4 - length({v}) % 4) % 4))"
    dec = f"try(decode(from_base64({padded})))"
    return (f"(CASE WHEN length({v}) >= 12 AND regexp_matches({v}, '^[A-Za-z0-9+/=_-]+$') "
            f"AND regexp_matches({padded}, '^[A-Za-z0-9+/]*={{0,2}}$') THEN "
            f"list_transform([{dec}], lambda d: CASE WHEN {printable('d')} AND length(d) >= 6 THEN d END)[1] END)")


def unhex_text(v: str) -> str:
    dec = f"try(decode(unhex({v})))"
    return (f"(CASE WHEN length({v}) >= 16 AND length({v}) % 2 = 0 AND regexp_matches({v}, '^[0-9a-fA-F]+$') THEN "
            f"list_transform([{dec}], lambda d: CASE WHEN {printable('d')} AND length(d) >= 8 THEN d END)[1] END)")


def urldec(v: str) -> str:
    return (f"(CASE WHEN contains({v}, '%') THEN list_transform([try(url_decode({v}))], "
            f"lambda d: CASE WHEN d <> {v} AND length(d) >= 6 THEN d END)[1] END)")


def decode_options(v: str) -> str:
    return (f"list_filter([{{'enc': 0, 'name': 'base64', 'd': {b64(v)}}}, "
            f"{{'enc': 1, 'name': 'hex', 'd': {unhex_text(v)}}}, {{'enc': 2, 'name': 'url', 'd': {urldec(v)}}}], "
            f"lambda o: o.d IS NOT NULL AND o.d <> {v})")


def code_point(hexdigits: str) -> str:
    cp = f"TRY_CAST('0x' || {hexdigits} AS BIGINT)"
    return f"(CASE WHEN {cp} BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(TRY_CAST({cp} AS INTEGER)) END)"


def latin1(v: str) -> str:
    """The UTF-8 bytes of a text read as Latin-1."""
    return (f"array_to_string(list_transform(range(length(hex(encode({v}))) // 2), "
            f"lambda i: chr(TRY_CAST('0x' || substr(hex(encode({v})), 2 * i::INTEGER + 1, 2) AS INTEGER))), '')")


def normalize(raw: str, compat: bool = False) -> str:
    """N2 -> N3 -> N4; ``compat`` reads what is no escape as Latin-1."""
    plain = latin1("t") if compat else "t"
    whole = f"CASE WHEN regexp_matches({raw}, '[^\\x00-\\x7f]') THEN {latin1(raw)} ELSE {raw} END" if compat else raw
    tok = r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]*\}|[0-7]{1,3}|(?s:.))|\\|[^\\]+"
    k = "substr(t, 2, 1)"
    octal = ("(CASE length(t) WHEN 2 THEN ascii(substr(t,2,1)) - 48 "
             "WHEN 3 THEN (ascii(substr(t,2,1)) - 48) * 8 + ascii(substr(t,3,1)) - 48 "
             "ELSE (ascii(substr(t,2,1)) - 48) * 64 + (ascii(substr(t,3,1)) - 48) * 8 + ascii(substr(t,4,1)) - 48 END)")
    simple = " ".join(f"WHEN {k} = {q(a)} THEN {q(b)}" for a, b in
                      (("\\", "\\"), ("'", "'"), ('"', '"'), ("n", "\n"), ("t", "\t"), ("r", "\r")))
    simple += " WHEN " + k + " = 'a' THEN chr(7) WHEN " + k + " = 'b' THEN chr(8) WHEN " + k + \
              " = 'f' THEN chr(12) WHEN " + k + " = 'v' THEN chr(11)"
    dec_tok = (f"CASE WHEN substr(t, 1, 1) <> '\\' THEN {plain} "
               f"WHEN {k} = 'x' AND length(t) = 4 THEN {code_point('substr(t, 3, 2)')} "
               f"WHEN {k} = 'u' AND length(t) = 6 THEN {code_point('substr(t, 3, 4)')} "
               f"WHEN {k} = 'U' AND length(t) = 10 THEN {code_point('substr(t, 3, 8)')} "
               f"WHEN regexp_matches({k}, '^[0-7]$') THEN chr(TRY_CAST({octal} AS INTEGER)) "
               f"{simple} ELSE {plain} END")
    bad = (f"t = '\\' OR ({k} IN ('x', 'u', 'U', 'N') AND length(t) = 2) OR "
           f"({k} = 'U' AND length(t) = 10 AND coalesce(TRY_CAST('0x' || substr(t, 3, 8) AS BIGINT), 0) > 1114111)")
    toks = f"regexp_extract_all({raw}, {q(tok)})"
    n2 = (f"(CASE WHEN contains({raw}, '\\') THEN list_transform([{toks}], lambda ts: "
          f"CASE WHEN coalesce(list_bool_or(list_transform(ts, lambda t: {bad})), false) THEN {raw} "
          f"ELSE array_to_string(list_transform(ts, lambda t: {dec_tok}), '') END)[1] ELSE {whole} END)")
    tok3 = r"\\x[0-9a-fA-F]{2}|[^\\]+|\\"
    n3 = (f"list_transform([{n2}], lambda s: CASE WHEN contains(s, '\\x') THEN array_to_string(list_transform("
          f"regexp_extract_all(s, {q(tok3)}), lambda t: CASE WHEN regexp_matches(t, '^\\\\x[0-9a-fA-F]{{2}}$') "
          f"THEN {code_point('substr(t, 3, 2)')} ELSE t END), '') ELSE s END)[1]")
    return f"translate({n3}, {q(tx.CONFUSABLES_FROM)}, {q(tx.CONFUSABLES_TO)})"


def rules_values() -> str:
    rows = []
    for i, r in enumerate(RULES, 1):
        rows.append(f"({i}, {q(r.name)}, {q(r.category)}, {r.base_score}, {str(r.needs_entropy).upper()}, "
                    f"{str(r.skip_test).upper()}, {q(r.file_pattern) if r.file_pattern else 'NULL'}, "
                    f"{str(r.captures).upper()}, {q(r.fix)})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(rule_id, rule, category, base_score, "
            "needs_entropy, skip_test, file_pattern, captures, fix)")


def prefixes_values() -> str:
    rows = [f"({i}, {q(p.prefix)}, {q(p.provider)}, {q(p.type)}, {p.length}, {p.score})"
            for i, p in enumerate(PREFIXES, 1)]
    return ("SELECT * FROM (VALUES " + ", ".join(rows) +
            ") AS t(ord, prefix, provider, type, expected_length, base_score)")


def rule_branch(i: int, r) -> str:
    pat = q(re2(r.pattern, True))
    cond = ["l.nonblank"]
    if r.skip_test:
        cond.append("NOT l.is_test")
    if r.file_pattern:
        cond.append(f"regexp_matches(l.filename, {q(r.file_pattern)})")
    g = 1 if r.captures else 0
    return (f"SELECT l.doc_id, l.line_num, {i} AS rule_id, regexp_extract_all(l.line, {pat}, 0) AS whole, "
            f"regexp_extract_all(l.line, {pat}, {g}) AS secrets FROM lines l WHERE {' AND '.join(cond)}")


def _ctes(source: str = "corpus", compat: bool = False) -> dict[str, str]:
    kwn = any_contains("lower(raw_line)", tx.NEARBY_WORDS) + "::INT"
    comment = re2(r"^{S}*(?://|#|\*|/\*|<!--|--|REM {S}*{NS})")
    c = {}
    c["corpus"] = corpus_sql()
    c["split"] = (f"SELECT doc_id, coalesce(filename, 'unknown') AS filename, string_split_regex(coalesce(text, ''), {q(LB)}) AS p0 FROM {source}")
    c["raw_lines"] = ("SELECT doc_id, filename, unnest(range(1, len(p) + 1))::INTEGER AS line_num, unnest(p) AS raw_line "
                      "FROM (SELECT doc_id, filename, CASE WHEN p0[len(p0)] = '' THEN p0[1:len(p0) - 1] ELSE p0 END AS p "
                      "FROM split)")
    c["lines"] = (
        f"SELECT doc_id, filename, {any_contains('lower(filename)', tx.TEST_FILE_MARKERS)} AS is_test, line_num, raw_line, "
        f"line, (coalesce(sum(kwn) OVER (PARTITION BY doc_id ORDER BY line_num ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) - kwn)::INTEGER AS nearby, "
        f"regexp_matches(line, {q(comment)}) AS is_comment, regexp_matches(line, {q('[^' + SPACE_CHARS + ']')}) AS nonblank, "
        f"regexp_matches(line, {q('[^' + SPACE_CHARS + ']')}) AND NOT regexp_matches(line, {q(comment)}) AS is_code, "
        f"{any_contains('lower(line)', tx.SENSITIVE_WORDS)} AS kw, regexp_matches(line, {q(tx.ENV_REFERENCE)}) AS env_ref, "
        f"{any_contains('lower(line)', tx.LINE_NOISE_WORDS)} AS noise, {any_contains('lower(line)', tx.PREFIX_NOISE_WORDS)} AS pnoise "
        f"FROM (SELECT *, {normalize('raw_line', compat)} AS line, {kwn} AS kwn FROM raw_lines)")
    c["rules_t"] = rules_values()
    c["prefixes_t"] = prefixes_values()
    c["rmatch"] = " UNION ALL ".join(rule_branch(i, r) for i, r in enumerate(RULES, 1))
    c["rhits"] = (f"SELECT doc_id, line_num, rule_id, secrets[idx] AS secret, whole[idx] AS match FROM ("
                  f"SELECT *, list_position(list_transform(secrets, lambda s: NOT {placeholder('s')}), true) AS idx "
                  f"FROM rmatch) WHERE idx IS NOT NULL")
    # candidates (V1-V4) on code lines
    v1, v2 = q(re2(cd.QUOTED_TOKEN_SPEC)), q(re2(cd.ASSIGNED_TOKEN_SPEC))
    v3, v4 = q(re2(cd.QUOTED_VALUE_SPEC)), q(re2(cd.ASSIGNED_VALUE_SPEC))
    c["v1"] = (f"SELECT doc_id, line_num, unnest(range(len(m)))::INTEGER AS pos, unnest(m) AS value FROM "
               f"(SELECT doc_id, line_num, regexp_extract_all(line, {v1}, 1) AS m FROM lines WHERE is_code)")
    c["v2"] = (f"SELECT doc_id, line_num, value FROM (SELECT doc_id, line_num, regexp_extract(line, {v2}, 1) AS value "
               f"FROM lines WHERE is_code) WHERE value <> ''")
    c["v3"] = (f"SELECT doc_id, line_num, unnest(range(len(m)))::INTEGER AS pos, unnest(m) AS value FROM "
               f"(SELECT doc_id, line_num, regexp_extract_all(line, {v3}, 1) AS m FROM lines WHERE is_code)")
    c["v4"] = (f"SELECT doc_id, line_num, value FROM (SELECT doc_id, line_num, regexp_extract(line, {v4}, 1) AS value "
               f"FROM lines WHERE is_code) WHERE value <> ''")
    c["rawvals"] = ("SELECT doc_id, line_num, pos, value FROM v1 UNION ALL "
                    "SELECT v2.doc_id, v2.line_num, coalesce(n.n, 0)::INTEGER AS pos, v2.value FROM v2 "
                    "LEFT JOIN (SELECT doc_id, line_num, count(*) AS n FROM v1 GROUP BY ALL) n USING (doc_id, line_num) "
                    "WHERE NOT EXISTS (SELECT 1 FROM v1 WHERE v1.doc_id = v2.doc_id AND v1.line_num = v2.line_num "
                    "AND v1.value = v2.value)")
    # decode chain, one CTE per layer
    c["l1"] = ("SELECT doc_id, line_num, pos, [o.enc] AS path, value AS original, o.d AS decoded, o.name AS encoding "
               f"FROM (SELECT *, unnest({decode_options('value')}) AS o FROM rawvals)")
    c["l2"] = ("SELECT doc_id, line_num, pos, list_append(path, o.enc) AS path, decoded AS original, o.d AS decoded, "
               f"concat(encoding, '→', o.name) AS encoding FROM (SELECT *, unnest({decode_options('decoded')}) AS o "
               "FROM l1 WHERE length(decoded) >= 8)")
    jt = q(dc.JSON_TOKEN)
    c["l2j"] = ("SELECT doc_id, line_num, pos, list_concat(path, [j + 3, o.enc]) AS path, t AS original, o.d AS decoded, "
                "concat(encoding, '→json_extract→', o.name) AS encoding FROM ("
                f"SELECT *, unnest({decode_options('t')}) AS o FROM ("
                f"SELECT doc_id, line_num, pos, path, encoding, unnest(range(len(ts)))::INTEGER AS j, unnest(ts) AS t FROM ("
                f"SELECT *, regexp_extract_all(decoded, {jt}, 1) AS ts FROM l1 "
                "WHERE (starts_with(decoded, '{') OR starts_with(decoded, '[')) AND length(decoded) >= 8)))")
    c["l3"] = ("SELECT doc_id, line_num, pos, list_append(path, o.enc) AS path, decoded AS original, o.d AS decoded, "
               f"concat(encoding, '→', o.name) AS encoding FROM (SELECT *, unnest({decode_options('decoded')}) AS o "
               "FROM l2 WHERE length(decoded) >= 8)")
    c["chain"] = "SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l2j UNION ALL SELECT * FROM l3"
    d6, d7 = q(re2(dc.CMD_BASE64_SUBSHELL[4:])), q(re2(dc.CMD_BASE64_BACKTICK[4:]))
    d8, d9 = q(re2(dc.CMD_REVERSE[4:])), q(re2(dc.CMD_ECHO[4:]))
    c["cmd_x"] = (f"SELECT doc_id, line_num, regexp_extract(line, {d6}, 1) AS x6, regexp_extract(line, {d7}, 1) AS x7, "
                  f"regexp_extract(line, {d8}, 1) AS x8, regexp_extract(line, {d9}, 1) AS x9 FROM lines")
    c["cmd"] = (
        f"SELECT doc_id, line_num, 0 AS pos, x6 AS original, {b64('x6')} AS decoded, 'cmd:base64_decode' AS encoding "
        f"FROM cmd_x WHERE x6 <> '' AND {b64('x6')} IS NOT NULL UNION ALL "
        f"SELECT doc_id, line_num, 1, x7, {b64('x7')}, 'cmd:base64_decode' FROM cmd_x WHERE x7 <> '' AND {b64('x7')} IS NOT NULL "
        f"UNION ALL SELECT doc_id, line_num, 2, x8, reverse(x8), 'cmd:reverse' FROM cmd_x WHERE x8 <> '' AND "
        f"({known_prefix('reverse(x8)')} OR {entropy('reverse(x8)')} > 4.0) "
        f"UNION ALL SELECT doc_id, line_num, 3, x9, x9, 'cmd:echo' FROM cmd_x WHERE x9 <> '' AND {known_prefix('x9')}")
    # reconstruction
    cc, sp, ap = q(re2(rc.CONCAT[4:])), q(re2(rc.SPLIT_PART[4:])), q(re2(rc.ARRAY_PART[4:]))
    c["r1"] = (f"SELECT doc_id, line_num, g1, concat(g1, CASE WHEN g2 <> '' THEN g2 ELSE concat('<', g3, '>') END) AS value "
               f"FROM (SELECT doc_id, line_num, regexp_extract(line, {cc}, 1) AS g1, regexp_extract(line, {cc}, 2) AS g2, "
               f"regexp_extract(line, {cc}, 3) AS g3 FROM lines) WHERE g1 <> '' AND {known_prefix('g1')}")
    c["parts"] = (f"SELECT doc_id, line_num, 2 AS kind, regexp_extract(line, {sp}, 1) AS name, regexp_extract(line, {sp}, 2) AS idx, "
                  f"regexp_extract(line, {sp}, 3) AS value FROM lines WHERE regexp_extract(line, {sp}, 1) <> '' UNION ALL "
                  f"SELECT doc_id, line_num, 3, regexp_extract(line, {ap}, 1), regexp_extract(line, {ap}, 2), "
                  f"regexp_extract(line, {ap}, 3) FROM lines WHERE regexp_extract(line, {ap}, 1) <> ''")
    order = "length(ltrim(idx, '0')), ltrim(idx, '0'), line_num"
    c["groups"] = ("SELECT * FROM (SELECT doc_id, kind, name, min(line_num)::INTEGER AS first_seen, "
                   f"(list(line_num ORDER BY {order}))[1]::INTEGER AS line_num, string_agg(value, '' ORDER BY {order}) AS value, "
                   "count(*) AS n FROM parts GROUP BY doc_id, kind, name) WHERE n >= 2 AND "
                   f"({known_prefix('value')} OR (kind = 2 AND {entropy('value')} > 4.0) OR (kind = 3 AND {entropy('value')} > 3.5))")
    # all candidate values of the prefix stage (P3) with their order key
    c["pcands"] = (
        "SELECT doc_id, line_num, 0 AS grp, line_num AS ln, 0 AS sub, pos, []::INTEGER[] AS path, value, 'quoted' AS src FROM v3 "
        "UNION ALL SELECT doc_id, line_num, 0, line_num, 1, 0, []::INTEGER[], value, 'unquoted' FROM v4 "
        "UNION ALL SELECT doc_id, line_num, 1, line_num, 0, pos, path, decoded, 'decoded:' || encoding FROM chain "
        "UNION ALL SELECT doc_id, line_num, 2, line_num, 0, pos, []::INTEGER[], decoded, 'decoded:' || encoding FROM cmd "
        "UNION ALL SELECT doc_id, line_num, 3, line_num, 0, 0, []::INTEGER[], value, 'reconstructed:string_concat' FROM r1 "
        "UNION ALL SELECT doc_id, line_num, kind + 2, first_seen, 0, 0, []::INTEGER[], value, "
        "CASE WHEN kind = 2 THEN 'reconstructed:split_assignment' ELSE 'reconstructed:array_split' END FROM groups")
    c["ppairs"] = ("SELECT c.*, p.ord, p.provider, p.type, p.expected_length, p.base_score FROM pcands c "
                   "JOIN prefixes_t p ON starts_with(c.value, p.prefix)")
    c["phits"] = ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line_num, ord "
                  "ORDER BY grp, ln, sub, pos, path) AS rn FROM ppairs) WHERE rn = 1")
    return c


def _scoring_ctes() -> dict[str, str]:
    c = {}
    e = "e"
    regex_conf = (
        "base_score + (CASE WHEN e >= 5.0 AND n >= 32 THEN 20 WHEN e >= 5.0 THEN 15 WHEN e >= 4.5 AND n >= 20 THEN 12 "
        "WHEN e >= 4.5 THEN 10 WHEN e >= 4.0 THEN 5 WHEN e < 2.5 AND needs_entropy THEN -20 ELSE 0 END) "
        "+ (CASE WHEN n >= 40 THEN 10 WHEN n >= 24 THEN 5 WHEN n < 8 AND needs_entropy THEN -15 ELSE 0 END) "
        "+ (CASE WHEN n >= 16 AND len(list_distinct(string_split(secret, ''))) <= 3 THEN -50 "
        "WHEN n >= 16 AND e < 2.0 THEN -35 ELSE 0 END) "
        "+ (CASE WHEN starts_with(secret, '0123456789') OR starts_with(secret, 'abcdefghij') "
        "OR starts_with(secret, 'ABCDEFGHIJ') THEN -15 ELSE 0 END) "
        "+ (CASE WHEN regexp_matches(secret, '^[a-z]+\\n?$') AND e < 3.5 THEN -20 ELSE 0 END) "
        "+ (CASE WHEN regexp_matches(secret, '^[0-9]+\\n?$') AND e < 3.0 THEN -25 ELSE 0 END) "
        "+ (CASE WHEN kw THEN 10 ELSE 0 END) + (CASE WHEN is_test THEN -25 ELSE 0 END) "
        f"+ (CASE WHEN {placeholder('secret')} THEN -40 ELSE 0 END) + (CASE WHEN is_comment THEN -20 ELSE 0 END) "
        "+ (CASE WHEN env_ref THEN -30 ELSE 0 END) + (CASE WHEN noise THEN -20 ELSE 0 END) "
        "+ (CASE WHEN nearby >= 2 THEN 5 ELSE 0 END) + (CASE WHEN e >= 4.5 AND kw AND NOT is_test THEN 5 ELSE 0 END)")
    c["rscored"] = (
        f"SELECT h.doc_id, h.line_num, h.rule_id, greatest(0, least(100, {regex_conf}))::INTEGER AS confidence, "
        "r.rule, r.category, r.fix, h.match, h.secret, l.filename FROM ("
        f"SELECT *, {entropy('secret')} AS e, length(secret) AS n FROM rhits) h JOIN rules_t r USING (rule_id) "
        "JOIN lines l USING (doc_id, line_num)")
    c["pscored"] = (
        "SELECT p.doc_id, p.line_num, p.grp, p.ln, p.sub, p.pos, p.path, p.ord, p.value, p.src, p.provider, p.type, "
        "greatest(0, least(100, p.base_score + (CASE WHEN l.is_test THEN -25 ELSE 0 END) "
        f"+ (CASE WHEN {placeholder('p.value')} THEN -40 ELSE 0 END) + (CASE WHEN l.pnoise THEN -20 ELSE 0 END) "
        f"+ (CASE WHEN {entropy('p.value')} >= 4.5 THEN 10 WHEN {entropy('p.value')} < 3.0 AND p.base_score < 90 THEN -15 ELSE 0 END) "
        "+ (CASE WHEN length(p.value) < p.expected_length * 0.5 THEN -20 ELSE 0 END)))::INTEGER AS confidence, l.filename "
        "FROM phits p JOIN lines l USING (doc_id, line_num)")
    first_p = ("(SELECT min(ord) FROM prefixes_t WHERE starts_with(x.decoded, prefix))")
    c["dvals"] = ("SELECT doc_id, line_num, 1 AS grp, pos, path, original, decoded, encoding FROM chain UNION ALL "
                  "SELECT doc_id, line_num, 2, pos, []::INTEGER[], original, decoded, encoding FROM cmd")
    c["dscored"] = (
        "SELECT x.doc_id, x.line_num, x.grp, x.pos, x.path, x.encoding, l.filename, "
        "CASE WHEN p.ord IS NOT NULL THEN least(100, p.base_score + 5) "
        f"WHEN {entropy('x.decoded')} >= 4.0 AND length(x.decoded) >= {DECODED_MIN_LEN} THEN "
        f"least(100, {DECODED_ENTROPY_BASE} + floor({entropy('x.decoded')} * 5)::INTEGER) END AS confidence, "
        "CASE WHEN p.ord IS NOT NULL THEN concat(p.provider, ' ', p.type, ' (', x.encoding, ' encoded)') "
        "ELSE concat('High-entropy ', x.encoding, '-decoded value') END AS rule, "
        "CASE WHEN p.ord IS NOT NULL THEN concat('[', x.encoding, '] ', substr(x.original, 1, 30), '... → ', substr(x.decoded, 1, 30), '...') "
        "ELSE concat('[', x.encoding, '] → ', substr(x.decoded, 1, 40)) END AS raw_match, "
        "CASE WHEN p.ord IS NOT NULL THEN concat('Found ', x.encoding, '-encoded ', p.provider, ' key. Encoding is not security.') "
        "ELSE concat('This ', x.encoding, '-encoded value decodes to a suspicious string. Review it.') END AS fix "
        f"FROM (SELECT *, {first_p} AS ford FROM dvals x) x LEFT JOIN prefixes_t p ON p.ord = x.ford "
        "JOIN lines l USING (doc_id, line_num)")
    c["rvals"] = ("SELECT doc_id, line_num, 3 AS grp, line_num AS ln, value, 'string_concat' AS method FROM r1 UNION ALL "
                  "SELECT doc_id, line_num, kind + 2, first_seen, value, "
                  "CASE WHEN kind = 2 THEN 'split_assignment' ELSE 'array_split' END FROM groups")
    first_r = "(SELECT min(ord) FROM prefixes_t WHERE starts_with(x.value, prefix))"
    c["cscored"] = (
        "SELECT x.doc_id, x.line_num, x.grp, x.ln, x.method, l.filename, "
        "CASE WHEN p.ord IS NOT NULL THEN least(100, p.base_score + 5) "
        f"WHEN {entropy('x.value')} >= 4.0 AND length(x.value) >= {RECON_MIN_LEN} THEN "
        f"least(100, {RECON_ENTROPY_BASE} + floor({entropy('x.value')} * 5)::INTEGER) END AS confidence, "
        "CASE WHEN p.ord IS NOT NULL THEN concat(p.provider, ' ', p.type, ' (reconstructed via ', x.method, ')') "
        "ELSE concat('High-entropy reconstructed value (', x.method, ')') END AS rule, "
        "concat('[', x.method, '] ', x.value) AS raw_match, "
        "CASE WHEN p.ord IS NOT NULL THEN concat('Found split/concatenated ', p.provider, ' key. Splitting doesn''t hide secrets.') "
        "ELSE 'Reconstructed value has high entropy. Review if it''s a secret.' END AS fix "
        f"FROM (SELECT *, {first_r} AS ford FROM rvals x) x LEFT JOIN prefixes_t p ON p.ord = x.ford "
        "JOIN lines l USING (doc_id, line_num)")
    c["merged"] = (
        f"SELECT doc_id, filename AS file, line_num AS line, rule, category, confidence, {clip('match')} AS match, fix, "
        "'regex' AS source, 0 AS phase, 0 AS grp, line_num AS ln, rule_id AS sub, 0 AS pos, []::INTEGER[] AS path, 0 AS pord "
        f"FROM rscored WHERE confidence >= {SUPPRESS_BELOW} UNION ALL "
        f"SELECT doc_id, filename, line_num, concat(provider, ' ', type), 'prefix', confidence, {clip('value')}, "
        "concat('Detected ', provider, ' ', type, '. Store in env vars or secrets manager.'), "
        "CASE WHEN src IN ('quoted', 'unquoted') THEN concat('prefix:', provider) ELSE concat('prefix:', provider, '(', src, ')') END, "
        f"1, grp, ln, sub, pos, path, ord FROM pscored WHERE confidence >= {SUPPRESS_BELOW} UNION ALL "
        f"SELECT doc_id, filename, line_num, rule, 'decoded', confidence, {clip('raw_match')}, fix, 'decoded:' || encoding, "
        "2, grp, line_num, 0, pos, path, 0 FROM dscored WHERE confidence IS NOT NULL UNION ALL "
        f"SELECT doc_id, filename, line_num, rule, 'reconstructed', confidence, {clip('raw_match')}, fix, "
        "'reconstructed:' || method, 3, grp, ln, 0, 0, []::INTEGER[], 0 FROM cscored WHERE confidence IS NOT NULL")
    c["deduped"] = ("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line, rule "
                    "ORDER BY phase, grp, ln, sub, pos, path, pord) AS rn FROM merged) WHERE rn = 1")
    c["ranked"] = (f"SELECT doc_id, file, line, rule, category, {severity('confidence')} AS severity, confidence, match, fix, "
                   "source, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, phase, grp, ln, sub, pos, path, pord)::INTEGER AS rank "
                   "FROM deduped")
    return c


def with_ctes(select: str, source_sql: str | None = None, latin1: bool = False) -> str:
    """Prefix ``select`` with every CTE it needs (unused ones are pruned by DuckDB)."""
    c = _ctes(compat=latin1)
    c.update(_scoring_ctes())
    if source_sql is not None:
        c["corpus"] = source_sql
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in c.items()) + "\n" + select
