"""End-to-end scan: documents -> ranked findings.

Plan shape (see README "Plan"):

1. narrow: split lines, per-document neighbour keywords (C2), normalize,
   line features; per line one projection computes rule hits, candidate
   values, the decode chain, command forms, concatenations and split-value
   parts -- only the families asked for; one ``explode`` turns them into
   ``items`` (only lines with something to report produce rows).
2. candidate values that begin as no prefix does are dropped: they give no evidence.
   One grouped aggregation over the items: those of one line stay together,
   and the parts of one split value, wherever its lines are, become one item.
   The text is read once, nothing runs while the plan is built.
3. evidence rows (regex, prefix, decoded, reconstructed) are dealt by document
   and line; the prefix de-dup and the finding de-dup are windows over that one
   partitioning; the rank is a window over a document's findings.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.reuse import once
from ..operators.candidates import assigned_token, assigned_value, prefix_line_candidates, quoted_tokens, quoted_values, raw_values
from ..operators.decode import add_decode_chain, cmd_decodes, cmd_matches
from ..operators.lines import lines as split_normalize
from ..operators.reconstruct import (METHODS, array_name, assignment_part, concat_literal, first_literal, keep_group, part_key,
                                     split_index, split_word, without_repeats)
from ..operators.rules import add_rule_hits, rules_from_table
from ..operators.score import (EV_DECODED, EV_PREFIX, EV_RECON, EV_REGEX, dedup_findings,
                               rank_findings, score_evidence, with_severity)
from ..operators.tables import PREFIXES, RULES, prefixes_from_table

FEATURES = ["kw", "env_ref", "noise", "pnoise", "is_comment", "nearby"]
ITEM = ("struct<kind:int,grp:int,ln:int,sub:int,pos:int,path:array<int>,"
        "value:string,text:string,label:string,rule_id:int>")
#: Characters of a joined value that are reported as its prefix.
HEAD = 10
K_REGEX, K_CAND, K_DECODED, K_RECON, K_PART = 1, 2, 3, 4, 5
# Order groups (grp) of the sequential detector's insertion order.
G_LINE_CAND, G_CHAIN, G_CMD, G_CONCAT, G_SPLIT, G_ARRAY = 0, 1, 2, 3, 4, 5
FINDING_COLUMNS = ["doc_id", "file", "line", "rule", "category", "severity", "confidence",
                   "match", "fix", "source", "rank"]
#: What reports group, join and sort by: an id may be repeated or NULL.
DOC_KEY = ["doc_id", "doc_hash"]
#: What evidence is dealt by.
LINE_KEY = [*DOC_KEY, "line_num"]


def _item(kind, grp, ln, sub, pos, path, value, text, label, rule_id=None) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(kind).cast("int").alias("kind"), lit(grp).cast("int").alias("grp"),
                    lit(ln).cast("int").alias("ln"), lit(sub).cast("int").alias("sub"),
                    lit(pos).cast("int").alias("pos"), path.alias("path"),
                    lit(value).cast("string").alias("value"), lit(text).cast("string").alias("text"),
                    lit(label).cast("string").alias("label"), lit(rule_id).cast("int").alias("rule_id"))


def _empty(t: str) -> Column:
    return F.array().cast(f"array<{t}>")


#: What ``line_items`` can report; a plan for some of them holds nothing of the others.
FAMILIES = ("rules", "candidates", "chain", "commands", "concat", "parts")
#: Families that the prefix table is matched with.
VALUES = ("candidates", "chain", "commands", "concat", "parts")
DOC = ["doc_id", "doc_hash", "filename", "is_test"]


def line_items(ls: DataFrame, rules=RULES, use_gates: bool = True, families=FAMILIES, prefixes=PREFIXES) -> DataFrame:
    """Per line: everything of the ``families`` that may become a finding, as item rows."""
    ln = F.col("line_num")
    line, code = F.col("line"), F.col("is_code")
    df = ls
    if "rules" in families:
        df = add_rule_hits(df, rules, use_gates)
    # What is used several times below is a column of its own, so each pattern runs once a line.
    seen = {"chain": lambda: [F.when(code, quoted_tokens(line)).alias("_v1"), F.when(code, assigned_token(line)).alias("_v2")],
            "candidates": lambda: [F.when(code, quoted_values(line)).alias("_v3"), F.when(code, assigned_value(line)).alias("_v4")],
            "commands": lambda: [x.alias(f"_x{i}") for i, x in enumerate(cmd_matches(line), 6)],
            "concat": lambda: [first_literal(line).alias("_g1")], "parts": lambda: [split_word(line).alias("_word"), array_name(line).alias("_array")]}
    df = df.select("*", *[c for f in seen if f in families for c in once(("seen", f), seen[f])])
    if "parts" in families:
        df = df.select("*", once(("index",), lambda: split_index(F.col("_word")).alias("_idx")))
    if "chain" in families:
        df = df.select("*", once(("raw",), lambda: raw_values(F.col("_v1"), F.col("_v2")).alias("_raw")))
        df = add_decode_chain(df, "_raw", "_chain")
    made = {"commands": lambda: cmd_decodes(*[F.col(f"_x{i}") for i in range(6, 10)], prefixes).alias("_cmd"), "candidates": lambda: prefix_line_candidates(F.col("_v3"), F.col("_v4")).alias("_pc"),
            "concat": lambda: concat_literal(line, F.col("_g1"), prefixes).alias("_r1"),
            "parts": lambda: assignment_part(line, F.col("_word"), F.col("_idx"), F.col("_array")).alias("_part")}
    df = df.select("*", *[once(("made", f, tuple(prefixes)), made[f]) for f in made if f in families])
    none = F.array().cast("array<int>")
    arrays = {
        "rules": lambda: F.transform("regex_hits", lambda h: _item(K_REGEX, 0, ln, h["rule_id"], 0, none, h["secret"],
                                                                   h["match"], None, h["rule_id"])),
        "candidates": lambda: F.coalesce(F.transform("_pc", lambda c: _item(
            K_CAND, G_LINE_CAND, ln, c["sub"], c["pos"], none, c["value"], None,
            F.when(c["sub"] == 0, "quoted").otherwise("unquoted"))), _empty(ITEM)),
        "chain": lambda: F.transform("_chain", lambda e: _item(K_DECODED, G_CHAIN, ln, 0, e["pos"], e["path"], e["decoded"],
                                                               e["original"], e["encoding"])),
        "commands": lambda: F.transform("_cmd", lambda e: _item(K_DECODED, G_CMD, ln, 0, e["pos"], none, e["decoded"],
                                                                e["original"], e["encoding"])),
        "concat": lambda: F.when(F.col("_r1").isNotNull(), F.array(_item(K_RECON, G_CONCAT, ln, 0, 0, none, F.col("_r1.value"),
                                                                         F.col("_r1.prefix"), METHODS[1]))).otherwise(_empty(ITEM)),
        "parts": lambda: F.when(F.col("_part").isNotNull(), F.array(_item(
            K_PART, F.col("_part.kind") + 2, ln, 0, 0, none, F.col("_part.value"),
            F.col("_part.name"), F.col("_part.idx")))).otherwise(_empty(ITEM)),
    }
    # a column of its own, NULL for lines without items: what stands in the explode itself is interpreted
    has = {"rules": F.size("regex_hits") > 0, "candidates": F.size("_pc") > 0, "chain": F.size("_chain") > 0, "commands": F.size("_cmd") > 0,
           "concat": F.col("_r1").isNotNull(), "parts": F.col("_part").isNotNull()}
    asked = [f for f in FAMILIES if f in families]
    items = F.when(reduce(or_, [has[f] for f in asked]), F.concat(*[once(("items", f), arrays[f]) for f in asked]))
    out = df.select(*DOC, "line_num", *FEATURES, items.alias("items")).select(
        *DOC, "line_num", *FEATURES, F.explode_outer("items").alias("it")).where(F.col("it").isNotNull())
    return out.select(*DOC, "line_num", *FEATURES, "it.*")


def fold_parts(items: DataFrame, prefixes=PREFIXES) -> DataFrame:
    """Part items become one reconstructed item for each (document, kind, name); other items pass through.

    One aggregation: parts meet by name, all other items by line, so both need
    the items once.  Of a part only its index, line and value are gathered, and of
    a name's first line (that of the lowest index) the features: a generated file
    with millions of parts of one name is an array of small structs.
    """
    part = F.col("kind") == K_PART
    columns = [c for c in items.columns if c not in DOC]
    one = part_key(F.col("label"), F.col("line_num"), F.col("value"))
    packed = items.select(
        *DOC, F.when(part, F.col("grp") - 2).alias("pk"), F.when(part, F.col("text")).alias("pname"),
        F.when(~part, F.col("line_num")).alias("at"), F.when(~part, F.struct(*columns)).alias("it"), F.when(part, one).alias("part"),
        F.when(part, F.struct(one.alias("key"), *FEATURES)).alias("head"))
    g = packed.groupBy(*DOC, "pk", "pname", "at").agg(
        F.collect_list("it").alias("its"), F.array_sort(F.collect_list("part")).alias("sorted"), F.min("head").alias("head"), F.min("part.line_num").alias("seen"))
    g = g.select("*", F.when(F.col("pk").isNotNull(), without_repeats("sorted")).alias("ps")).drop("sorted")
    g = g.select("*", F.when(F.size("ps") >= 2, F.array_join(F.transform("ps", lambda p: p["value"]), "")).alias("joined")).drop("ps")
    g = g.select("*", tx.entropy(F.col("joined")).alias("_e"))
    g = g.select(*DOC, "pk", "its", "head", "seen", once(("joined", tuple(prefixes)), lambda: F.when(
        F.col("joined").isNotNull() & keep_group(F.col("pk"), F.col("joined"), F.col("_e"), prefixes), F.col("joined")).alias("joined")))
    # text: the value's head, as R1 has the literal with the known prefix there
    value = {"line_num": F.col("head.key.line_num"), "kind": F.lit(K_RECON), "grp": F.col("pk") + 2, "ln": F.col("seen"), "sub": F.lit(0), "pos": F.lit(0),
             "path": F.array().cast("array<int>"), "value": F.col("joined"), "text": F.substring("joined", 1, HEAD),
             "label": F.when(F.col("pk") == 2, METHODS[2]).otherwise(METHODS[3]), "rule_id": F.lit(None).cast("int")}
    types = dict(items.dtypes)
    made = F.struct(*[value.get(c, F.col(f"head.{c}") if c in FEATURES else None).cast(types[c]).alias(c) for c in columns])
    none = F.array().cast("array<" + items.select(F.struct(*columns).alias("x")).schema["x"].dataType.simpleString() + ">")
    its = F.when(F.col("pk").isNull(), F.col("its")).when(F.col("joined").isNotNull(), F.array(made)).otherwise(none)
    out = g.select(*DOC, F.explode_outer(its).alias("it")).where(F.col("it").isNotNull())
    return out.select(*DOC, "it.*").select(*items.columns)


def bearing(items: DataFrame, prefixes=PREFIXES) -> DataFrame:
    """The items that may give evidence: a candidate value gives some only if a prefix fits, so it begins as one does.

    Told before the parts of split values meet, so that what gives none is neither
    gathered nor shuffled.  Only the first characters are looked up: tests of all
    prefixes make the method of the stage too long for the JVM to compile.
    """
    n = min((len(p.prefix) for p in prefixes), default=0)
    if not n:
        return items
    return items.where((F.col("kind") != K_CAND) | F.substring("value", 1, n).isin(*sorted({p.prefix[:n] for p in prefixes})))


def _evidence() -> Column:
    """What an item and the prefixes that it matches give evidence of."""
    kind = F.col("kind")
    ev_t = "struct<ev:int,pord:int,provider:string,ptype:string,plen:int,pscore:int>"

    def ev(code, p=None):
        if p is None:
            return F.struct(F.lit(code).alias("ev"), F.lit(None).cast("int").alias("pord"),
                            F.lit(None).cast("string").alias("provider"), F.lit(None).cast("string").alias("ptype"),
                            F.lit(None).cast("int").alias("plen"), F.lit(None).cast("int").alias("pscore"))
        return F.struct(F.lit(code).alias("ev"), p["ord"].alias("pord"), p["provider"].alias("provider"),
                        p["type"].alias("ptype"), p["expected_length"].alias("plen"),
                        p["base_score"].alias("pscore"))
    fp = F.get(F.col("_pm"), 0)
    return F.concat(
        F.when(kind == K_REGEX, F.array(ev(EV_REGEX))).otherwise(_empty(ev_t)),
        F.coalesce(F.transform("_pm", lambda p: ev(EV_PREFIX, p)), _empty(ev_t)),
        F.when(kind == K_DECODED, F.array(F.when(fp.isNull(), ev(EV_DECODED)).otherwise(ev(EV_DECODED, fp))))
         .otherwise(_empty(ev_t)),
        F.when(kind == K_RECON, F.array(F.when(fp.isNull(), ev(EV_RECON)).otherwise(ev(EV_RECON, fp))))
         .otherwise(_empty(ev_t)))


def evidence(all_items: DataFrame, prefixes=PREFIXES) -> DataFrame:
    """Items -> evidence rows: regex hits, prefix hits (P4), decoded and reconstructed values."""
    kind = F.col("kind")
    staged = all_items.select("*", once(("matching", tuple(prefixes)), lambda: F.when(
        kind.isin(K_CAND, K_DECODED, K_RECON), tx.matching_prefixes(F.col("value"), prefixes)).alias("_pm")))
    arr = once(("evidence",), _evidence)
    rows = staged.select(*all_items.columns, arr.alias("es")).select(*all_items.columns, F.explode_outer("es").alias("e")).where("e IS NOT NULL")
    key = F.struct((F.col("e.ev") - 1).alias("phase"), F.col("grp"), F.col("ln"), F.col("sub"), F.col("pos"),
                   F.col("path"), F.when(F.col("e.ev") == EV_PREFIX, F.col("e.pord")).otherwise(0).alias("pord"))
    return rows.select(*DOC, "line_num", *FEATURES, "rule_id", "value", "text", "label", key.alias("key"), "e.*")


def prefix_dedup(ev: DataFrame) -> DataFrame:
    """P5: first prefix hit per (doc, line, provider, type) in candidate order; the rows are dealt by document and line."""
    w = Window.partitionBy("doc_id", "doc_hash", "line_num", "ev", "pord").orderBy("key")
    return (ev.repartition(*LINE_KEY).withColumn("_p5", F.when(F.col("ev") == EV_PREFIX, F.row_number().over(w)))
            .where(F.col("_p5").isNull() | (F.col("_p5") == 1)).drop("_p5"))


def scan_items(docs: DataFrame, rules=RULES, latin1_compat: bool = False, use_gates: bool = True,
               partitions: int | None = None, families=FAMILIES, prefixes=PREFIXES) -> DataFrame:
    """Stage 1 up to the item rows (no shuffle).

    Text scanning costs far more CPU per byte than reading: for an input with few,
    large splits give ``partitions`` (a round-robin shuffle of the documents) or
    set ``spark.sql.files.maxPartitionBytes`` before reading.
    """
    docs = docs.repartition(partitions) if partitions else docs
    ls = split_normalize(docs, latin1_compat).drop("raw_line")
    return line_items(ls, rules, use_gates, families, prefixes)


def scan(docs: DataFrame, rules=RULES, prefixes=PREFIXES, latin1_compat: bool = False, use_gates: bool = True,
         partitions: int | None = None) -> DataFrame:
    """Scan a DataFrame (doc_id of any type, filename STRING, text STRING).

    Returns findings(doc_id, file, line, rule, category, severity,
    confidence, match, fix, source, rank, doc_hash); ``rank`` orders findings within a
    document (confidence descending, ties in detection order), ``doc_id`` and
    ``doc_hash`` (of name and text) together tell the document.  ``rules`` and
    ``prefixes`` are the built-in tables, a list of Rule / Prefix, or a DataFrame
    of the shape of ``rule_table`` / ``prefix_table``.

    Different rows that share a doc_id are documents of their own with ranks of
    their own; rows equal in id, name and text are one.  A NULL name is
    ``unknown``, a NULL or empty text has no findings.
    """
    rules = rules_from_table(rules) if isinstance(rules, DataFrame) else tuple(rules)
    prefixes = prefixes_from_table(prefixes) if isinstance(prefixes, DataFrame) else tuple(prefixes)
    items = scan_items(docs, rules, latin1_compat, use_gates, partitions, prefixes=prefixes)
    ev = evidence(fold_parts(bearing(items, prefixes), prefixes), prefixes)
    found = rank_findings(dedup_findings(score_evidence(prefix_dedup(ev), rules)))
    return with_severity(found).select(*FINDING_COLUMNS, "doc_hash")


def scan_files(tree: DataFrame, **kw) -> DataFrame:
    """Scan rows from ``sources.files.read_tree``; ``file`` is the relative path, which is also the identity."""
    found = scan(tree.select(F.col("file").alias("doc_id"), "filename", "text"), **kw)
    return found.withColumn("file", F.col("doc_id"))
