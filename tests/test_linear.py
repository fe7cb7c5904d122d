"""Patterns in linear time: the same matches as the plain forms, and no growth with the square of a line."""
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from credsweep.operators import reconstruct as rc
from credsweep.operators.rules import LINEAR, all_matches, pattern_of
from credsweep.operators.tables import RULES
from credsweep.plans.scan import K_RECON, fold_parts, scan_items

RULE = {r.name: r for r in RULES}
PIECES = {
    "JDBC Connection with Password": ["jdbc:", "mysql", "://", "password=", "pwd=", "x", "&", " ", "'", "JDBC:a://"],
    "URL with Embedded Credentials": ["http://", "https://", "HTTP:", "//", ":", "@", "u", " ", '"', "@@", ":@"],
    "Firebase Config Inline": ["firebase", "firebaseConfig", " ", "=", ":", "{", "}", "apiKey", "apiKey :", "x"],
}


@pytest.mark.parametrize("name", sorted(LINEAR))
def test_same_matches(spark, name):
    rng = random.Random(name)
    lines = [("".join(rng.choice(PIECES[name]) for _ in range(rng.randint(1, 25))),) for _ in range(4000)]
    rule = RULE[name]
    df = spark.createDataFrame(lines, "line string")
    plain = F.regexp_extract_all("line", F.lit(pattern_of(rule)), 1 if rule.captures else 0)
    out = df.select("line", all_matches(F.col("line"), rule, 0).alias("a"), plain.alias("b"))
    wrong = out.where(F.col("a") != F.col("b")).limit(3).collect()
    assert not wrong and out.where(F.size("a") > 0).count() > 50


def test_same_parts(spark):
    rng = random.Random(1)
    lines = [("".join(rng.choice(["a", "1", "22", "_", " ", "=", ":", '"', "v", "x9", "[", "]", "."]) for _ in range(rng.randint(1, 14))),) for _ in range(6000)]
    lines += [("007=x",), ("7=x",), ("a1b22 = 'v'",), ("٣٤=x",)]
    df = spark.createDataFrame(lines, "line string")
    plain = [F.regexp_extract("line", rc.SPLIT_PART, i) for i in (1, 2, 3)]
    array = [F.regexp_extract("line", rc.ARRAY_PART, i) for i in (1, 2, 3)]
    out = df.select("line", rc.assignment_part(F.col("line")).alias("p"), F.array(*plain).alias("s"), F.array(*array).alias("a")).collect()
    hits = 0
    for r in out:
        gate = "=" in r.line or ":" in r.line
        expected = (2, *r.s) if gate and r.s[0] else (3, *r.a) if gate and r.a[0] else None
        assert (tuple(r.p) if r.p else None) == expected, r.line
        hits += expected is not None
    assert hits > 100


LONG = {
    "JDBC Connection with Password": lambda n: "pwd= " + "jdbc:a://" * (n // 9),
    "URL with Embedded Credentials": lambda n: "@ " + "http://x " * (n // 9) + "@ ",
    "Firebase Config Inline": lambda n: "apikey" + "firebase={" * (n // 10),
    "split": lambda n: "1" * n + " x=",
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_time_grows_with_the_line(spark, name):
    line = F.col("line")
    column = F.to_json(F.struct(rc.assignment_part(line).alias("x"))) if name == "split" else F.size(all_matches(line, RULE[name], 1)).cast("string")

    def seconds(n):
        df = spark.createDataFrame([(LONG[name](n),)], "line string").coalesce(1)
        best = 1e9
        for _ in range(2):
            t = time.time()
            df.select(column.alias("x")).collect()
            best = min(best, time.time() - t)
        return best
    seconds(1000)
    assert seconds(1_000_000) < 15 * seconds(100_000) + 3


def test_patterns_by_hand():
    """Spot checks of the fixed patterns against examples written out here."""
    plain = {n: re.compile(RULE[n].pattern.replace("{SC}", r"\s").replace("{S}", r"\s"), re.I) for n in LINEAR}
    assert plain["JDBC Connection with Password"].search("u=jdbc:mysql://h/d?user=a&password=p4ss x").group(1) == "jdbc:mysql://h/d?user=a&password=p4ss"
    assert plain["URL with Embedded Credentials"].search("see https://u:p@h/x now").group(1) == "https://u:p@h/x"
    assert plain["Firebase Config Inline"].search("var firebaseConfig = {a: 1, apiKey : 'k'}").group(0) == "firebaseConfig = {a: 1, apiKey :"


def test_many_parts_of_one_name(spark):
    """A generated file whose lines are all parts of one array; equal parts count once, order is by index."""
    n = 60_000
    order = [(i * 7919) % n for i in range(n)]
    value = lambda i: f"{i * 2654435761 % 2**32:08x}"
    text = "\n".join(f't[{i}] = "{value(i)}"' for i in order) + '\nt[0] = "zzzz"\nkey1 = "sk_live_"\nkey10 = "gh"\nkey2 = "abcdef"'
    begun = time.time()
    found = [r for r in scan_items_folded(spark, text) if r.kind == K_RECON]
    assert time.time() - begun < 240
    values = {r.value[:10]: r for r in found}
    whole = next(r for r in found if len(r.value) > 1000)
    assert whole.value == value(0) + "zzzz" + "".join(value(i) for i in range(1, n)) and whole.line_num == order.index(0) + 1 and whole.ln == 1
    assert "sk_live_ab" in values and values["sk_live_ab"].value == "sk_live_abcdefgh"


def scan_items_folded(spark, text):
    docs = spark.createDataFrame([(1, "a.py", text)] * 2, "doc_id bigint, filename string, text string").coalesce(1)
    return fold_parts(scan_items(docs, families=("parts",))).collect()
