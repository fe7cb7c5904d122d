"""Planted corpus: one synthetic source file per ``orders`` row.

The given tables hold almost no secrets, so most detection paths would only
ever compare empty results.  This builds, from ``orders`` alone and with no
random function, documents whose lines exercise every rule, prefix, decoder,
reconstruction and normalization path.  Each template renders both as a Spark
Column and as DuckDB SQL, so the Spark side and the SQL oracle scan the very
same text.  The work grows with ``orders``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import sql_str
from ..operators.tables import PREFIXES

PLANTED_ID_BASE = 1_000_000_000_000


class X:
    """Tiny expression node rendered to Spark or to DuckDB SQL."""

    def spark(self) -> Column:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def __add__(self, other):
        return Cat(self, other)

    def __radd__(self, other):
        return Cat(other, self)


def _x(v) -> X:
    return v if isinstance(v, X) else Lit(v)


class Lit(X):
    def __init__(self, s: str):
        self.s = s

    def spark(self):
        return F.lit(self.s)

    def sql(self):
        return sql_str(self.s)


class Fn(X):
    def __init__(self, spark_fn, sql_fmt: str, *args):
        self.spark_fn, self.sql_fmt, self.args = spark_fn, sql_fmt, [_x(a) for a in args]

    def spark(self):
        return self.spark_fn(*[a.spark() for a in self.args])

    def sql(self):
        return self.sql_fmt.format(*[a.sql() for a in self.args])


class Cat(X):
    def __init__(self, *parts):
        flat = []
        for p in parts:
            flat.extend(p.parts if isinstance(p, Cat) else [_x(p)])
        self.parts = flat

    def spark(self):
        return F.concat(*[p.spark() for p in self.parts])

    def sql(self):
        return "concat(" + ", ".join(p.sql() for p in self.parts) + ")"


class KeyStr(X):
    def __init__(self, mod: int | None = None):
        self.mod = mod

    def spark(self):
        k = F.col("o_orderkey")
        return (k if self.mod is None else k % self.mod).cast("string")

    def sql(self):
        return "cast(o_orderkey as varchar)" if self.mod is None else f"cast(o_orderkey % {self.mod} as varchar)"


class Case(X):
    """Pick a branch by ``o_orderkey % len(branches)`` (or an offset key)."""

    def __init__(self, branches, offset: int = 0):
        self.branches, self.offset = [_x(b) for b in branches], offset

    def spark(self):
        sel = (F.col("o_orderkey") + self.offset) % len(self.branches)
        out = None
        for i, b in enumerate(self.branches):
            out = F.when(sel == i, b.spark()) if out is None else out.when(sel == i, b.spark())
        return out

    def sql(self):
        sel = f"(o_orderkey + {self.offset}) % {len(self.branches)}"
        return f"(CASE {sel} " + " ".join(f"WHEN {i} THEN {b.sql()}" for i, b in enumerate(self.branches)) + " END)"


def md5k():
    return Fn(lambda: F.md5(F.col("o_orderkey").cast("string")), "md5(cast(o_orderkey as varchar))")


def sha256k():
    return Fn(lambda: F.sha2(F.col("o_orderkey").cast("string"), 256), "sha256(cast(o_orderkey as varchar))")


def sub(x, pos: int, n: int):
    return Fn(lambda a: F.substring(a, pos, n), f"substr({{0}}, {pos}, {n})", x)


def upper(x):
    return Fn(F.upper, "upper({0})", x)


def b64(x):
    # Spark's base64() wraps long output in MIME lines; drop the breaks.
    return Fn(lambda a: F.regexp_replace(F.base64(F.encode(a, "UTF-8")), "[\\r\\n]", ""),
              "to_base64(encode({0}))", x)


def hexe(x):
    return Fn(lambda a: F.lower(F.hex(F.encode(a, "UTF-8"))), "lower(hex(encode({0})))", x)


def rev(x):
    return Fn(F.reverse, "reverse({0})", x)


def lpad(x, n: int, ch: str):
    return Fn(lambda a: F.lpad(a, n, ch), f"lpad({{0}}, {n}, {sql_str(ch)})", x)


def lines_of(*ls) -> X:
    parts = []
    for i, l in enumerate(ls):
        if i:
            parts.append("\n")
        parts.append(l)
    return Cat(*parts)


h, H, s, k = md5k(), upper(md5k()), sha256k(), KeyStr()


def hs(a, n):
    return sub(h, a, n)


def Hs(a, n):
    return sub(H, a, n)


def ss(a, n):
    return sub(s, a, n)


BS = "\\"
# One line per rule, in rule order (value shapes from md5/sha256 of the key).
RULE_LINES = [
    'aws_key = "AKIA' + Hs(1, 16) + '"',
    "aws_secret_access_key = " + ss(1, 40),
    'mws_key = "amzn.mws.' + hs(1, 8) + "-" + hs(9, 4) + "-" + hs(13, 4) + "-" + hs(17, 4) + "-" + hs(21, 12) + '"',
    'google_key = "AIza' + hs(1, 32) + 'x_-"',
    'client_secret = "' + hs(1, 24) + '"',
    '{"type": "service_account", "project_id": "p' + k + '"}',
    "AccountKey=" + b64(s),
    'conn = "DefaultEndpointsProtocol=https;AccountName=acct' + k + ";AccountKey=" + b64(s) + '"',
    'gh_token = "ghp_' + hs(1, 32) + 'abcd"',
    'gh_oauth = "gho_' + hs(1, 32) + 'abcd"',
    'gh_app = "ghs_' + hs(1, 32) + 'abcd"',
    'gitlab = "glpat-' + hs(1, 20) + '"',
    'stripe = "sk_live_' + hs(1, 24) + '"',
    'stripe_r = "rk_live_' + hs(1, 24) + '"',
    'bt = "access_token$production$' + hs(1, 16) + "$" + h + '"',
    'sq = "sq0atp-' + hs(1, 22) + '"',
    'hook = "https://hooks.slack.com/services/T' + Hs(1, 8) + "/B" + Hs(9, 8) + "/" + hs(1, 24) + '"',
    'slack = "xoxb-' + lpad(k, 12, "1") + "-" + lpad(k, 11, "2") + "-" + hs(1, 24) + '"',
    'discord = "https://discord.com/api/webhooks/' + k + "/" + h + '"',
    'twilio_sid = "SK' + hs(1, 32) + '"',
    'sg = "SG.' + hs(1, 22) + "." + ss(1, 43) + '"',
    'mg = "key-' + hs(1, 32) + '"',
    "DD_API_KEY=" + h,
    "NEW_RELIC_LICENSE_KEY=" + ss(1, 40),
    'dsn = "https://' + h + "@o" + k + ".ingest.sentry.io/" + k + '"',
    'db = "postgres://app:' + hs(1, 12) + "@db" + k + '.internal:5432/app"',
    'jdbc = "jdbc:mysql://db:3306/app?user=a&password=' + hs(1, 12) + '"',
    "-----BEGIN RSA PRIVATE KEY-----",
    "-----BEGIN EC PRIVATE KEY-----",
    "-----BEGIN OPENSSH PRIVATE KEY-----",
    "-----BEGIN PGP PRIVATE KEY BLOCK-----",
    "-----BEGIN ENCRYPTED PRIVATE KEY-----",
    'jwt = "eyJ' + hs(1, 12) + ".eyJ" + hs(13, 12) + "." + hs(1, 20) + '"',
    'password = "' + hs(1, 12) + '"',
    'api_key = "' + hs(1, 20) + '"',
    'app_secret = "' + hs(1, 16) + '"',
    'auth_token = "' + hs(1, 20) + '"',
    'aes_key = "' + hs(1, 16) + '"',
    'url = "https://admin:' + hs(1, 10) + "@host" + k + '.internal/path"',
    'host = "10.' + KeyStr(256) + "." + KeyStr(7) + '.1"',
    '<meta-data android:name="key" android:value="' + hs(1, 24) + '"/>',
    'buildConfigField "String", "API_KEY", "' + BS * 3 + '"' + h + BS * 3 + '""',
    'firebaseConfig = { projectId: "p' + k + '", apiKey: "' + hs(1, 20) + '" }',
    "//registry.npmjs.org/:_authToken=" + h,
    'pypi_token = "pypi-' + ss(1, 50) + '"',
    'DOCKER_PASSWORD = "' + hs(1, 16) + '"',
    'blob = "' + b64(h) + '"',
    "PASSWORD=" + hs(1, 10),
    "SECRET_KEY=" + hs(1, 12),
    "TOKEN=" + h,
    "API_KEY=" + hs(1, 16),
    "DATABASE_URL=postgres://u:" + hs(1, 8) + "@db/x",
]


def _prefix_line(p, short: bool) -> X:
    total = max(p.length // 3, 8) if short else p.length
    pay = max(total - len(p.prefix), 1)
    return 'v = "' + p.prefix + sub(h + s, 1, pay) + '"'


# Prefix line: full expected length for even keys, a third of it for odd keys.
PREFIX_LINES = [Case([_prefix_line(p, False), _prefix_line(p, True)]) for p in PREFIXES]

STRUCTURE_LINES = [
    'k = "' + b64("sk_live_" + hs(1, 24)) + '"',
    'k = "' + hexe("ghp_" + h + "abcd") + '"',
    'u = "ghp%5F' + h + '"',
    'k = "' + b64(hexe("glpat-" + h)) + '"',
    'k = "' + b64(b64(b64(b64("npm_" + h)))) + '"',
    'k = "' + b64('{"a": "' + b64("AKIA" + Hs(1, 16)) + '"}') + '"',
    'k = "ab-_' + b64(h) + '"',
    "x=$(echo " + b64("xoxb-" + h) + " | base64 --decode)",
    "y=`echo " + b64("ghp_" + h + "abcd") + " | base64 --decode`",
    "echo " + rev("glpat-" + h) + " | rev",
    'echo "' + rev("glpat-" + h) + '" | rev',
    'echo "xoxb-' + h + '"',
    't = "ghp_abc" + "' + hs(1, 8) + '"',
    't = "sk_live_" . suffix' + k,
    lines_of('part2 = "' + hs(1, 8) + '"', "", 'part1 = "sk_live_' + hs(9, 4) + '"', 'part10 = "' + hs(13, 8) + '"'),
    lines_of('key1 = "' + hs(1, 12) + '";', 'key2 = "' + hs(13, 12) + '";'),
    lines_of('arr[1] = "' + hs(1, 10) + '"', 'arr[0] = "ghp_' + hs(11, 10) + '"'),
    'only1 = "' + h + '"',
    lines_of('aws = "' + BS + "x41KIA" + Hs(1, 16) + '"', 'aws2 = "' + BS * 2 + "x41KIA" + Hs(1, 16) + '"'),
    'p = "' + BS + "x41" + hs(1, 6) + '" ' + BS,
    'bell = "' + BS + "x07" + hs(1, 6) + '"',
    lines_of('password = "${DB_PASS}"', 'password = "changeme"', 'password = "{{ x }}"'),
    lines_of('password = "aaaaaaaaaaaaaaaaaaaa"', 'api_key = "abcdefghijklmnop"', 'secret = "1111111111"'),
]

CONTEXT_LINES = ["", "# plain comment", "password and secret live here", 'x = os.environ["A"]',
                 "example sample", "token key", "café déjà вы а"]

FILENAMES = ["app.py", "test_app.py", "AndroidManifest.xml", "app.gradle", "config.env",
             "latest.py", "Main.java", "demo.js", "prod.yaml"]
DIRS = ["src/", "node_modules/x/", "a/build/", "lib/", ".git/", "buildx/", ".github/", "_conf/", "with space/", "per%20cent/", ""]
SUFFIXES = ["", ".png", ".PNG", ".gz", ".txt"]

TEXT = lines_of(Case(CONTEXT_LINES), Case(RULE_LINES), Case(PREFIX_LINES),
                Case(STRUCTURE_LINES), Case(CONTEXT_LINES, offset=3))
FILENAME = Case(FILENAMES)
# hidden files and names that begin with an underscore, too
PATH_NAMES = FILENAMES + [".env", "__init__.py", "a b.py", "c%d.py"]
PATH = Cat(Case(DIRS), "k", KeyStr(), "/", Case(PATH_NAMES), Case(SUFFIXES, offset=1))
NAMELESS = 23
#: Documents that one task makes, at most about.
TASK_DOCS = 100_000


def planted_docs(spark: SparkSession, sf_dir: str, least: int = 0) -> DataFrame:
    """(doc_id, filename, text, path) from ``orders``, made in ``least`` tasks or one for each TASK_DOCS.

    The keys are dealt out, not the texts: one split of ``orders`` holds millions.
    Documents of one key, which have one path, are made in one task.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    o = o.repartition(max(1, least, math.ceil(o.count() / TASK_DOCS)), "o_orderkey")
    return o.select(
        (F.lit(PLANTED_ID_BASE) + F.col("o_orderkey")).alias("doc_id"),
        F.when(F.col("o_orderkey") % NAMELESS != 5, FILENAME.spark()).alias("filename"),
        TEXT.spark().alias("text"),
        PATH.spark().alias("path"))


def planted_sql() -> str:
    """The same documents as a DuckDB SELECT over the ``orders`` view."""
    return (f"SELECT CAST({PLANTED_ID_BASE} + o_orderkey AS BIGINT) AS doc_id, "
            f"CASE WHEN o_orderkey % {NAMELESS} <> 5 THEN {FILENAME.sql()} END AS filename, {TEXT.sql()} AS text, {PATH.sql()} AS path FROM orders")
