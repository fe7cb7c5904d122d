"""Rule table (X1) and provider-prefix table.

Both are plain data so that users can pass their own lists; the defaults
below are the detector's built-in tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str          # dialect markers, see functions.dialect.expand
    base_score: int
    category: str
    fix: str
    captures: bool = True         # group 1 is the secret value, else the whole match
    needs_entropy: bool = False
    skip_test: bool = False
    file_pattern: str | None = None   # case-sensitive search on the file name
    # Gate: alternatives of literals that every match contains after
    # lower-casing; a line is only matched if one alternative is present.
    gate: tuple[tuple[str, ...], ...] = field(default=())
    java_pattern: bool = False    # the pattern comes from a table, in Java's own syntax

    def score_fields(self) -> tuple:
        return self.base_score, self.category, self.fix, self.needs_entropy


@dataclass(frozen=True)
class Prefix:
    prefix: str
    provider: str
    type: str
    length: int
    score: int


def _g(*alts: str) -> tuple[tuple[str, ...], ...]:
    return tuple((a,) if isinstance(a, str) else tuple(a) for a in alts)


# --------------------------------------------------------------------------
# FIXED VALUES: names, patterns, scores, categories, fixes, flags and prefix
# rows below must equal the detector being reproduced, in this order, for
# identical findings.  Patterns are written in this package's dialect
# ({W} word char, {D} digit, {S} space, {NS} non-space).
# --------------------------------------------------------------------------
RULES: tuple[Rule, ...] = (
    Rule("AWS Access Key ID", r"(AKIA[0-9A-Z]{16})", 95, "cloud",
         "Use IAM roles, environment variables, or AWS Secrets Manager.", gate=_g("akia")),
    Rule("AWS Secret Access Key", r"(?:aws_secret_access_key|aws_secret_key|AWS_SECRET){S}*[=:]{S}*['\"]?([A-Za-z0-9/+=]{40})['\"]?", 95, "cloud",
         "Use ~/.aws/credentials, environment variables, or IAM roles.", needs_entropy=True, gate=_g("aws_secret")),
    Rule("AWS MWS Key", r"amzn\.mws\.[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", 90, "cloud",
         "Store MWS keys in a secrets manager.", captures=False, gate=_g("amzn.mws.")),
    Rule("Google API Key", r"(AIza[0-9A-Za-z_-]{35})", 90, "cloud",
         "Restrict the key in GCP Console and use environment variables.", gate=_g("aiza")),
    Rule("Google OAuth Client Secret", r"(?:client_secret){S}*[=:]{S}*['\"]([A-Za-z0-9_-]{24,})['\"]", 85, "cloud",
         "Use OAuth flow with server-side token exchange.", needs_entropy=True, gate=_g("client_secret")),
    Rule("GCP Service Account Key", r"\"type\"{S}*:{S}*\"service_account\"", 90, "cloud",
         "Use Workload Identity Federation instead of key files.", captures=False, gate=_g("service_account")),
    Rule("Azure Storage Account Key", r"(?:AccountKey|azure_storage_key){S}*[=:]{S}*['\"]?([A-Za-z0-9+/=]{86,88})['\"]?", 90, "cloud",
         "Use Azure Managed Identity or Key Vault.", gate=_g("accountkey", "azure_storage_key")),
    Rule("Azure Connection String", r"DefaultEndpointsProtocol=https;AccountName=[^;]+;AccountKey=[A-Za-z0-9+/=]+", 90, "cloud",
         "Store in Azure Key Vault or app settings.", captures=False, gate=_g(("defaultendpointsprotocol=https;accountname=", "accountkey="))),
    Rule("GitHub Personal Access Token", r"(ghp_[A-Za-z0-9_]{36,})", 95, "vcs",
         "Use GITHUB_TOKEN in CI or environment variables.", gate=_g("ghp_")),
    Rule("GitHub OAuth Token", r"(gho_[A-Za-z0-9_]{36,})", 90, "vcs",
         "Use GitHub App tokens or environment variables.", gate=_g("gho_")),
    Rule("GitHub App Token", r"(ghu_[A-Za-z0-9_]{36,}|ghs_[A-Za-z0-9_]{36,}|ghr_[A-Za-z0-9_]{36,})", 90, "vcs",
         "Rotate and store in environment variables.", gate=_g("ghu_", "ghs_", "ghr_")),
    Rule("GitLab Token", r"(glpat-[A-Za-z0-9_-]{20,})", 90, "vcs",
         "Use CI/CD variables or environment variables.", gate=_g("glpat-")),
    Rule("Stripe Live Secret Key", r"(sk_live_[A-Za-z0-9]{20,})", 95, "payment",
         "Use environment variables. Use sk_test_ for development.", gate=_g("sk_live_")),
    Rule("Stripe Restricted Key", r"(rk_live_[A-Za-z0-9]{20,})", 90, "payment",
         "Store restricted keys in environment variables.", gate=_g("rk_live_")),
    Rule("PayPal Braintree Token", r"access_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}", 90, "payment",
         "Use server-side environment variables.", captures=False, gate=_g("access_token$production$")),
    Rule("Square Access Token", r"sq0atp-[0-9A-Za-z_-]{22,}", 90, "payment",
         "Store Square tokens in environment variables.", captures=False, gate=_g("sq0atp-")),
    Rule("Slack Webhook URL", r"(https://hooks\.slack\.com/services/T[A-Z0-9]+/B[A-Z0-9]+/[A-Za-z0-9]+)", 85, "communication",
         "Store webhook URLs in environment variables.", gate=_g("https://hooks.slack.com/services/")),
    Rule("Slack Bot Token", r"(xoxb-[0-9]{10,}-[0-9]{10,}-[A-Za-z0-9]{24,})", 90, "communication",
         "Use environment variables for Slack bot tokens.", gate=_g("xoxb-")),
    Rule("Discord Webhook URL", r"(https://discord(?:app)?\.com/api/webhooks/{D}+/[A-Za-z0-9_-]+)", 85, "communication",
         "Store webhook URLs in environment variables.", gate=_g("https://discord")),
    Rule("Twilio API Key", r"(SK[0-9a-fA-F]{32})", 75, "communication",
         "Store Twilio credentials in environment variables.", needs_entropy=True, gate=_g("sk")),
    Rule("SendGrid API Key", r"(SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43})", 95, "communication",
         "Use environment variables for SendGrid API keys.", gate=_g("sg.")),
    Rule("Mailgun API Key", r"key-[0-9a-zA-Z]{32}", 85, "communication",
         "Store Mailgun keys in environment variables.", captures=False, gate=_g("key-")),
    Rule("Datadog API Key", r"(?:datadog_api_key|DD_API_KEY){S}*[=:]{S}*['\"]?([a-f0-9]{32})['\"]?", 80, "monitoring",
         "Use environment variables for Datadog keys.", needs_entropy=True, gate=_g("datadog_api_key", "dd_api_key")),
    Rule("New Relic License Key", r"(?:NEW_RELIC_LICENSE_KEY|newrelic_key){S}*[=:]{S}*['\"]?([A-Za-z0-9]{40})['\"]?", 80, "monitoring",
         "Use environment variables for New Relic keys.", needs_entropy=True, gate=_g("new_relic_license_key", "newrelic_key")),
    Rule("Sentry DSN", r"https://[a-f0-9]{32}@[a-z0-9.]+\.ingest\.sentry\.io/{D}+", 60, "monitoring",
         "Sentry DSNs are semi-public but best kept in env config.", captures=False, gate=_g(("https://", ".ingest.sentry.io/"))),
    Rule("Database Connection String", r"((?:mongodb|postgres|postgresql|mysql|redis|amqp|mssql|mariadb)://[^{SC}'\"]{10,})", 85, "database",
         "Use environment variables for connection strings.", gate=_g("://")),
    Rule("JDBC Connection with Password", r"(jdbc:[a-z]+://[^{SC}'\"]*(?:password|pwd)=[^{SC}&'\"]+)", 90, "database",
         "Use a connection pool config with externalized credentials.", gate=_g(("jdbc:", "password="), ("jdbc:", "pwd="))),
    Rule("RSA Private Key", r"-----BEGIN RSA PRIVATE KEY-----", 98, "crypto",
         "Store private keys in a vault or HSM.", captures=False, gate=_g("-----begin rsa private key-----")),
    Rule("EC Private Key", r"-----BEGIN EC PRIVATE KEY-----", 98, "crypto",
         "Store private keys in a vault or HSM.", captures=False, gate=_g("-----begin ec private key-----")),
    Rule("OpenSSH Private Key", r"-----BEGIN OPENSSH PRIVATE KEY-----", 98, "crypto",
         "Never commit SSH keys. Use ssh-agent.", captures=False, gate=_g("-----begin openssh private key-----")),
    Rule("PGP Private Key", r"-----BEGIN PGP PRIVATE KEY BLOCK-----", 98, "crypto",
         "Store PGP keys in a keyring.", captures=False, gate=_g("-----begin pgp private key block-----")),
    Rule("Generic Private Key", r"-----BEGIN (?:DSA |ENCRYPTED )?PRIVATE KEY-----", 95, "crypto",
         "Store private keys in a secure vault.", captures=False, gate=_g("private key-----")),
    Rule("JWT Token", r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", 65, "auth",
         "JWTs should be obtained at runtime.", gate=_g("eyj")),
    Rule("Hardcoded Password", r"(?:password|passwd|pwd){S}*[=:]{S}*['\"]([^'\"]{4,})['\"]", 75, "credential",
         "Never hardcode passwords. Use env vars or credential store.", needs_entropy=True, skip_test=True, gate=_g("passw", "pwd")),
    Rule("Hardcoded API Key", r"(?:api[_-]?key|apikey|api[_-]?secret){S}*[=:]{S}*['\"]([^'\"]{8,})['\"]", 75, "credential",
         "Move API keys to environment variables.", needs_entropy=True, skip_test=True, gate=_g("api")),
    Rule("Hardcoded Secret", r"(?:secret|secret[_-]?key|client[_-]?secret|app[_-]?secret){S}*[=:]{S}*['\"]([^'\"]{8,})['\"]", 80, "credential",
         "Use a secrets manager or environment variables.", needs_entropy=True, skip_test=True, gate=_g("secret")),
    Rule("Hardcoded Auth Token", r"(?:auth[_-]?token|access[_-]?token|bearer[_-]?token|refresh[_-]?token){S}*[=:]{S}*['\"]([^'\"]{8,})['\"]", 80, "credential",
         "Tokens should come from OAuth flows or env vars.", needs_entropy=True, skip_test=True, gate=_g("token")),
    Rule("Hardcoded Encryption Key", r"(?:encryption[_-]?key|encrypt[_-]?key|aes[_-]?key|signing[_-]?key){S}*[=:]{S}*['\"]([^'\"]{8,})['\"]", 85, "crypto",
         "Use a KMS for encryption keys.", needs_entropy=True, skip_test=True, gate=_g("key")),
    Rule("URL with Embedded Credentials", r"(https?://[^:]+:[^@]+@[^{SC}'\"]+)", 85, "credential",
         "Never embed credentials in URLs.", gate=_g(("http", "@"))),
    Rule("Hardcoded IP Address", r"['\"]({D}{1,3}\.{D}{1,3}\.{D}{1,3}\.{D}{1,3})['\"]", 25, "infra",
         "Use config files or env vars for IPs.", gate=_g(('"', "."), ("'", "."))),
    Rule("Android Manifest API Key", r"android:value{S}*={S}*\"([A-Za-z0-9_-]{20,})\"", 70, "android",
         "Use BuildConfig from local.properties.", needs_entropy=True, file_pattern=r"AndroidManifest\.xml",
         gate=_g("android:value")),
    Rule("BuildConfig Hardcoded Secret", r"buildConfigField{S}+['\"]String['\"]{S}*,{S}*['\"].*(?:KEY|SECRET|TOKEN).*['\"]{S}*,{S}*['\"]\\\"([^\"]+)\\\"['\"]", 80, "android",
         "Read from local.properties.", file_pattern=r"\.gradle", gate=_g(("buildconfigfield", '\\"'))),
    Rule("Firebase Config Inline", r"(?:firebase|firebaseConfig){S}*[=:]{S}*\{[^}]*apiKey{S}*:", 60, "android",
         "Use google-services.json.", captures=False, gate=_g(("firebase", "apikey"))),
    Rule("npm Token", r"//registry\.npmjs\.org/:_authToken=([A-Za-z0-9_-]+)", 90, "registry",
         "Use npm login or CI env vars.", gate=_g("//registry.npmjs.org/:_authtoken=")),
    Rule("PyPI Token", r"(pypi-[A-Za-z0-9_-]{50,})", 90, "registry",
         "Use keyring or CI secrets.", gate=_g("pypi-")),
    Rule("Docker Hub Token", r"(?:DOCKER_PASSWORD|DOCKER_TOKEN){S}*[=:]{S}*['\"]([^'\"]{8,})['\"]", 80, "registry",
         "Use docker credential helpers.", needs_entropy=True, gate=_g("docker_password", "docker_token")),
    Rule("High Entropy String", r"['\"]([A-Za-z0-9+/=_-]{32,})['\"]", 35, "entropy",
         "Review — high entropy strings may be secrets.", needs_entropy=True, skip_test=True, gate=_g('"', "'")),
    Rule("Possible Password (unquoted)", r"(?:PASSWORD|PASSWD|PWD|DB_PASSWORD|EMAIL_PASSWORD|ADMIN_PASSWORD){S}*={S}*({NS}{4,})", 40, "candidate",
         "If real, move to secrets manager or .gitignored .env.", needs_entropy=True, skip_test=True, gate=_g("passw", "pwd")),
    Rule("Possible Secret/Key (unquoted)", r"(?:SECRET|SECRET_KEY|JWT_SECRET|APP_SECRET|SIGNING_KEY|ENCRYPTION_KEY){S}*={S}*({NS}{6,})", 40, "candidate",
         "If real, use env vars or secrets manager.", needs_entropy=True, skip_test=True, gate=_g("secret", "signing_key", "encryption_key")),
    Rule("Possible Token (unquoted)", r"(?:TOKEN|AUTH_TOKEN|ACCESS_TOKEN|REFRESH_TOKEN|BEARER_TOKEN|API_TOKEN|GITHUB_TOKEN){S}*={S}*({NS}{8,})", 40, "candidate",
         "If real, store in env vars or secrets manager.", needs_entropy=True, skip_test=True, gate=_g("token")),
    Rule("Possible API Key (unquoted)", r"(?:API_KEY|APIKEY|API_SECRET|GOOGLE_API_KEY|STRIPE_API_KEY|MAPS_API_KEY){S}*={S}*({NS}{8,})", 40, "candidate",
         "If real, move to env vars or secrets manager.", needs_entropy=True, skip_test=True, gate=_g("api")),
    Rule("Possible Connection String (unquoted)", r"(?:DATABASE_URL|DB_URL|REDIS_URL|MONGO_URI|CONNECTION_STRING){S}*={S}*({NS}{10,})", 45, "candidate",
         "Connection strings often contain credentials.", skip_test=True,
         gate=_g("database_url", "db_url", "redis_url", "mongo_uri", "connection_string")),
)

PREFIXES: tuple[Prefix, ...] = (
    Prefix("AKIA", "AWS", "Access Key ID", 20, 95),
    Prefix("ABIA", "AWS", "STS Token", 20, 85),
    Prefix("ACCA", "AWS", "Context Key", 20, 85),
    Prefix("ASIA", "AWS", "Temp Credentials", 20, 90),
    Prefix("AIza", "Google", "API Key", 39, 90),
    Prefix("ghp_", "GitHub", "Personal Token", 40, 95),
    Prefix("gho_", "GitHub", "OAuth Token", 40, 90),
    Prefix("ghu_", "GitHub", "User Token", 40, 90),
    Prefix("ghs_", "GitHub", "Server Token", 40, 90),
    Prefix("ghr_", "GitHub", "Refresh Token", 40, 90),
    Prefix("glpat-", "GitLab", "Personal Token", 26, 90),
    Prefix("sk_live_", "Stripe", "Live Secret Key", 32, 95),
    Prefix("rk_live_", "Stripe", "Restricted Key", 32, 90),
    Prefix("sk_test_", "Stripe", "Test Secret Key", 32, 50),
    Prefix("pk_live_", "Stripe", "Live Publishable", 32, 60),
    Prefix("SG.", "SendGrid", "API Key", 69, 95),
    Prefix("xoxb-", "Slack", "Bot Token", 50, 90),
    Prefix("xoxp-", "Slack", "User Token", 50, 90),
    Prefix("xoxa-", "Slack", "App Token", 50, 90),
    Prefix("xoxr-", "Slack", "Refresh Token", 50, 90),
    Prefix("sq0atp-", "Square", "Access Token", 30, 90),
    Prefix("sq0csp-", "Square", "Secret", 50, 90),
    Prefix("pypi-", "PyPI", "API Token", 50, 90),
    Prefix("npm_", "npm", "Access Token", 36, 90),
    Prefix("eyJ", "JWT", "JSON Web Token", 30, 65),
    Prefix("key-", "Mailgun", "API Key", 36, 85),
    Prefix("SK", "Twilio", "API Key", 34, 75),
    Prefix("amzn.mws.", "Amazon", "MWS Key", 40, 90),
    Prefix("shpat_", "Shopify", "Access Token", 40, 90),
    Prefix("shpca_", "Shopify", "Custom App Token", 40, 90),
    Prefix("shppa_", "Shopify", "Private App Token", 40, 90),
    Prefix("whsec_", "Stripe", "Webhook Secret", 40, 85),
    Prefix("AC", "Twilio", "Account SID", 34, 70),
    Prefix("dop_v1_", "DigitalOcean", "Personal Token", 64, 90),
    Prefix("v2.", "Cloudflare", "API Token", 40, 80),
)
# ------------------------------------------------------------------ end FIXED


RULE_SCHEMA = T.StructType([
    T.StructField("rule_id", T.IntegerType()), T.StructField("rule", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("base_score", T.IntegerType()),
    T.StructField("needs_entropy", T.BooleanType()), T.StructField("skip_test", T.BooleanType()),
    T.StructField("file_pattern", T.StringType()), T.StructField("captures", T.BooleanType()),
    T.StructField("pattern", T.StringType()), T.StructField("fix", T.StringType()),
])

PREFIX_SCHEMA = T.StructType([
    T.StructField("ord", T.IntegerType()), T.StructField("prefix", T.StringType()),
    T.StructField("provider", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("expected_length", T.IntegerType()), T.StructField("base_score", T.IntegerType()),
])


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """The rule table as a DataFrame (``pattern`` in Java dialect)."""
    from ..functions.dialect import java
    rows = [(i, r.name, r.category, r.base_score, r.needs_entropy, r.skip_test, r.file_pattern,
             r.captures, java(r.pattern, True), r.fix) for i, r in enumerate(rules, 1)]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def prefix_table(spark: SparkSession, prefixes=PREFIXES) -> DataFrame:
    """The prefix table as a DataFrame with its match order ``ord``."""
    rows = [(i, p.prefix, p.provider, p.type, p.length, p.score) for i, p in enumerate(prefixes, 1)]
    return spark.createDataFrame(rows, PREFIX_SCHEMA)


def prefixes_from_table(prefix_df: DataFrame) -> tuple[Prefix, ...]:
    """Prefixes of a user's table (``prefix_table`` shape) in the order of ``ord``; configuration, so it is collected."""
    return tuple(Prefix(t["prefix"], t["provider"], t["type"], t["expected_length"], t["base_score"])
                 for t in sorted(prefix_df.collect(), key=lambda t: t["ord"]))
