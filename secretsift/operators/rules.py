"""Credential rules as data, written from public token formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

GENERIC, CLOUD, DATABASE, AUTH, INFRA = "generic", "cloud", "database", "auth", "infrastructure"
CATEGORIES = (GENERIC, CLOUD, DATABASE, AUTH, INFRA)


@dataclass(frozen=True)
class Rule:
    """A candidate is group ``group`` of each match of ``regex``.

    A text without any of ``keywords`` cannot match and is not searched; they are
    in lower case and compared without case if ``any_case``.
    """

    name: str
    category: str
    keywords: tuple[str, ...]
    regex: str
    group: int = 1
    any_case: bool = False


def _token(first: str) -> str:
    """Start of a token that does not go on to its left.

    The first character is tried before the look back, so that the search passes
    over other characters quickly.
    """
    return rf"{first}(?<![0-9A-Za-z_]{first})"


# ... and one that does not go on to its right.
_END = r"(?![0-9A-Za-z_])"
_END_DASH = r"(?![0-9A-Za-z_\-])"
_USER = r"""[^\s:/@"'<>]"""
_PASS = r"""[^\s/@"'<>]"""

RULES: tuple[Rule, ...] = (
    Rule("assigned_secret", GENERIC, ("password", "passwd", "secret", "api", "token"),
         r"""(?i)(password|passwd|secret|api[_-]?key|token)\s*[:=]\s*"([^"]{8,})\"""", 2, True),
    Rule("assigned_secret_single", GENERIC, ("password", "passwd", "secret", "api", "token"),
         r"""(?i)(password|passwd|secret|api[_-]?key|token)['"]?\s*[:=]\s*'([^']{8,})'""", 2, True),
    Rule("aws_access_key", CLOUD, ("AKIA", "ASIA"), rf"({_token('A')}(?:KIA|SIA)[0-9A-Z]{{16}}){_END}"),
    Rule("google_api_key", CLOUD, ("AIza",), rf"({_token('A')}Iza[0-9A-Za-z_\-]{{35}}){_END_DASH}"),
    Rule("google_oauth_token", CLOUD, ("ya29.",), rf"({_token('y')}a29\.[0-9A-Za-z_\-]{{20,}})"),
    Rule("azure_account_key", CLOUD, ("AccountKey=",), r"AccountKey=([A-Za-z0-9+/]{86}==)"),
    Rule("digitalocean_token", CLOUD, ("dop_v1_",), rf"({_token('d')}op_v1_[a-f0-9]{{64}}){_END}"),
    Rule("database_url", DATABASE, ("://",),
         rf"""({_token('[pmra]')}(?:(?<=p)ostgres(?:ql)?|(?<=m)ysql|(?<=m)ongodb(?:\+srv)?|(?<=r)edis|"""
         rf"""(?<=a)mqps?)://{_USER}*:{_PASS}+@[^\s"'<>]+)"""),
    Rule("jdbc_password", DATABASE, ("jdbc:",),
         r"""(jdbc:[a-z]+:[^\s"'<>]*[?&;]password=[^\s"'&;<>]+)"""),
    Rule("json_web_token", AUTH, ("eyJ",),
         rf"({_token('e')}yJ[A-Za-z0-9_\-]{{8,}}\.eyJ[A-Za-z0-9_\-]{{8,}}\.[A-Za-z0-9_\-]{{8,}})"),
    Rule("bearer_token", AUTH, ("bearer",),
         rf"(?i){_token('b')}earer\s+([A-Za-z0-9\-._~+/]{{16,}}=*)", 1, True),
    Rule("github_token", AUTH, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
         rf"({_token('g')}h[pousr]_[A-Za-z0-9]{{36}}){_END}"),
    Rule("github_fine_grained_token", AUTH, ("github_pat_",),
         rf"({_token('g')}ithub_pat_[A-Za-z0-9_]{{82}}){_END}"),
    Rule("gitlab_token", AUTH, ("glpat-",), rf"({_token('g')}lpat-[A-Za-z0-9_\-]{{20}}){_END_DASH}"),
    Rule("slack_token", AUTH, ("xox",), rf"({_token('x')}ox[abprs]-[A-Za-z0-9\-]{{10,}})"),
    Rule("stripe_key", AUTH, ("k_live_",), rf"({_token('[sr]')}k_live_[A-Za-z0-9]{{24,}})"),
    Rule("sendgrid_key", AUTH, ("SG.",),
         rf"({_token('S')}G\.[A-Za-z0-9_\-]{{22}}\.[A-Za-z0-9_\-]{{43}}){_END_DASH}"),
    Rule("npm_token", AUTH, ("npm_",), rf"({_token('n')}pm_[A-Za-z0-9]{{36}}){_END}"),
    Rule("private_key", INFRA, ("-----BEGIN",),
         r"(-----BEGIN (?:(?:RSA|EC|DSA|OPENSSH|PGP|ENCRYPTED) )?PRIVATE KEY(?: BLOCK)?-----)"),
    Rule("url_login", INFRA, ("://",), rf"https?://({_USER}+:{_PASS}+)@[^\s/\"'<>]"),
    Rule("slack_webhook", INFRA, ("hooks.slack.com",),
         r"(https://hooks\.slack\.com/services/T[A-Za-z0-9]+/B[A-Za-z0-9]+/[A-Za-z0-9]+)"),
)


def rules_of(*categories: str) -> tuple[Rule, ...]:
    """The rules of the given categories, all without any."""
    return tuple(r for r in RULES if not categories or r.category in categories)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rules as a table ``(rule, category, keywords, regex, group)``."""
    rows = [(r.name, r.category, list(r.keywords), r.regex, r.group) for r in rules]
    schema = "rule string, category string, keywords array<string>, regex string, `group` int"
    return spark.createDataFrame(rows, schema)
