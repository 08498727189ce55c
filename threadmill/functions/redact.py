"""Secret redaction: six ordered passes, each one regular expression, with markers `[REDACTED:kind]`.

Running it over its own output changes nothing: no pass can match inside a marker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Credential prefixes, token prefixes, names whose assignment is secret, scheme words before a value.
VENDOR = ["ctx7sk-", "sk-ant-", "sk-proj-", "tvly-", "glpat-", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-", "AIza", "sk-", "sk_"]
VENDOR_UPPER = ["AKIA"]
GITHUB = ["github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
NAMES = ["api_key", "apikey", "token", "secret", "password", "passwd", "passphrase", "private_key", "credentials", "credential", "authorization"]
SCHEMES = ["bearer", "basic", "digest", "token"]

_NAME = "|".join(n.replace("_", "[-_]") for n in NAMES)
PASSES = [
    ("pem", r"(?s)-----BEGIN (?:(?!PRIVATE KEY-----).)*+PRIVATE KEY-----(?:(?:(?!-----END ).)*+-----END [^\n]*+\n?|\n?(?:[A-Za-z0-9+/=]{16,}+(?:\n|\z))*+)", "[REDACTED:pem]"),
    ("bearer", r"(?i)(bearer\s*+)[A-Za-z0-9_.~-]{8,}+", "$1[REDACTED:bearer]"),
    ("vendor-key", rf"(?<![A-Za-z0-9])(?:(?:{'|'.join(VENDOR)})[A-Za-z0-9_-]{{12,}}+|(?:{'|'.join(VENDOR_UPPER)})[A-Z0-9]{{12,}}+)", "[REDACTED:vendor-key]"),
    ("github-token", rf"(?<![A-Za-z0-9])(?:{'|'.join(GITHUB)})[A-Za-z0-9_-]{{12,}}+", "[REDACTED:github-token]"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]{4,}+", "[REDACTED:jwt]"),
    (
        "secret",
        rf"(?i)(?<![A-Za-z0-9_.-])((?:[A-Za-z0-9_.-]*[_.-])?(?:{_NAME})(?![A-Za-z0-9_.-])[\"']?\s*+[=:]\s*+(?:(?:{'|'.join(SCHEMES)})\s++)?+)(?:(\")[^\"]{{4,}}+(?=\")|(')[^']{{4,}}+(?=')|[^\s\"',;}})\]&#\[=]{{4,}}+)",
        "$1$2$3[REDACTED:secret]",
    ),
]
#: No text without one of these, "bearer", or an assignment to a secret name holds a secret.
LITERALS = ["-----BEGIN ", "sk-", "sk_", "tvly-", "glpat-", "xox", "AIza", "AKIA", *GITHUB, "eyJ"]


def may_hold_secret(text: Column) -> Column:
    """Cheap scans for fixed strings decide for most texts; the names are looked for only where something is assigned."""
    hint = ((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(rf"(?i)(?:{_NAME})[\"']?\s*+[=:]")) | text.rlike("[bB][eE][aA][rR][eE][rR]")
    for x in LITERALS:
        hint = hint | F.contains(text, F.lit(x))
    return hint


def redact_secrets(text: Column | str) -> Column:
    text = out = F.col(text) if isinstance(text, str) else text
    for _, pattern, marker in PASSES:
        out = F.regexp_replace(out, pattern, marker)
    return F.when(may_hold_secret(text), out).otherwise(text)
