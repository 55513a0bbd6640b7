"""Redaction of secrets: credential patterns, known secrets, business fields and terms, and a gate for suspicious strings.

All steps are column expressions, so a text is redacted where it is read, without leaving the JVM.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed placeholder kinds.
KINDS = (
    "private_key", "aws_access_key", "google_api_key", "github_token", "slack_token", "openai_key", "jwt",
    "url_credentials", "authorization", "env_value", "business_value", "business_term", "known_secret",
)
PLACEHOLDER = r"\[REDACTED:[A-Za-z0-9_]+\]"

#: Fixed credential patterns, in the order in which they apply.
CREDENTIALS = (
    (r"-----BEGIN [A-Z0-9 ]{0,16}PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]{0,16}PRIVATE KEY-----", "private_key"),
    (r"-----BEGIN [A-Z0-9 ]{0,16}PRIVATE KEY-----[\s\S]*", "private_key"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "aws_access_key"),
    (r"\bAIza[0-9A-Za-z_-]{35}\b", "google_api_key"),
    (r"\bgh[pousr]_[A-Za-z0-9]{36,512}\b", "github_token"),
    (r"\bxox[abpros]-[0-9A-Za-z-]{10,512}\b", "slack_token"),
    (r"\bsk-[A-Za-z0-9_-]{20,512}\b", "openai_key"),
    (r"\beyJ[A-Za-z0-9_-]{8,4096}\.[A-Za-z0-9_-]{8,4096}\.[A-Za-z0-9_-]{8,4096}\b", "jwt"),
)
#: Fixed: what white space is, beyond ASCII too, and the edge of a word of ASCII letters, spelled out because the JVM reads both differently.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
EDGE = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Fixed: separators and values of an assignment, names whose values are secret, and values that stay (placeholders, references to the environment).
_VALUE = rf"""(?:"[^"\n]{{0,4096}}"|'[^'\n]{{0,4096}}'|[^{SPACE}]{{1,4096}})"""
_SEPARATOR = r"[ \t]*(?:=(?![=>])|:(?!:)|：(?!：))[ \t]*"
_NAMES = "PASSWORD|PASSWD|SECRET|TOKEN|KEY|APIKEY|CREDENTIAL"
_REFERENCE = rf"(?:{PLACEHOLDER}|\$[A-Za-z_][A-Za-z0-9_]*|\$\{{[^}}{SPACE}]{{1,256}}\}})(?![^{SPACE}])"
#: Signs that stand between the two steps of ``_assigned``; the first is doubled where a text has it.
_SIGN, _OPEN, _CLOSE, _OWN = "\uFDD0", "\uFDD0\uFDD1", "\uFDD0\uFDD3", "\uFDD0\uFDD2"

MAX_RULES, MAX_FIELD, MAX_TERM = 100, 128, 256
MAX_SECRETS, MIN_SECRET, MAX_SECRET = 100, 8, 4096


@dataclass(frozen=True)
class Policy:
    """A company's redaction policy."""

    version: int = 0
    fields: tuple[str, ...] = ()
    terms: tuple[str, ...] = ()
    suspicion_mode: str = "observe"
    problems: tuple[str, ...] = field(default=(), compare=False)


def policy_problems(policy: Policy) -> list[str]:
    """Why a policy is refused; empty if it is valid."""
    out = []
    if len(policy.fields) + len(policy.terms) > MAX_RULES:
        out.append("too_many_rules")
    lowered = [f.lower() for f in policy.fields]
    if any(not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.-]*", f) or len(f) > MAX_FIELD for f in policy.fields):
        out.append("field_invalid")
    if len(set(lowered)) < len(lowered) or len(set(policy.terms)) < len(policy.terms):
        out.append("duplicate_rule")
    if any(not t.strip() or len(t) > MAX_TERM or "\x00" in t for t in policy.terms):
        out.append("term_invalid")
    if any(re.search(r"[:\[\]]", t) or t == "REDACTED" or t in KINDS for t in policy.terms):
        out.append("term_is_placeholder")
    if policy.suspicion_mode not in ("observe", "block"):
        out.append("mode_invalid")
    return out


def secrets_problems(secrets: list[str]) -> list[str]:
    out = ["too_many_secrets"] if len(secrets) > MAX_SECRETS else []
    if any(not MIN_SECRET <= len(s) <= MAX_SECRET for s in secrets):
        out.append("secret_length")
    return out + (["duplicate_secret"] if len(set(secrets)) < len(secrets) else [])


def mark(kind: str) -> str:
    return f"[REDACTED:{kind}]"


def _literal(value: str) -> str:
    return re.sub(r"([\\.*+?^${}()|\[\]])", r"\\\1", value)


def _literals(values) -> str:
    """Literal alternatives, the longest first."""
    return "|".join(_literal(v) for v in sorted(values, key=len, reverse=True))


def _assigned(text: Column, lead: str, stays: str, key: str, kind: str) -> Column:
    """Replace the values that follow ``key``; a match of ``stays`` after ``lead`` is passed over as a whole, so nothing inside it is looked at.

    One scan decides from left to right. It puts what stays between two signs and leaves nothing between them for a
    secret; afterwards the signs go, or become the placeholder where nothing stands between them.
    """
    out = F.replace(text, F.lit(_SIGN), F.lit(_OWN))
    out = F.regexp_replace(out, rf"(?i)({lead})(?:({stays})|({key}){_VALUE})", f"$1$3{_OPEN}$2{_CLOSE}")
    for sign, by in ((_OPEN + _CLOSE, mark(kind)), (_OPEN, ""), (_CLOSE, ""), (_OWN, _SIGN)):
        out = F.replace(out, F.lit(sign), F.lit(by))
    return out


def redact_credentials(text: Column, fields: tuple[str, ...] = ()) -> Column:
    """Replace credentials by placeholders; assignments to registered ``fields`` are left to ``redact_fields``."""
    out = text
    for pattern, kind in CREDENTIALS:
        out = F.regexp_replace(out, pattern.replace(r"\b", EDGE), mark(kind))
    out = F.regexp_replace(out, rf"(?i)([a-z][a-z0-9+.-]{{0,31}}://)[^/{SPACE}:@]{{1,256}}:[^/{SPACE}:@]{{1,256}}@", "$1" + mark("url_credentials") + "@")
    out = F.regexp_replace(out, rf"""(?i)(authorization[{SPACE}]*[:=][{SPACE}]*(?:bearer|basic|token)[{SPACE}]+)(?![<$])([^{SPACE}'"]{{12,}})""", "$1" + mark("authorization"))
    for name in (rf"[A-Za-z0-9_]*(?:{_NAMES})", "PASS"):
        whole = rf"{name}(?![A-Za-z0-9_]){_SEPARATOR}"
        own = [f for f in fields if re.fullmatch(name, f, re.I | re.A)]
        stays = rf"{whole}{_REFERENCE}" + (rf"|(?:{_literals(own)})(?![A-Za-z0-9_]){_SEPARATOR}{_VALUE}" if own else "")
        out = _assigned(out, "^|[^A-Za-z0-9_]", stays, whole, "env_value")
    return out


def redact_known(text: Column, secrets: list[str]) -> Column:
    return F.regexp_replace(text, _literals(secrets), mark("known_secret")) if secrets else text


def redact_fields(text: Column, fields: tuple[str, ...]) -> Column:
    """The value of ``key = value`` for keys that match exactly, whatever their case."""
    if not fields:
        return text
    whole = rf"(?:{_literals(fields)}){_SEPARATOR}"
    return _assigned(text, "(?<![A-Za-z0-9_.-])", whole + _REFERENCE, whole, "business_value")


def redact_terms(text: Column, terms: tuple[str, ...]) -> Column:
    """Literal terms outside placeholders: the text is cut at placeholders, its pieces replaced and joined again."""
    if not terms:
        return text
    pieces = F.transform(F.split(text, PLACEHOLDER, -1), lambda p: F.regexp_replace(p, _literals(terms), mark("business_term")))
    marks = F.concat(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(pieces, marks, lambda p, m: F.concat(p, m)), "")


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character."""
    n = F.length(text)
    parts = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(parts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def suspicious(text: Column) -> Column:
    """Whether a text holds a string that looks like a secret no pattern knows. Lengths, patterns and bounds are fixed values."""

    def is_candidate(c: Column) -> Column:
        plain = c.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") | c.rlike("^[0-9a-fA-F]{7,64}$") | c.rlike(r"^\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?$") | c.contains("/")
        mixed = c.rlike("[A-Z]") & c.rlike("[a-z]") & c.rlike("[0-9]")
        return F.length(c).between(32, 256) & ~plain & mixed & (F.size(F.array_distinct(F.split(c, ""))) >= 8) & (entropy(c) >= 3.5)

    return F.exists(F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/=_-]{32,}"), F.lit(0)), is_candidate)


def sanitize(text: Column, policy: Policy = Policy(), secrets: list[str] = ()) -> Column:
    """struct(action, text, findings): credentials, known secrets, fields, terms, then the gate."""
    if wrong := policy_problems(policy) + secrets_problems(list(secrets)):
        raise ValueError(", ".join(wrong))
    out = redact_terms(redact_fields(redact_known(redact_credentials(text, policy.fields), list(secrets)), policy.fields), policy.terms)
    none = F.array().cast("array<string>")
    send = lambda findings: F.struct(F.lit("send").alias("action"), out.alias("text"), findings.alias("findings"))
    if policy.suspicion_mode == "block":
        caught = F.struct(F.lit("block").alias("action"), F.lit(None).cast("string").alias("text"), F.array(F.lit("suspected_secret")).alias("findings"))
    else:
        caught = send(F.array(F.lit("suspected_secret_observed")))
    return F.when(suspicious(out), caught).otherwise(send(none))
