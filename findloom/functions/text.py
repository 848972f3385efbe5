"""Scalar functions on names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from findloom.schema import literal_map

# Abbreviations, stop words, and the words of header findings.
ABBREVIATIONS = {
    "xss": "cross site scripting",
    "sqli": "sql injection",
    "csrf": "cross site request forgery",
    "ssrf": "server side request forgery",
    "ssti": "server side template injection",
    "rce": "remote code execution",
    "lfi": "local file inclusion",
    "rfi": "remote file inclusion",
    "xxe": "xml external entity",
    "idor": "insecure direct object reference",
    "dos": "denial of service",
    "ddos": "distributed denial of service",
    "mitm": "man in the middle",
    "csp": "content security policy",
    "cors": "cross origin resource sharing",
    "hsts": "http strict transport security",
    "jwt": "json web token",
    "otp": "one time password",
    "mfa": "multi factor authentication",
    "2fa": "two factor authentication",
    "tls": "transport layer security",
    "ssl": "secure sockets layer",
    "cve": "common vulnerabilities and exposures",
    "cwe": "common weakness enumeration",
    "api": "application programming interface",
}
STOP_WORDS = (
    "vulnerability", "issue", "bug", "detected", "in", "on", "at", "of", "for", "and", "or", "the",
    "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "to", "from", "by", "with", "found", "possible", "potential", "may", "might",
    "could", "should", "via", "using",
)
HEADER_TRIGGERS = ("header", "configuration", "not set", "missing", "protection", "suggested security")
HEADER_EXCLUSIONS = ("deprecated", "deprecation", "obsolete", "superseded", "replaced", "replacement", "instead")
HTML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def pattern_of(phrases: tuple[str, ...], whole: bool = True) -> str:
    """A pattern for any of the phrases, as whole words; a blank stands for any white space."""
    plain = ["".join(c if c.isalnum() or c in " _" else f"\\{c}" for c in p).replace(" ", r"\s+") for p in phrases]
    edge = r"(?![A-Za-z0-9_])" if whole else ""
    return (r"(?<![A-Za-z0-9_])" if whole else "") + "(?:" + "|".join(plain) + ")" + edge


def says(text: Column, phrases: tuple[str, ...], whole: bool = True) -> Column:
    """Whether the text has any of the phrases."""
    return text.rlike(pattern_of(phrases, whole))


def bound(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def name_words(name: Column) -> Column:
    """Lower-case words of a name: hyphens and underscores split words, other signs are blanks."""
    plain = F.regexp_replace(F.lower(F.trim(name)), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda w: w != "")


def header_family(name: Column) -> Column:
    """The common name of a missing-header finding, or null."""
    return bound(F.array_join(name_words(name), " "), _header_family)


def _header_family(words: Column) -> Column:
    hit = _any_in(words, HEADER_TRIGGERS) & ~_any_in(words, HEADER_EXCLUSIONS)
    has = lambda *w: _any_in(words, w)
    return (
        F.when(hit & has("frame ancestors"), "missing frame ancestors directive")
        .when(hit & (has("content security policy") | words.rlike(r"\bcsp\b")), "missing content security policy header")
        .when(hit & has("x content type options"), "missing x content type options header")
        .when(hit & has("clickjacking", "x frame options"), "missing clickjacking protection header")
    )


def normalize_name(name: Column) -> Column:
    """A name for matching: header family, or expanded, distinct words without stop words."""
    table = literal_map(ABBREVIATIONS)

    def normal(own: Column) -> Column:
        words = F.flatten(F.transform(own, lambda w: F.split(F.coalesce(F.try_element_at(table, w), w), " ")))
        kept = F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS)))
        return F.coalesce(bound(F.array_join(own, " "), _header_family), F.array_join(kept, " "), F.lit(""))

    return bound(name_words(name), normal)


def strip_html(text: Column) -> Column:
    """Tags and four entities removed, white space collapsed."""
    out = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, sign in HTML_ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"[ \t\n\r]+", " "))


def snippet(text: Column, length: int = 160) -> Column:
    """White space collapsed, cut with an ellipsis after ``length`` characters."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > length, F.concat(F.rtrim(F.substring(flat, 1, length - 3)), F.lit("..."))).otherwise(flat)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two sets; 0 if either is empty or null."""
    x, y = (F.coalesce(v, F.array().cast("array<string>")) for v in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


#: Words of titles that say nothing on their own.
GENERIC_TOKENS = ("configuration", "content", "detected", "finding", "header", "headers", "issue", "missing", "options", "policy", "protection", "security", "vulnerability")


def meaningful_tokens(tokens: Column) -> Column:
    return F.array_except(tokens, F.array(*map(F.lit, GENERIC_TOKENS)))


#: What redaction hides and how.
REDACTIONS = (
    (r"(?i)\b(token|api[_-]?key|secret|password|passwd|pwd)(\s*[=:]\s*)[\"']?[A-Za-z0-9_\-./+]{6,}[\"']?", "$1$2[redacted]"),
    (r"(?i)\b(bearer|basic)\s+[A-Za-z0-9_\-./+=]{8,}", "$1 [redacted]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[redacted]"),
    (r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "[redacted]"),
)


def redact(text: Column) -> Column:
    """Secrets in key=value form, bearer tokens and well-known key forms replaced."""
    for pattern, into in REDACTIONS:
        text = F.regexp_replace(text, pattern, into)
    return text


def mask(secret: Column) -> Column:
    """The edges of a secret; a short one is hidden in full."""
    return F.when(F.length(secret) <= 8, F.lit("***")).otherwise(F.concat(F.substring(secret, 1, 4), F.lit("..."), F.substring(secret, -4, 4)))
