"""Column expressions over text: keys, terms, redaction, fences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A term starts with a letter or digit and goes on through marks, digits, points, hyphens, percent and rupee signs.
TERM = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}_%₹.\-]*"

#: Formats of personal data, in the order in which they are replaced.
PERSONAL = [
    ("aadhaar", r"(?<!\d)\d{4}[\s-]?\d{4}[\s-]?\d{4}(?!\d)"),
    ("card", r"(?<!\d)(?:\d{4}[\s-]?){3}\d{4}(?!\d)"),
    ("pan", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("ifsc", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("email", r"\b[\w.+-]+@[\w-]+\.[\w.]{2,}\b"),
    ("phone", r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{9}(?!\d)"),
    ("account_number", r"(?<!\d)\d{9,18}(?!\d)"),
]

#: What an instruction hidden in a text looks like.
INJECTION = [
    ("instruction_override", r"(?i)\bignore\b.{0,30}\b(?:instruction|prompt|rule|direction|guideline|restriction)s?\b"),
    ("instruction_override", r"(?i)\b(?:disregard|forget|override)\b.{0,30}\b(?:instruction|prompt|rule|system|above)"),
    ("instruction_override", r"(?i)\bnew\s+(?:instruction|rule|system\s+prompt)s?\b\s*[:.]"),
    ("role_reassignment", r"(?i)\byou\s+are\s+now\b"),
    ("role_reassignment", r"(?i)\b(?:act|behave)\s+as\s+(?:a|an|if)\b"),
    ("role_reassignment", r"(?i)\bpretend\s+(?:to\s+be|you)\b"),
    ("tool_directive", r"(?i)\b(?:call|invoke|execute|run)\s+(?:the\s+)?(?:tool|function|api|command)\b"),
    ("tool_directive", r"(?i)\[tool:[a-z_]+\]"),
    ("exfiltration", r"(?i)\b(?:repeat|print|show|reveal|output)\b.{0,30}\b(?:system\s+prompt|instruction|your\s+prompt)"),
    ("policy_assertion", r"(?i)\bwhen\s+(?:asked|queried)\b.{0,40}\b(?:say|state|reply|respond|tell)\b"),
    ("policy_assertion", r"(?i)\b(?:always|never)\s+(?:say|state|tell|mention|reply)\b"),
    ("policy_assertion", r"(?i)\bthe\s+assistant\s+(?:must|should|shall|will)\b"),
]


def terms(text: Column) -> Column:
    """Terms in lower case, without points and hyphens at their ends; none begins with one."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda t: F.rtrim(t, F.lit(".-")))


def redacted(text: Column) -> Column:
    """struct(text, counts): each kind replaced in turn."""
    counts = []
    for kind, pattern in PERSONAL:
        counts.append(F.regexp_count(text, F.lit(pattern)).alias(kind))
        text = F.regexp_replace(text, pattern, f"[REDACTED:{kind}]")
    return F.struct(text.alias("text"), F.struct(*counts).alias("counts"))


def injections(text: Column) -> Column:
    """array<struct(signal, matched)>: the first match of each pattern that matches."""
    found = F.array(*[F.struct(F.lit(s).alias("signal"), F.regexp_extract(text, p, 0).alias("matched")) for s, p in INJECTION])
    return F.filter(found, lambda x: x["matched"] != "")


def normalised_phone(c: Column) -> Column:
    return F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10))


def normalised_account(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def normalised_name(c: Column) -> Column:
    """Lower case, letters and digits only, single spaces. Latin accents are removed by decomposition where the session's functions allow; other scripts stay."""
    plain = F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def numeric_claims(text: Column) -> Column:
    """Numbers in digits other than ordinals and bare years."""
    found = F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?%?(?:st|nd|rd|th)?"), F.lit(0))
    return F.filter(found, lambda x: ~x.rlike("(?:st|nd|rd|th)$") & ~x.rlike("^(?:19|20)[0-9]{2}$"))
