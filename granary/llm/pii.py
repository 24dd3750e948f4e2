"""Personal data spans, by DataFrame functions alone.

Regular expressions propose spans; a checksum (Luhn for cards, mod 97 for
bank accounts, whose length the country fixes), a range of values or a digit
count confirms them; words beside a span raise or lower its score. Beside it
is up to ``CONTEXT`` code points on either side, as far as the next match of
the same kind. ``email``, ``ip``, ``card`` and ``phone`` stay once confirmed,
with their score. ``iban`` and ``ssn`` are added where their score reaches
``MIN_SCORE``. Positions are code points, the end exclusive.

The patterns use possessive repeats and start either at the start of a run or
where the last match ended, so they find what the plain forms find, in linear
time and without deep recursion on very long runs. Places are found and texts
masked in time linear in the text.

Defined cases: a null text counts as empty and has no spans; an empty table
gives an empty result; repeated rows are scanned row by row; extra columns are
kept and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import col, placed, scanned

#: Length of a bank account number by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 "
    "IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 "
    "SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
MOD_97 = """aggregate(transform(sequence(1, length(x.a)), i -> substr(substr(x.a, 5) || substr(x.a, 1, 4), i, 1)), 0,
  (r, c) -> if(c between '0' and '9', (r * 10 + int(c)) % 97, (r * 100 + ascii(c) - 55) % 97)) = 1"""

#: kind -> (pattern, confirmed if, score in percent, words that raise it, words that lower it), in the order of the kinds.
KINDS: dict[str, tuple[str, str, int, str, str]] = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "true", 90, "mail|contact|write", "example|noreply"),
    "ip": (
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"x.v rlike r'^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$'",
        60,
        "ip|host|server|address",
        "version|release|section|chapter|build",
    ),
    "card": (r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", "length(x.d) between 14 and 19 and luhn_check(x.d)", 80, "card|visa|credit|debit|payment", "order|invoice|tracking|serial"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(x.d) between 10 and 15", 60, "phone|call|tel|mobile|fax", "order|invoice|serial|isbn"),
    "iban": (
        r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
        f"instr('{IBAN_LENGTHS}', concat(substr(x.a, 1, 2), length(x.a))) > 0 and {MOD_97}",
        70,
        "iban|bank|account|transfer",
        "order|part|serial|model",
    ),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"x.v rlike r'^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'", 30, "ssn|social|security|insurance", "order|invoice|part|serial|model"),
}
BASE = ("email", "ip", "card", "phone")
#: A cheap test that a text must pass before its pattern runs.
FIRST = {"email": "contains(t, '@')", "phone": "contains(t, '+')"}
CONTEXT = 40
#: Percent that a word beside a span adds or takes, and the score that an added span needs.
CONTEXT_WEIGHT = 30
MIN_SCORE = 60
SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string,score:int,bs:int,be:int>"


def _sql(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    return "r'" + pattern + "'"


def _scored(k: str, order: int) -> str:
    """Confirmed spans of one kind, with scores in percent."""
    pattern, test, score, more, less = KINDS[k]
    beside = r"lower(concat(x.before, '\n', x.after))"
    judged = rf"least(100, greatest(0, {score} + if({beside} rlike r'\b(?:{more})', {CONTEXT_WEIGHT}, 0) - if({beside} rlike r'\b(?:{less})', {CONTEXT_WEIGHT}, 0)))"
    full = f"transform({placed('t', _sql(pattern), f'm_{k}', CONTEXT)}, y -> struct(y.s as s, y.e as e, y.bs as bs, y.be as be, y.v as v, y.before as before, y.after as after, regexp_replace(y.v, '[^0-9]', '') as d, regexp_replace(y.v, ' ', '') as a))"
    out = f"transform(filter({full}, x -> {test}), x -> struct(x.s as start, {order} as rank, x.e as end, '{k}' as kind, x.v as value, {judged} as score, x.bs as bs, x.be as be))"
    if k not in BASE:
        out = f"filter({out}, y -> y.score >= {MIN_SCORE})"
    return f"if(size(m_{k}) = 0, cast(array() as array<{SPAN}>), {out})"


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), ``t`` (the text) and ``pii``: spans sorted by start, then kind; ``bs`` and ``be`` are their bytes."""
    given = docs.select(F.struct(*[col(c) for c in docs.columns]).alias("row"), F.coalesce(col(text), F.lit("")).alias("t"))
    hits = [f"if({FIRST.get(k, 'true')}, regexp_extract_all(t, {_sql(p)}, 0), cast(array() as array<string>)) as m_{k}" for k, (p, *_) in KINDS.items()]
    found = given.selectExpr("row", "t", *hits)
    spans = ", ".join(_scored(k, i) for i, k in enumerate(KINDS))
    return found.selectExpr("row", "t", f"array_sort(concat({spans})) as pii")


def span_text(kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end``, comma-joined, of the spans of some kinds."""
    which = "pii" if kinds is None else f"filter(pii, x -> x.kind in ({', '.join(map(repr, kinds))}))"
    return F.expr(f"array_join(transform({which}, x -> x.kind || ':' || x.start || ':' || x.end), ',')")


def pii_digest(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans of each document and their scores in percent."""
    found = find_pii(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")))
    counts = [F.expr(f"cast(size(filter(pii, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE]
    scores = F.expr("array_join(transform(pii, x -> cast(x.score as string)), ',')")
    return found.select("row.doc_id", *counts, F.sha2(span_text(BASE).cast("binary"), 256).alias("base_sha256"), span_text().alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]``; overlapping spans become one. ``length`` follows the new text."""
    found = find_pii(docs, text)
    # Bytes, because a part of a string is found by counting its code points from the start.
    piece = "if(x.bs >= a.at, concat(cast(substring(b, a.at + 1, x.bs - a.at) as string), '[', upper(x.kind), ']'), '')"
    whole = scanned("pii", "0", "greatest(a.at, x.be)", piece, "string", "concat(array_join(flatten(r.parts), ''), cast(substring(b, r.at + 1) as string))")
    masked = F.expr(f"element_at(transform(array(cast(t as binary)), b -> {whole}), 1)")
    clean = found.select("row", F.when(F.size("pii") > 0, masked).otherwise(col(text, "row")).alias("clean"))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.col("clean").alias(c))
        elif c == length:
            out.append(F.coalesce(F.length("clean").cast(docs.schema[c].dataType), col(c, "row")).alias(c))
        else:
            out.append(col(c, "row").alias(c))
    return clean.select(*out)
