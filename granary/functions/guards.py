"""Column expressions for a conversation's turn: refused topics, requests for a human, and the verdict of a whole turn."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import injections, redacted

#: Refused topics in their order, the message that refuses each, and what the topic looks like.
TOPICS: list[tuple[str, str, list[str]]] = [
    (
        "investment_advice",
        "refusal.out_of_scope.investment",
        [
            r"\b(?:should i|shall i|worth it to)\b.{0,40}\b(?:invest|buy shares|stocks?|mutual funds?|sip)\b",
            r"\b(?:which|what)\b.{0,30}\b(?:stock|mutual fund|sip|portfolio)\b.{0,30}\b(?:best|recommend|should)\b",
            r"\b(?:invest|investment)\s+advice\b",
        ],
    ),
    (
        "tax_advice",
        "refusal.out_of_scope.tax",
        [
            r"\b(?:save|saving|reduce|avoid|evade)\b.{0,20}\btax(?:es)?\b",
            r"\btax\s+(?:advice|planning|benefit|deduction)\b.{0,40}\b(?:should|best|recommend|claim)\b",
            r"\b(?:80c|section\s*80)\b.{0,40}\b(?:should|claim|best)\b",
        ],
    ),
    (
        "rate_negotiation",
        "refusal.no_negotiation",
        [
            r"\b(?:can you|could you|will you)\b.{0,30}\b(?:lower|reduce|better|discount|waive|match)\b.{0,30}\b(?:rate|roi|interest|fee|charge)\b",
            r"\b(?:negotiate|bargain|beat)\b.{0,30}\b(?:rate|interest|price|offer)\b",
            r"\b(?:best|lowest)\s+rate\s+you\s+can\b",
        ],
    ),
    (
        "credit_decision",
        "refusal.no_credit_decision",
        [
            r"\b(?:will|would|can)\b.{0,25}\b(?:you|the bank)\b.{0,25}\b(?:approve|sanction|reject|decline)\b",
            r"\b(?:approve|sanction)\s+my\s+(?:loan|application)\b",
            r"\bam i\b.{0,20}\b(?:approved|rejected|eligible for approval)\b",
        ],
    ),
    ("legal_advice", "refusal.out_of_scope.legal", [r"\b(?:can|should)\s+i\s+(?:sue|file a case|take legal action)\b", r"\blegal\s+advice\b"]),
]

#: Plain requests for a person, and the message that answers them.
HUMAN = [
    r"\b(?:speak|talk|connect)\b.{0,20}\b(?:to|with)\b.{0,20}\b(?:a\s+)?(?:human|person|agent|officer|someone|representative)\b",
    r"\b(?:human|live)\s+(?:agent|support|help)\b",
    r"\b(?:transfer|escalate)\s+(?:me\s+)?to\b",
    r"\bcall\s+me\s+back\b",
]
HANDOFF = "handoff.requested"


def topic(text: Column) -> Column:
    """struct(topic, refusal, matched) of the first refused topic that a text meets; null within the fences."""
    found = [F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(name).alias("topic"), F.lit(refusal).alias("refusal"), F.regexp_extract(text, f"(?i){p}", 0).alias("matched"))) for name, refusal, patterns in TOPICS for p in patterns]
    return F.coalesce(*found)


def wants_human(text: Column) -> Column:
    """Whether the text asks for a person; null does not."""
    return F.coalesce(text.rlike("(?i)" + "|".join(HUMAN)), F.lit(False))


def turn(text: Column, passages: Column | None = None) -> Column:
    """Verdict of a user's turn and the passages (array of strings) retrieved for it.

    struct(refuse, refusal, topic, handoff, injections, logged, redactions): a
    request for a person goes before any refusal; injections are looked for in
    the turn and in every passage; ``logged`` is the redacted turn.
    """
    fence, human, clean = topic(text), wants_human(text), redacted(text)
    every = injections(text)
    if passages is not None:
        every = F.concat(every, F.flatten(F.transform(F.coalesce(passages, F.array().cast("array<string>")), injections)))
    return F.struct(
        fence.isNotNull().alias("refuse"), F.when(human, HANDOFF).otherwise(fence["refusal"]).alias("refusal"), fence["topic"].alias("topic"), human.alias("handoff"), F.size(every).alias("injections"),
        clean["text"].alias("logged"), sum([clean["counts"][k] for k in ("aadhaar", "card", "pan", "ifsc", "email", "phone", "account_number")], F.lit(0)).alias("redactions"),
    )
