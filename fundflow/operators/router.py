"""What a question asks for: its kind, and the things it names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns by kind of question, the first that matches counts.
KINDS: dict[str, tuple[str, ...]] = {
    "risk_summary": (r"(risk|score|danger|threat).*(wallet|address|node|factors|0x)", r"how risky|risk level|risk assessment|risk factor|risk breakdown|risk table"),
    "attribution": (r"(attribut|vasp|exchange|where.*go|endpoint|hop).*(wallet|address|node)?", r"(cash out|off.ramp|deposit to)"),
    "pattern_detection": (r"(pattern|peel.chain|round.amount|rapid|mixer|structur)", r"(suspicious|anomal|unusual).*(transaction|flow|movement)"),
    "fund_flow": (r"(flow|trace|path|hop|movement|transfer).*(fund|money|eth|value|node)", r"(where did|where.*from|where.*to|follow the money)"),
    "entity_lookup": (r"(who is|who owns|what is|entity|owner|label).*(address|wallet|node)", r"(known|identified|label).*(address|wallet|node)"),
    "case_overview": (r"(case|investigation).*(summary|overview|status|progress)", r"(tell me about|describe).*(case|investigation)"),
    "timeline": (r"(timeline|when|chronolog|history|sequence).*(transaction|event)", r"(transaction|event).*(timeline|chronolog|history|sequence)", r"(first|last|recent).*(transaction|activity)"),
    "comparison": (r"(compar|versus|vs|difference).*(wallet|case|risk)", r"(better|worse|higher|lower).*(risk|score)"),
}
# What names a thing.
NAMED = {
    "tx_hash": r"(?i)(0x[a-f0-9]{64})",
    "address": r"(?i)(0x[a-f0-9]{40})(?![a-f0-9])",
    "case_number": r"(?i)(TRX-\d{8}-\d{4})",
    "wallet_id": r"(?i)(?:wallet|id)[\s:]+([a-f0-9-]{36})",
    "chain": r"(?i)(ethereum|polygon|bsc|arbitrum|optimism|base)",
}
FALLBACK = "case_overview"


def question_kind(text: Column, otherwise: str | None = FALLBACK) -> Column:
    """The kind of a question, ``otherwise`` where no pattern matches."""
    out = F.lit(otherwise).cast("string")
    for kind, patterns in reversed(KINDS.items()):
        out = F.when(F.coalesce(text.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False)), kind).otherwise(out)
    return out


def named_things(text: Column) -> list[Column]:
    """A column per kind of name; null if the text has none."""
    out = []
    for name, pattern in NAMED.items():
        found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        out.append((F.initcap(found) if name == "chain" else found).alias(name))
    return out


def classify(questions: DataFrame, text: str = "text", otherwise: str | None = FALLBACK) -> DataFrame:
    return questions.select("*", question_kind(F.col(text), otherwise).alias("kind"), *named_things(F.col(text)))
