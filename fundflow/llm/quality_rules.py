"""Quality rules as a ledger of bits, with DataFrame functions only.

:func:`ledger` reads every text once, measures it and sets one bit per rule
that fails. A policy is a version's mask of rules; verdicts of any policy, and
ablations of its rules, come from the bits alone. :func:`kept_ledger` stores
the ledger, so that any number of policies and ablations read it and no text.

Defined results: a null text is an empty one (no words, so the base fails);
rows that repeat are judged each; an empty table gives an empty ledger. All
other columns pass through, whatever their names, unless they have a ledger
column's name, which the ledger's own replaces. A text of any length is judged
as a whole.

The measures are per text. The rules compare shares, so texts of any length
are judged alike; windows of eight words are compared by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.llm.common import SPACE_CLASS, packed, stored, unpacked

WINDOW = 8
SYMBOLS = "[^#*$%&|<>]+"
#: Every rule, by bit: fails where the condition holds.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "stuttering": "2 * n_stutter > n_words",
    "shouting": "2 * n_capitals > word_chars",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars > 20 * n_words or word_chars < 2 * n_words",
}
BASE = ("few_words", "repeated_words")
#: Rules that each version of the policy applies.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": (*BASE, "symbols"),
    "v2": (*BASE, "symbols", "stuttering", "shouting", "duplicate_lines", "word_length"),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter", "n_capitals")


def mask(*rules: str) -> int:
    return sum(1 << list(RULES).index(r) for r in rules)


def _with(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.transform(F.array(value), then)[0]


def _long(x: Column) -> Column:
    return x.cast("long")


def _covered(hashes: Column) -> Column:
    """Words within windows that occur twice, given the hash of every window."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda e, j: F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, j - 1)["h"] == e["h"], F.lit(False)))
    places = _with(pairs, lambda s: F.sort_array(F.transform(twice(s), lambda e: e["i"])))
    gains = lambda p: F.transform(p, lambda at, k: F.least(F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)), F.lit(WINDOW)))
    return _with(places, lambda p: F.aggregate(gains(p), F.lit(0).cast("long"), lambda n, x: n + x))


def _repeated(words: Column) -> Column:
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    counted = _with(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_covered(h)))
    return F.when(n > WINDOW, counted).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of :data:`MEASURES`."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE_CLASS}]"))
    of_words = lambda w: F.struct(
        _long(F.size(w)).alias("n_words"),
        _long(F.length(F.array_join(w, ""))).alias("word_chars"),
        _repeated(w).alias("n_repeat_words"),
        _long(F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False))))).alias("n_stutter"),
    )
    of_lines = lambda ls: F.struct(_long(F.size(ls)).alias("n_lines"), _long(F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"))
    return F.struct(
        _with(words, of_words).alias("w"),
        _with(lines, of_lines).alias("l"),
        _long(F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
        _long(F.length(F.regexp_replace(text, r"\P{Lu}+", ""))).alias("n_capitals"),
    )


def _judged(docs: DataFrame) -> DataFrame:
    """Packed rows with the measures and failure_bits."""
    measured = packed(docs, "text").select("_row", measures(F.col("text")).alias("_m"))
    flat = measured.select("_row", "_m.w.*", "_m.l.*", "_m.n_symbols", "_m.n_capitals")
    bits = sum((F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, rule in enumerate(RULES.values())), F.lit(0).cast("long"))
    return flat.withColumn("failure_bits", bits)


def ledger(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per row: its columns (text only if asked), the measures, failure_bits."""
    return unpacked(_judged(docs), docs.columns, *map(F.col, (*MEASURES, "failure_bits")), without=() if keep_text else ("text",))


def passing(docs: DataFrame, policy: str) -> DataFrame:
    """The rows of ``docs``, as they are, that the policy doesn't reject."""
    return unpacked(_judged(docs).where(~fails(POLICIES[policy])), docs.columns)


def kept_ledger(docs: DataFrame) -> DataFrame:
    """The ledger of ``docs``, without their texts, as a table in the shared folder."""
    return stored(ledger(docs), "quality-ledger")


def fails(rules: tuple[str, ...]) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(mask(*rules)).cast("long")) != 0


def ablations(entries: DataFrame, policy: str = "v2") -> DataFrame:
    """Per rule of a policy: rows that fail it, that fail it alone, and that
    the policy rejects without it. One aggregation over distinct bit sets."""
    rules = POLICIES[policy]
    failed = F.col("failure_bits").bitwiseAND(F.lit(mask(*rules)).cast("long"))
    sets = entries.groupBy(failed.alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask(r)).cast("long").alias("bit")) for r in rules])).alias("r")
    by_rule = sets.select("bits", "n", each).select("bits", "n", "r.rule", "r.bit")
    total = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return by_rule.groupBy("rule").agg(
        total(hit).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_only"),
        total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) != 0).alias("n_rejected_without"),
    )
